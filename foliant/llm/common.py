"""Helpers shared by the operators: shared scratch space, ranges of a key, text columns.

Arrow batches of whole texts stay bounded by Spark itself, which closes a batch at 64 MB
(``spark.sql.execution.arrow.maxBytesPerBatch``), and :func:`in_parts` bounds what is made of
them at once, so no operator changes the session's settings.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; on one machine alone a temporary folder may stand in.

    A cluster without that setting is an error: a folder of one machine would lose rows.
    """
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if value := get():
            return value.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.path.join(tempfile.gettempdir(), f"foliant-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, dealt out anew if fewer of its partitions have rows than there are cores.

    A file of one row group is one partition with rows, however many the scan has. Large scans
    are left as they are; for others the rows are counted from the files' footers.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > 8 * cores:
        return scan
    held = scan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).count()
    return scan.repartition(2 * cores) if 0 < held < cores else scan


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in files of the shared folder.

    Reliable: a lost executor costs no rows. The files go once nothing refers to them
    (with ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def in_parts(batches: Iterator[pd.DataFrame], column: str = "text", size: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The batches' rows in frames of about ``size`` characters, so that what a worker makes of texts at once is bounded by bytes, not rows."""
    for batch in batches:
        ends = np.cumsum(batch[column].str.len().to_numpy(np.int64))
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(ends // size)) + 1):
            if len(rows):
                yield batch.iloc[rows[0] : rows[-1] + 1].reset_index(drop=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(name: str = "text") -> Column:
    """A hash that tells texts of one id (or of none) apart; null counts as empty."""
    return F.sha2(text_or_empty(name), 256)


#: Ranges of a key at most: the driver holds one bound each, whatever the table's size. Children of a node of the bounds' tree.
RANGES, _GROUP = 100_000, 64

#: What stands for a missing id: the least long.
NO_ID = -(1 << 63)


def range_bounds(rows: DataFrame, key: str, text: str, bytes_per_range: int) -> list[int]:
    """Ascending bounds that cut the rows, by ``key`` (a long, no nulls), into ranges of about as many bytes of ``text``.

    A key that fills several ranges is a bound several times. Two passes, over the text's
    lengths and over the keys; there are ``RANGES`` ranges at most, which then hold more.
    """
    size = rows.agg(F.sum(F.octet_length(text))).head()[0] or 0
    ranges = min(RANGES, max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / bytes_per_range)))
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("q")).head()[0]
    return list(found or [])


def _rank(key: Column, bounds: list[int], below: bool) -> Column:
    """How many bounds lie at or below the key, or below it: a walk down a tree of constants, ``_GROUP`` children a node."""

    def among(values: Column) -> Column:
        return F.size(F.filter(values, (lambda b: b < key) if below else (lambda b: b <= key)))

    level = bounds
    levels = [level]
    while len(level) > _GROUP:
        level = level[_GROUP - 1 :: _GROUP]
        levels.append(level)
    at = None
    for level in reversed(levels):
        whole = F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")  # folded to a constant
        at = among(whole) if at is None else at * F.lit(_GROUP) + among(F.slice(whole, at * F.lit(_GROUP) + 1, F.lit(_GROUP)))
    return at


def range_of(key: Column, text: Column, bounds: list[int]) -> Column:
    """The range, 0 to len(bounds), of a row; rows of a key that fills several ranges go by their text's hash."""
    if not bounds:
        return F.lit(0)
    high = _rank(key, bounds, below=False)
    if len(set(bounds)) == len(bounds):
        return high
    low = _rank(key, bounds, below=True)
    share = (F.shiftrightunsigned(F.xxhash64(text), 33) / F.lit(float(1 << 31))) * (high - low)
    return F.when(high - low > 1, low + 1 + F.floor(share).cast("int")).otherwise(high)
