"""Kernels that the document operators and the table queries share. All are plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order; the aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key, numbered from 1 (the newest)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0: ``breaks`` (over the same window, see :func:`before`) begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__new", F.when(breaks, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def before(column: str, keys: list[str], order: list[str]) -> Column:
    """The value in the row before, null in a key's first row."""
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def lookup(df: DataFrame, table: DataFrame, on: list[str], value: str, default: Column, name: str) -> DataFrame:
    """``table``'s value for each row, or a default. ``table`` has one row a key."""
    return df.join(table.select(*on, F.col(value).alias("__found")), on, "left").withColumn(name, F.coalesce("__found", default)).drop("__found")


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str, name: str = "text") -> DataFrame:
    """Texts of a key in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__text"]), separator).alias(name))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of the values before each row of its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("double")))


def first_preferred(df: DataFrame, keys: list[str], preferred: Column, value: str, order: list[str], default: Column, name: str) -> DataFrame:
    """The first preferred value in order, else the first, else the default."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(preferred, F.col(value)), F.when(preferred, at)), F.min_by(value, at), default).alias(name))


def toggled(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items that occur an odd number of times: what a sequence of toggles leaves selected."""
    return df.groupBy(*keys, item).agg(F.count("*").alias("times")).where("times % 2 = 1")


def overlay(base: DataFrame, changes: DataFrame, on: list[str], value: str, order: list[str]) -> DataFrame:
    """``base`` with ``value`` taken from the last change of its key, where there is one; adds ``modified``."""
    latest = newest_wins(changes.select(*on, F.col(value).alias("__new"), *order), on, order).select(*on, "__new")
    joined = base.join(latest.withColumn("__hit", F.lit(True)), on, "left")
    return joined.withColumn("modified", F.coalesce("__hit", F.lit(False))).withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def expand_ranges(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each number from low to high; none if high is less."""
    return df.withColumn(name, F.explode(F.when(high >= low, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))


def fill_differences(df: DataFrame, keys: list[str], order: list[str], number: Column, name: str = "code") -> DataFrame:
    """A running counter: a number sets it, any other row takes it and adds one. Rows before the first number count from 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.withColumn("__n", number).withColumn("__run", F.count("__n").over(w))
    inside = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("__n", ignorenulls=True).over(Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = runs.withColumn(name, F.coalesce(base, F.lit(0)) + F.sum(F.when(F.col("__n").isNull(), 1).otherwise(0)).over(inside) - 1)
    return filled.where(F.col("__n").isNull()).drop("__n", "__run")
