"""Exact duplicates: a 128-bit hash of the normalised text groups, bytes decide.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut

#: The characters that do not count, space and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of ``IGNORED``."""
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the row that stays for its text.

    Columns: ``id_col``, keep_id, group_size, kept, n_chars, text_sha256.

    Rows are grouped by the 128-bit hash and, within it, by the bytes of the normalised
    text: grouping on the text itself is the byte comparison, and it combines on the map
    side, so a text with a million copies leaves one row a task. Of equal texts the row with
    the most code points stays, of those the smallest id. Rows without text only travel as
    keys. Should two texts ever share both hashes, their rows are matched by bytes.

    Null text counts as empty, and empty texts equal each other. A null id sorts after all
    others. A repeated row (same id and text) counts as another member; each gets its own
    row, and ``kept`` marks all rows that carry the kept id and length. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).select(
        "doc", F.length("raw").cast("long").alias("n_chars"), normalised(F.col("raw")).alias("norm")
    )
    hashed = rows.select("doc", "n_chars", "norm", F.unhex(F.md5("norm")).alias("h"))
    order = _order(F.col("n_chars"), F.col("doc"))
    classes = cut(
        hashed.groupBy("h", "norm")
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("s"), "group_size", "best")
    )
    keyed = hashed.select("doc", "n_chars", "h", F.unhex(F.sha2("norm", 256)).alias("s"))
    shared = classes.groupBy("h", "s").agg(F.count("*").alias("n")).where("n > 1").select("h", "s")
    if shared.isEmpty():
        joined = keyed.join(classes, ["h", "s"], "left")  # every row has its class; left spares a second hashing to test for nulls
    else:  # two texts under one pair of hashes: these rows are matched by their bytes
        whole = hashed.withColumn("s", F.unhex(F.sha2("norm", 256))).join(shared, ["h", "s"], "left_semi")
        odd = whole.groupBy("h", "s", "norm").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        joined = (
            keyed.join(shared, ["h", "s"], "left_anti").join(classes, ["h", "s"])
            .unionByName(whole.join(odd, ["h", "s", "norm"]).drop("norm"))
        )
    keep_chars, keep_id = _from_order(F.col("best"))
    return joined.select(
        F.col("doc").alias(id_col),
        keep_id.alias("keep_id"),
        "group_size",
        (keep_id.eqNullSafe(F.col("doc")) & (keep_chars == F.col("n_chars"))).alias("kept"),
        "n_chars",
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each text, with all its columns: a row that is marked kept, of equal ones any.

    Nulls, empty texts and ties as in :func:`exact_groups`. Rows go by id and hash of the
    normalised text, so rows with one id or none and different texts all stay. One shuffle of
    the texts, by both.
    """
    none = F.lit(-(1 << 63))
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.coalesce(F.col(id_col), none).alias("__id"), F.unhex("text_sha256").alias("__s"), F.col("n_chars").alias("__n")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), none)).withColumn("__s", F.unhex(F.sha2(normalised(text), 256)))
    differs = F.length(F.coalesce(keyed[text_col], F.lit(""))) - kept["__n"]  # no key of the join, so that rows stay dealt by id and hash
    same = (keyed["__id"] == kept["__id"]) & (keyed["__s"] == kept["__s"]) & (differs == 0)
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__id", "__s"]).drop("__id", "__s")


#: Ids count from 0 to 2^64 - 1, a null id as 2^64; lengths are 2^65 apart, so that a longer text always goes first.
_STEP, _NULL = "36893488147419103232", "18446744073709551616"


def _order(n_chars: Column, doc: Column) -> Column:
    """A decimal that is least for the most code points, then the smallest id.

    One fixed-width number: the aggregate stays in the hash aggregate's buffer.
    """
    id_part = F.coalesce(doc.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit(_NULL).cast("decimal(20,0)"))
    high = (F.lit(4294967295).cast("long") - n_chars).cast("decimal(12,0)")
    return ((high * F.lit(_STEP).cast("decimal(20,0)")).cast("decimal(38,0)") + id_part).cast("decimal(38,0)")


def _from_order(best: Column) -> tuple[Column, Column]:
    step = F.lit(_STEP).cast("decimal(20,0)")
    rest = F.pmod(best, step.cast("decimal(38,0)")).cast("decimal(20,0)")
    high = ((best - rest) / step).cast("decimal(20,0)")
    doc = F.when(rest != F.lit(_NULL).cast("decimal(20,0)"), (rest - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long"))
    return (F.lit(4294967295).cast("long") - high.cast("long")), doc
