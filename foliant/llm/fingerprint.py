"""Document fingerprints by consistent weighted sampling with gamma variates.

Native: DataFrame functions only.

A document is a bag of words, weighted by their counts. For lane k and word x,
r and c are Gamma(2,1) and b is uniform on [0,1), all drawn from a hash of (x, k). With
weight w: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1). The lane keeps (x, t) of the
least a. Two documents agree in a lane with a probability equal to their generalised
Jaccard similarity, sum of min weights over sum of max weights, independently by lane.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import NO_ID, cut, range_bounds, range_of

#: The likeness of a pair at s has a standard error of sqrt(s (1 - s) / LANES): 0.058 at 0.8.
LANES = 48

#: Lanes of one row of the sampling stage: keeps the generated code within what the JVM compiles.
_BLOCK = 8

_32 = (1 << 32) - 1

#: Cells of the tables of quantiles.
_CELLS = 256


def _gamma_quantile(p: float) -> float:
    """Inverse of 1 - (1 + x) exp(-x), the distribution of Gamma(2,1), by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        x = (low + high) / 2
        if -math.expm1(-x) - x * math.exp(-x) < p:
            low = x
        else:
            high = x
    return (low + high) / 2


@lru_cache
def _tables() -> tuple[list[float], list[float], list[float]]:
    """Quantiles of r, of ln c, and of ln c within the lowest cell, at the cells' edges.

    Spark's logarithm is a slow native call; a hash looked up in these tables gives the same
    variates, piecewise linear between the quantiles, for a fraction of the time.
    """
    low, high = 0.5 / _CELLS**3, 1 - 0.1 / _CELLS
    edges = [min(max(i / _CELLS, low), high) for i in range(_CELLS + 1)]
    fine = [min(max(i / _CELLS**2, low), high) for i in range(_CELLS + 1)]
    return [_gamma_quantile(max(p, 0.1 / _CELLS)) for p in edges], [math.log(_gamma_quantile(p)) for p in edges], [math.log(_gamma_quantile(p)) for p in fine]


def _at(table: list[float], cell: Column, part: Column) -> Column:
    """Between the edges of a cell."""
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table[:-1])), ",").cast("array<double>")  # folded to a constant
    steps = F.split(F.lit(",".join(f"{y - x:.5f}" for x, y in zip(table, table[1:], strict=False))), ",").cast("array<double>")
    return F.get(values, cell) + F.get(steps, cell) * part


def _bits(h: Column, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long")).cast("int")


def lane_key(term: Column, log_weight: Column, lane: Column) -> Column:
    """A long whose high half orders by a and whose low half names the sample (term, t)."""
    of_r, of_c, of_low = _tables()
    h1, h2 = F.xxhash64(term, lane), F.xxhash64(lane, term)
    r = _at(of_r, _bits(h1, 0, 8), _bits(h1, 8, 16) / F.lit(65536.0))
    b = (_bits(h1, 24, 24) + F.lit(0.5)) / F.lit(float(1 << 24))
    cell, sub, part = _bits(h2, 0, 8), _bits(h2, 8, 8), _bits(h2, 16, 16) / F.lit(65536.0)
    log_c = F.when(cell > 0, _at(of_c, cell, (sub + part) / F.lit(256.0))).otherwise(_at(of_low, sub, part))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b + F.lit(1.0))
    high = F.floor((log_a + F.lit(64.0)) * F.lit(float(1 << 24)))
    name = F.shiftrightunsigned(h2, 20).bitwiseXOR(t * F.lit(0x61C88647)).bitwiseAND(F.lit(_32).cast("long"))
    return high * F.lit(1 << 32).cast("long") + name


def words_of(text: Column) -> Column:
    """Words as they stand, cut at each space, tab or line end.

    Between two such characters in a row lies an empty word, which counts like any other;
    the empty text is one empty word.
    """
    for c in "\t\n\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def sample_lanes(counted: DataFrame, key: str = "at", within: str = "bucket", lanes: int = LANES) -> DataFrame:
    """``counted``: ``within``, ``key`` (long), term (long), n (count); one row per key: lanes, the least :func:`lane_key` of each lane.

    If the input is dealt by ``within``, nothing moves.
    """
    blocks = (lanes + _BLOCK - 1) // _BLOCK
    spread = counted.select(within, key, "term", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log(F.col("n").cast("double"))).alias("lw"), F.explode(F.array(*[F.lit(i * _BLOCK) for i in range(blocks)])).alias("first"))
    least = spread.groupBy(within, key, "first").agg(*[F.min(lane_key(F.col("term"), F.col("lw"), F.col("first") + F.lit(j))).alias(f"m{j}") for j in range(_BLOCK)])
    packed = least.groupBy(within, key).agg(F.array_sort(F.collect_list(F.struct("first", F.array(*[F.col(f"m{j}") for j in range(_BLOCK)]).alias("part")))).alias("parts"))
    return packed.select(within, key, F.slice(F.flatten(F.col("parts.part")), 1, lanes).alias("lanes"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal lanes: estimates the generalised Jaccard similarity. Null if a side is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.lit(_32).cast("long")) == y.bitwiseAND(F.lit(_32).cast("long"))), lambda e: e))
    return F.when(a.isNotNull() & b.isNotNull(), same / F.size(a))


def as_text(lanes: Column) -> Column:
    """The lanes as lower-case hexadecimal digits, eight a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_32).cast("long")))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """One row per document: ``id_col``, lanes, fingerprint.

    Equal texts have equal fingerprints. Null text counts as empty; texts without words share
    the fingerprint of the empty word. Repeated rows give repeated results. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    # rows are told apart by a number of their own: equal rows must not add up. Written out first, as the number depends on the reading task.
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(max(64, rows.count() // 2000))).cast("int")))
    words = rows.repartition("bucket").select("bucket", "at", F.explode(words_of(F.col("raw"))).alias("w"))
    found = sample_lanes(words.groupBy("bucket", "at", F.xxhash64("w").alias("term")).agg(F.count("*").alias("n")), lanes=lanes)
    return rows.select("bucket", "at", "doc").join(found, ["bucket", "at"]).select(F.col("doc").alias(id_col), "lanes", as_text(F.col("lanes")).alias("fingerprint"))


def _merged_sides(counted: DataFrame, lanes: int) -> DataFrame:
    """From keys at = 4 rn + side (0 own text, 1 edited text, 2 both): bucket, rn, own, edit."""
    found = sample_lanes(counted, lanes=lanes).withColumn("rn", F.shiftright("at", 2).cast("int")).withColumn("side", F.col("at").bitwiseAND(F.lit(3).cast("long")))
    sides = found.groupBy("bucket", "rn").agg(*[F.max(F.when(F.col("side") == s, F.col("lanes"))).alias(f"s{s}") for s in range(3)])

    def least(name: str) -> Column:
        return F.coalesce(F.zip_with(name, "s2", lambda x, y: F.least(x, y)), F.col(name), F.col("s2"))

    return sides.select("bucket", "rn", least("s0").alias("own"), F.when(F.col("s1").isNotNull() | F.col("s2").isNotNull(), least("s1")).alias("edit"))


def in_turn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_range: int = 1 << 23) -> DataFrame:
    """The documents by descending id, each beside its successor's text.

    Columns: bucket, rn (place in the bucket), ghost, doc, text, next_text. Ids are cut into
    ranges; a range is one window, and the first row of the next range (of the first one,
    for the last) is added behind it as a ghost, which has the next text but no successor.
    Equal ids go by descending text; if they fill several ranges, by a hash of their texts
    between these. A null id comes last, as the least long. A single row follows itself.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc", "text", bytes_per_range)
    rows = rows.withColumn("bucket", (F.lit(len(bounds)) - range_of(F.col("doc"), F.col("text"), bounds)).cast("int"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc", "text")).alias("head"))
    order = heads.select("bucket").groupBy().agg(F.sort_array(F.collect_list("bucket")).alias("all"))  # one number a range
    before = order.select(F.explode(F.transform("all", lambda x, i: F.struct(x.alias("bucket"), F.element_at("all", F.when(i == 0, -1).otherwise(i)).alias("prev")))).alias("p")).select("p.*")
    ghosts = heads.join(before, "bucket").select(F.col("head.doc").alias("doc"), F.col("head.text").alias("text"), F.col("prev").alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).select("doc", "text", "bucket", "ghost").unionByName(ghosts).repartitionById(len(bounds) + 1, F.col("bucket"))
    w = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("doc").desc(), F.col("text").desc())
    return both.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many, or all, of the other's."""
    half = F.floor(F.length(text) / F.lit(2)).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def edits_in_turn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES, bytes_per_range: int = 1 << 23) -> DataFrame:
    """Fingerprints of every text, its half-edited text and its successor's, and their likeness.

    Columns: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Nulls and ties as in :func:`in_turn` and :func:`fingerprints`.
    """
    rows = in_turn(docs, id_col, text_col, bytes_per_range)
    change = F.when(~F.col("ghost"), edited(F.col("text"), F.col("next_text")))
    meta = rows.where(~F.col("ghost")).select("bucket", "rn", "doc", F.length("text").cast("long").alias("n_chars"), F.sha2(change, 256).alias("edited_sha256"))
    # Both texts begin alike. Cut at the last space before the edit, each part's words are read once.
    flat = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    flat_next = F.replace(F.replace(F.replace("next_text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    halves = rows.select("bucket", "rn", "ghost", flat.alias("t"), flat_next.alias("o")).withColumn("half", F.floor(F.length("t") / F.lit(2)).cast("int"))
    halves = halves.withColumn("front", F.substring("t", F.lit(1), F.length("t") - F.col("half")))
    halves = halves.withColumn("edge", F.length("front") - F.length(F.substring_index("front", " ", -1)))  # ends in a space, or 0
    parts = halves.select(
        "bucket", "rn",
        F.explode(F.array(
            F.struct(F.when(~F.col("ghost") & (F.col("edge") > 0), F.substring("t", F.lit(1), F.col("edge") - 1)).alias("t"), F.lit(1).alias("own"), F.lit(1).alias("edit")),
            F.struct(F.when(F.col("ghost"), F.col("t")).otherwise(F.substring("t", F.col("edge") + 1, F.length("t"))).alias("t"), F.lit(1).alias("own"), F.lit(0).alias("edit")),
            F.struct(F.when(~F.col("ghost"), F.concat(F.substring("front", F.col("edge") + 1, F.length("front")), F.substring("o", F.lit(1), F.col("half")))).alias("t"), F.lit(0).alias("own"), F.lit(1).alias("edit")),
        )).alias("x"),
    ).where("x.t is not null")
    words = parts.select("bucket", "rn", "x.own", "x.edit", F.explode(F.split("x.t", " ")).alias("w")).select("bucket", "rn", "own", "edit", F.xxhash64("w").alias("term"))
    counts = words.groupBy("bucket", "rn", "term").agg(F.sum("own").alias("own"), F.sum("edit").alias("edit"))
    sides = F.when(F.col("own") == F.col("edit"), F.array(F.struct(F.lit(2).alias("side"), F.col("own").alias("n")))).otherwise(
        F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("own").alias("n")), F.struct(F.lit(1).alias("side"), F.col("edit").alias("n"))), lambda x: x["n"] > 0)
    )
    counted = counts.select("bucket", "rn", "term", F.explode(sides).alias("x")).select("bucket", "term", "x.n", (F.col("rn").cast("long") * 4 + F.col("x.side")).alias("at"))
    found = _merged_sides(counted, lanes)
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("rn"))
    paired = found.withColumn("after", after)  # the ghosts go with the join
    return meta.join(paired, ["bucket", "rn"]).select(
        F.when(F.col("doc") != F.lit(NO_ID), F.col("doc")).alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
