"""What an editor does with blocks of text: joining them, putting the result in place, new ones, the cursor."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.layout import ABOVE, PAGE, WORD_GAP, bounding_box

MERGE = [*PAGE, "merge_id"]

#: Blocks count as one row of the page up to this difference of their tops; a new block's size in font sizes.
ROW_TOLERANCE = 2.0
NEW_WIDTH, NEW_HEIGHT = 10.0, 1.2

_LOOK = ["x", "y", "width", "font_size", "font_name", "fill_color", "op_idx"]


def _permutation(xs: list[float], ys: list[float]) -> list[int]:
    """Places in reading order. Tops within the tolerance are one row, which is no total order: the order given decides then."""

    def compare(i: int, j: int) -> float:
        down = ys[i] - ys[j]
        return down if abs(down) > ROW_TOLERANCE else xs[i] - xs[j]

    return sorted(range(len(xs)), key=cmp_to_key(compare))


def _parts(blocks: DataFrame, selected: DataFrame) -> DataFrame:
    """The blocks of each merge in reading order: file_id, page_idx, merge_id, block_idx, at. Only boxes travel to Python."""

    @F.pandas_udf("array<int>")
    def reading(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_permutation(list(x), list(y)) for x, y in zip(xs, ys, strict=True)])

    once = selected.groupBy(*MERGE, "block_idx").agg(F.min("place").alias("place"))
    boxes = once.join(blocks.select(*PAGE, "block_idx", "x0", "y0"), [*PAGE, "block_idx"])
    items = F.array_sort(F.collect_list(F.struct("place", "block_idx", F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"))))
    merges = boxes.groupBy(*MERGE).agg(items.alias("items")).where(F.size("items") > 1)
    merges = merges.withColumn("order", reading(F.col("items")["x0"], F.col("items")["y0"]))
    return merges.select(*MERGE, "items", F.posexplode("order").alias("at", "__i")).select(*MERGE, F.col("items")[F.col("__i")]["block_idx"].alias("block_idx"), "at")


def merged_chars(blocks: DataFrame, chars: DataFrame, selected: DataFrame) -> DataFrame:
    """The chars of each merge, with a space between blocks: adds merge_id, seq (from 0) and synthetic.

    ``blocks``: file_id, page_idx, block_idx, x0, y0. ``chars``: as :func:`foliant.operators.layout.block_chars`.
    ``selected``: file_id, page_idx, merge_id, block_idx, place (order of selection). A repeated row counts
    once, an unknown block not at all, and a merge of fewer than two blocks is none. A space stands behind
    the char before it and looks like it; blocks without chars have a space too, unless nothing precedes.
    A block may be part of several merges. Null coordinates order as 0. Without rows there are none.
    """
    parts = _parts(blocks, selected)
    ends = chars.groupBy(*PAGE, "block_idx").agg(F.max_by(F.struct(*_LOOK), "seq").alias("__end"))
    earlier = Window.partitionBy(*MERGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ended = parts.join(ends, [*PAGE, "block_idx"], "left")
    ended = ended.withColumn("__last", F.last("__end", ignorenulls=True).over(earlier)).withColumn("__of", F.last(F.when(F.col("__end").isNotNull(), F.col("at")), ignorenulls=True).over(earlier))
    last, gap = F.col("__last"), F.col("__last")["font_size"] * WORD_GAP
    shown = {c: last[c] for c in _LOOK} | {"x": last["x"] + last["width"] + (F.col("at") - F.col("__of") - 1) * gap, "width": gap}
    spaces = ended.where("__last is not null").select(*MERGE, "at", F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__seq"), F.lit(" ").alias("char"), *[v.alias(c) for c, v in shown.items()], F.lit(True).alias("synthetic"))
    own = parts.join(chars.select(*PAGE, "block_idx", "seq", "char", *_LOOK), [*PAGE, "block_idx"])
    own = own.select(*MERGE, "at", F.lit(1).alias("__kind"), F.col("seq").cast("bigint").alias("__seq"), "char", *_LOOK, F.lit(False).alias("synthetic"))
    place = F.row_number().over(Window.partitionBy(*MERGE).orderBy("at", "__kind", "__seq")).cast("bigint") - 1
    return own.unionByName(spaces).withColumn("seq", place).select(*MERGE, "seq", "char", *_LOOK, "synthetic")


def merged_blocks(blocks: DataFrame, chars: DataFrame, selected: DataFrame) -> DataFrame:
    """One block for each merge of :func:`merged_chars`: text, box, op_indices (without spaces' own), look of its first real char.

    op_indices are what an edit of the new block takes (:func:`foliant.sources.documents.revised`). A
    merge of blocks without any char has an empty text, a box of zeros, no font and black.
    """
    found = merged_chars(blocks, chars, selected)
    real = ~F.col("synthetic")
    first = lambda c: F.min_by(c, F.when(real, F.col("seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "char"))), lambda x: x["char"]), "")
    box = bounding_box(F.col("x"), F.col("y"), F.col("width"), F.col("font_size"))
    made = found.groupBy(*MERGE).agg(
        text.alias("text"), *[c.alias(n) for n, c in box.items()], first("font_name").alias("font_name"), first("font_size").alias("font_size"), first("fill_color").alias("color"),
        F.array_sort(F.collect_set(F.when(real, F.col("op_idx")))).alias("op_indices"), F.count("*").alias("n_chars"),
    )
    zero, empty = F.lit(0.0), F.array().cast("array<int>")
    made = _parts(blocks, selected).select(*MERGE).distinct().join(made, MERGE, "left")
    return made.select(
        *MERGE, F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, zero).alias(c) for c in ("x0", "x1", "y0", "y1")], F.coalesce("font_name", F.lit("")).alias("font_name"),
        F.coalesce("font_size", zero).alias("font_size"), F.coalesce("color", F.array(zero, zero, zero)).alias("color"), F.coalesce("op_indices", empty).alias("op_indices"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
    )


def with_merges(blocks: DataFrame, chars: DataFrame, selected: DataFrame) -> DataFrame:
    """The blocks of each page with merges in place of what they were made from, numbered anew.

    ``blocks``: as :func:`foliant.operators.layout.text_blocks`. A merge comes before the first block that lies lower, or
    in the same row further right; else last. Merges of a page are placed at once against the blocks that
    stay, in order of merge_id where they meet. They take the next free ids; other ids stay.
    """
    merged = merged_blocks(blocks, chars, selected)
    gone = _parts(blocks, selected).select(*PAGE, "block_idx").distinct()
    free = blocks.groupBy(*PAGE).agg((F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")) + 1).alias("__free"))
    look = ["text", "x0", "x1", "y0", "y1", "font_name", "font_size", "color", "op_indices", "n_chars"]
    stay = blocks.withColumn("op_indices", F.array("op_idx")).join(gone, [*PAGE, "block_idx"], "left_anti")
    other = stay.select(*PAGE, F.col("block_idx").alias("__at"), F.col("x0").alias("__x"), F.col("y0").alias("__y"))
    down = F.col("__y") - F.col("y0")
    behind = (down > 0) | ((F.abs(down) < ROW_TOLERANCE) & (F.col("__x") > F.col("x0")))
    spots = merged.select(*MERGE, "x0", "y0").join(other, PAGE).where(behind).groupBy(*MERGE).agg(F.min("__at").alias("__at"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("merge_id")) - 1
    new = merged.join(spots, MERGE, "left").join(free, PAGE).withColumn("id", F.concat(F.lit("tb_"), (F.col("__free") + rank).cast("string")))
    rows = new.select(*PAGE, F.coalesce("__at", F.lit(2**31 - 1)).alias("__at"), F.lit(0).alias("__new"), "merge_id", "id", *look)
    rows = rows.unionByName(stay.select(*PAGE, F.col("block_idx").alias("__at"), F.lit(1).alias("__new"), "id", *look), allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("__at", "__new", "merge_id")) - 1
    return rows.withColumn("block_idx", at.cast("int")).select(*PAGE, "block_idx", "id", "merge_id", *look)


def empty_blocks(clicks: DataFrame) -> DataFrame:
    """A block without chars for each click (file_id, page_idx, x, y of the baseline, font_size, font_name): its box, black, is_new."""
    size, top = F.col("font_size"), F.col("y") - F.lit(ABOVE) * F.col("font_size")
    return clicks.select(
        *PAGE, F.lit("").alias("text"), F.col("x").alias("x0"), (F.col("x") + size * NEW_WIDTH).alias("x1"), top.alias("y0"), (top + size * NEW_HEIGHT).alias("y1"),
        "font_name", "font_size", F.array(*[F.lit(0.0)] * 3).alias("color"), F.lit(0).cast("bigint").alias("n_chars"), F.lit(True).alias("is_new"),
    )


def cursors(points: DataFrame, chars: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Each point (key, the block's keys, x, y) with ``cursor``: the place in its block's text that it is nearest to.

    The char whose centre is nearest counts, of equal ones the first; right of its centre the cursor
    stands behind it. A block without chars, an unknown one and a point without coordinates have 0.
    """
    held = chars.select(*keys, F.col("seq").alias("__seq"), (F.col("x") + F.col("width") / 2).alias("__cx"), (F.col("y") + F.col("font_size") / 2).alias("__cy"))
    dx, dy = F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")
    away = F.sqrt(dx * dx + dy * dy)
    nearest = F.min_by(F.struct("__seq", "__cx"), F.when(away.isNotNull(), F.struct(away, F.col("__seq")))).alias("__near")
    found = points.select(key, *keys, "x", "y").join(held, keys).groupBy(key).agg(nearest)
    past = F.coalesce(F.col("x") > F.col("__near")["__cx"], F.lit(False)).cast("bigint")
    return points.join(found, key, "left").withColumn("cursor", F.coalesce(F.col("__near")["__seq"] + past, F.lit(0)).cast("bigint")).drop("__near")
