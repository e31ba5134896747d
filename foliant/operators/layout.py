"""From glyphs to lines and blocks of text: windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_blank
from foliant.operators.relational import before, islands

#: Thresholds in font sizes, and the share of a font size above and below the baseline.
WORD_GAP, LINE_GAP, BLOCK_GAP = 0.3, 0.5, 1.5
ABOVE, BELOW = 0.85, 0.15


def advance(width: Column, size: Column, char_space: Column, word_space: Column, scale: Column) -> Column:
    """How far a glyph moves the text position."""
    return (width / 1000 * size + char_space + word_space) * scale


def with_gaps(df: DataFrame, gap: Column) -> DataFrame:
    """Each row once as ``char``, and before it a ``space`` where there is a gap; adds kind."""
    return df.withColumn("__gap", gap).withColumn("kind", F.explode(F.when(F.col("__gap"), F.array(F.lit("space"), F.lit("char"))).otherwise(F.array(F.lit("char"))))).drop("__gap")


def two_level(df: DataFrame, keys: list[str], order: list[str], value: str, line_gap: float, block_share: float) -> DataFrame:
    """Lines of close values, then blocks of lines whose tops lie within a share of the line height before; adds line, block."""
    far = F.abs(F.col(value) - before(value, keys, order)) > line_gap
    lined = islands(df, keys, order, far, "line")
    lines = lined.groupBy(*keys, "line").agg(F.min(value).alias("top"), F.max(value).alias("height"))
    apart = F.abs(F.col("top") - before("top", keys, ["line"])) > before("height", keys, ["line"]) * block_share
    return lined.join(islands(lines, keys, ["line"], apart, "block").select(*keys, "line", "block"), [*keys, "line"])


def bounding_box(x: Column, y: Column, width: Column, size: Column) -> dict[str, Column]:
    """Aggregates of the box around glyphs, y downward."""
    return {"x0": F.min(x), "x1": F.max(x + width), "y0": F.min(y - F.lit(ABOVE) * size), "y1": F.max(y + F.lit(BELOW) * size)}


PAGE = ["file_id", "page_idx"]


def placed(glyphs: DataFrame, pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """Glyphs with top-left coordinates at a scale. ``pages``: file_id, page_idx, height."""
    sized = glyphs.join(pages.select(*PAGE, F.col("height").alias("__h")), PAGE)
    return sized.withColumn("y", (F.col("__h") - F.col("y")) * scale).withColumn("x", F.col("x") * scale).withColumn("width", F.col("width") * scale).withColumn("font_size", F.col("font_size") * scale).drop("__h")


def grouped(chars: DataFrame, word: float = WORD_GAP, line: float = LINE_GAP, block: float = BLOCK_GAP) -> DataFrame:
    """Placed chars with reading order, line and block numbers.

    Adds seq (place in reading order), line, block, gap (whether a space belongs before the
    char). A char starts a line if it is further from the one before it than ``line`` font
    sizes, a line starts a block if its top is further from the last than ``block`` heights.
    Sizes of zero or less count as 1. Equal positions keep the order of the glyphs.
    """
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "char_seq")
    rows = chars.withColumn("seq", F.row_number().over(w).cast("bigint") - 1)
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(1.0)
    rows = rows.withColumn("__s", size)
    near = F.abs(F.col("y") - before("y", PAGE, ["seq"])) <= before("__s", PAGE, ["seq"]) * line
    after = F.col("x") - (before("x", PAGE, ["seq"]) + before("width", PAGE, ["seq"]))
    rows = rows.withColumn("gap", F.coalesce(near & (after > before("__s", PAGE, ["seq"]) * word), F.lit(False)))
    rows = islands(rows, PAGE, ["seq"], F.abs(F.col("y") - before("y", PAGE, ["seq"])) > before("__s", PAGE, ["seq"]) * line, "line")
    lines = rows.groupBy(*PAGE, "line").agg(F.min("y").alias("top"), F.max("font_size").alias("tall")).withColumn("tall", F.when(F.col("tall") > 0, F.col("tall")).otherwise(1.0))
    apart = F.abs(F.col("top") - before("top", PAGE, ["line"])) > before("tall", PAGE, ["line"]) * block
    return rows.drop("__s").join(islands(lines, PAGE, ["line"], apart, "block").select(*PAGE, "line", "block"), [*PAGE, "line"])


def text_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of :func:`grouped` chars, split by the operator that drew them.

    file_id, page_idx, block_idx, id, op_idx, text, x0, x1, y0, y1, font_name, font_size,
    color, n_chars. The first char gives font and colour. Blocks without visible text are
    dropped; numbers follow block order, then first appearance.
    """
    return _numbered(rows).select(
        *PAGE, "block_idx", F.concat(F.lit("tb_"), F.col("block_idx").cast("string")).alias("id"), "op_idx", "text", "x0", "x1", "y0", "y1", "font_name", "font_size", F.col("fill_color").alias("color"), "n_chars"
    )


def _numbered(rows: DataFrame) -> DataFrame:
    chars = F.array_sort(F.collect_list(F.struct("seq", "char")))
    first = lambda c: F.min_by(c, "seq").alias(c)
    found = rows.groupBy(*PAGE, "block", "op_idx").agg(
        F.min("seq").alias("first"), F.array_join(F.transform(chars, lambda x: x["char"]), "").alias("text"), F.count("*").alias("n_chars"),
        *[c.alias(n) for n, c in bounding_box(F.col("x"), F.col("y"), F.col("width"), F.col("font_size")).items()], first("font_name"), first("font_size"), first("fill_color"),
    )
    found = found.where(~is_blank(F.col("text")))
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block", "first")) - 1
    return found.withColumn("block_idx", at.cast("int"))


def block_chars(rows: DataFrame) -> DataFrame:
    """The chars of each block of :func:`text_blocks`, numbered in it from 0 (seq); chars of dropped blocks are left out."""
    numbers = _numbered(rows).select(*PAGE, "block", "op_idx", "block_idx")
    place = F.row_number().over(Window.partitionBy(*PAGE, "block_idx").orderBy("__seq")).cast("bigint") - 1
    found = rows.withColumnRenamed("seq", "__seq").join(numbers, [*PAGE, "block", "op_idx"]).withColumn("seq", place)
    return found.select(*PAGE, "block_idx", "seq", "char", "x", "y", "width", "font_size", "font_name", "fill_color", "op_idx")


def words(rows: DataFrame) -> DataFrame:
    """file_id, page_idx, line, text: lines with a space at each gap, where words are told apart only by position."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.when(F.col("gap"), " ").otherwise(""), "char").alias("c"))))
    return rows.groupBy(*PAGE, "line").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("text"))
