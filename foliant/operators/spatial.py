"""Spatial predicates: first hit, nearest, edges, clamping, affine boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(points: DataFrame, boxes: DataFrame, key: str, order: list[str], cell: float) -> DataFrame:
    """Each point with the first box (in order) that holds it, bounds included.

    ``points``: key, x, y. ``boxes``: id, x0, y0, x1, y1 and the order columns. Boxes are dealt
    to the grid cells they touch, so the join is an equality and not a nested loop.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    dealt = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    hits = at.join(dealt, ["cx", "cy"]).where(inside).groupBy(key).agg(F.min_by("id", F.struct(*order)).alias("hit"))
    return points.join(hits, key, "left")


def edge(x: Column, y: Column, width: Column, height: Column, tolerance: float = 6.0) -> Column:
    """The edge of a box at the origin that a point is near: right, bottom, left, top, else null."""
    near_x, near_y = (y >= -tolerance) & (y <= height + tolerance), (x >= -tolerance) & (x <= width + tolerance)
    return (
        F.when((F.abs(x - width) <= tolerance) & near_x, "right").when((F.abs(y - height) <= tolerance) & near_y, "bottom")
        .when((F.abs(x) <= tolerance) & near_x, "left").when((F.abs(y) <= tolerance) & near_y, "top")
    )


def clamped(value: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(value, most))


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """The product of two affine matrices [a b c d e f]."""
    return [
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    ]


def unit_square_box(m: list[Column]) -> tuple[Column, Column, Column, Column]:
    """The box around the unit square under a matrix: least x and y, greatest x and y."""
    xs = [m[4], m[0] + m[4], m[2] + m[4], m[0] + m[2] + m[4]]
    ys = [m[5], m[1] + m[5], m[3] + m[5], m[1] + m[3] + m[5]]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def flipped(x: Column, y: Column, page_height: Column, scale: Column) -> tuple[Column, Column]:
    """Between bottom-left and top-left origin."""
    return x * scale, (page_height - y) * scale


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return (1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k)
