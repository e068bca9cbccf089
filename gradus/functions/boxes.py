"""Boxes as struct(x0, y0, x1, y1) of page shares, from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.metrics import clamp01, let


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def normalize(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, bottom_left: bool = False) -> Column:
    """Corners by page size, sorted, turned upside down for sources that count from the bottom, and cut to the page; null for a page without size."""

    def body(v):
        top, low = (v["t"], v["b"]) if not bottom_left else (1 - v["b"], 1 - v["t"])
        return box(clamp01(v["l"]), clamp01(top), clamp01(v["r"]), clamp01(low))

    shares = let(body, l=F.least(x0, x1) / width, r=F.greatest(x0, x1) / width, t=F.least(y0, y1) / height, b=F.greatest(y0, y1) / height)
    return F.when((width > 0) & (height > 0), shares)


def of_points(points: Column, width: Column, height: Column, bottom_left: bool = False) -> Column:
    """Box of a polygon, an array of struct(x, y); null of none."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, normalize(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y), width, height, bottom_left))


def union(column: str) -> Column:
    """Aggregate: the smallest box around all boxes of a group; null if there is none."""
    b = F.col(column)
    return F.when(F.count(b) > 0, box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])))


def intersection(a: Column, b: Column) -> Column:
    """The box that both share; null if none has an area."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def extends(region: Column, anchor: Column, part: Column) -> Column:
    """Whether a part holds some of the region outside the anchor."""
    return F.coalesce(let(lambda v: v["i"].isNotNull() & ~contains(v["a"], v["i"]), i=intersection(region, part), a=anchor), F.lit(False))


def centre(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def reading_key(b: Column, fallback: Column) -> Column:
    """Sort key of boxes from top to bottom, then left to right; those without a box last."""
    return F.struct(F.coalesce(b["y0"], F.lit(10.0)), F.coalesce(b["x0"], F.lit(10.0)), fallback)
