"""Boxes and bounds of options. A bubble's x and y are its centre; half sizes are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import col

PADDING = 10


def half(size) -> Column:
    return F.floor(col(size) / 2).cast("int")


def option_boxes(options: str, width, height, selected: str, dxs: str | None = None, dys: str | None = None) -> Column:
    """An array of (label, selected, x, y, width, height), each at its option's detected offset."""
    at = lambda offsets, i: F.coalesce(F.get(F.col(offsets), i), F.lit(0)) if offsets else F.lit(0)
    return F.transform(
        options,
        lambda o, i: F.struct(
            o["label"].alias("label"),
            F.array_contains(F.col(selected), o["label"]).alias("selected"),
            (o["x"] + at(dxs, i) - half(width)).alias("x"),
            (o["y"] + at(dys, i) - half(height)).alias("y"),
            col(width).cast("int").alias("width"),
            col(height).cast("int").alias("height"),
        ),
    )


def question_bounds(options: str, width, height, dxs: str | None = None, dys: str | None = None) -> Column:
    """The box around all options at their detected offsets; null without options."""
    at = lambda offsets, i: F.coalesce(F.get(F.col(offsets), i), F.lit(0)) if offsets else F.lit(0)
    xs, ys = F.transform(options, lambda o, i: o["x"] + at(dxs, i)), F.transform(options, lambda o, i: o["y"] + at(dys, i))
    x, y = F.array_min(xs) - half(width), F.array_min(ys) - half(height)
    return F.when(F.size(options) > 0, F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) + half(width) - x).alias("width"), (F.array_max(ys) + half(height) - y).alias("height")))


def snippet_bounds(options: str, width, height, padding: int = PADDING) -> Column:
    """The box to cut out for a question, from template positions, with room around it; its far corner is at least (0, 0)."""
    xs, ys = F.transform(options, lambda o: o["x"]), F.transform(options, lambda o: o["y"])
    x, y = F.array_min(xs) - half(width) - padding, F.array_min(ys) - half(height) - padding
    right, bottom = (F.greatest(F.lit(0), F.array_max(v) + half(s)) + padding for v, s in ((xs, width), (ys, height)))
    return F.when(F.size(options) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height")))
