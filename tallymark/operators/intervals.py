"""Overlaps of intervals by bins: an equi-join on (keys, bin), without comparing all pairs.

Intervals are half open, [lo, hi). One side is cut at the bins' borders, so that each of its pieces lies in one bin and the pieces add up
to the whole; the other side is repeated for each bin that it touches, and keeps its own ends. Overlaps of pieces then
add up to those of whole intervals, and no pair of a piece and an interval is met twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def pieces(rows: DataFrame, lo: str, hi: str, width: int, bin_col: str = "bin") -> DataFrame:
    """Each interval cut at multiples of `width`: its pieces' ends in place of its own, and their bin; empty ones go."""
    met = rows.where(F.col(lo) < F.col(hi)).withColumn(bin_col, F.explode(F.sequence(_bin(F.col(lo), width), _bin(F.col(hi) - 1, width))))
    edge = F.col(bin_col) * width
    return met.withColumns({lo: F.greatest(F.col(lo), edge), hi: F.least(F.col(hi), edge + width)})


def touched(rows: DataFrame, lo: Column, hi: Column, width: int, bin_col: str = "bin") -> DataFrame:
    """A row for each bin that [lo, hi) touches; empty intervals touch none."""
    return rows.where(lo < hi).withColumn(bin_col, F.explode(F.sequence(_bin(lo, width), _bin(hi - 1, width))))


def overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """The length that two intervals share."""
    return F.greatest(F.lit(0), F.least(hi, other_hi) - F.greatest(lo, other_lo))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs of a point and each span [lo, hi) of the same keys that holds it: each span is there once for each bin that it touches.

    A span much longer than `width` costs a row for each bin, a bin with many points and spans their product: choose the
    width near the usual span's length.
    """
    dealt = touched(spans, F.col(lo), F.col(hi), width)
    met = points.withColumn("bin", _bin(F.col(at), width)).join(dealt, [*keys, "bin"])
    return met.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("bin")
