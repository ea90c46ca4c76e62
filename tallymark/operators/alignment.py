"""Where a row of bubbles sits: the offset whose fills have the largest gap.

Candidates are rows (key, dx, dy, fills, guards), with the ring fills and the guard-disk fills of the options there.
One aggregation finds each key's offset; partial maxima combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A ring fill below this is off the bubble, and its offset is no candidate.
OFF_BUBBLE = 0.05
#: Mean guard fill from which an even row counts as inked throughout.
INKED = 0.5


def largest_gap(fills) -> Column:
    ordered = F.array_sort(fills)
    return F.aggregate(F.zip_with(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda b, a: b - a), F.lit(0.0), lambda a, g: F.greatest(a, g))


def best_offsets(candidates: DataFrame, keys: list[str], threshold: Column | float, fills: str = "fills", guards: str = "guards") -> DataFrame:
    """(keys, dx, dy): ties go to the centre, then to the first by dy and dx.

    Where the best gap is under the threshold the row is even: the offset with the most ink under the guard disks
    counts if its mean is above INKED, else the row stays where it is.
    """
    centre = (F.col("dx") == 0) & (F.col("dy") == 0)
    valid = F.forall(fills, lambda f: f >= OFF_BUBBLE) & (F.size(fills) > 0)
    guard_sum = F.aggregate(guards, F.lit(0.0), lambda a, g: a + g)
    place = F.struct(centre.cast("int").alias("c"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"))
    rated = candidates.select(*keys, F.when(valid, F.struct(largest_gap(fills).alias("gap"), place.alias("p"))).alias("g"), F.struct(guard_sum.alias("sum"), place.alias("p")).alias("s"), F.size(fills).alias("n"))
    best = rated.groupBy(*keys).agg(F.max("g").alias("g"), F.max("s").alias("s"), F.max("n").alias("n"))
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    even = F.coalesce(F.col("g.gap") < threshold, threshold > 0)
    inked = F.col("s.sum") / F.col("n") > INKED
    pick = lambda axis: F.when(~even, -F.col(f"g.p.{axis}")).when(inked, -F.col(f"s.p.{axis}")).otherwise(0)
    return best.select(*keys, pick("x").alias("dx"), pick("y").alias("dy"))


def option_group(index, group_size) -> Column:
    """The alignment group of an option: contiguous groups of a size, or one where the size is 0 or covers the row."""
    return F.when(F.col(group_size) > 0, F.floor(F.col(index) / F.col(group_size))).otherwise(0).cast("int") if isinstance(group_size, str) else F.floor(F.col(index) / F.lit(group_size)).cast("int") if group_size > 0 else F.lit(0)


def row_offsets(n: str, group_size: str, radius: str, group_radius: str) -> Column:
    """Per option (group, radius): rows of more options than a group are aligned in groups with their own radius."""
    grouped = (F.col(group_size) > 0) & (F.col(group_size) < F.col(n))
    one = lambda i: F.struct(i.alias("option"), F.when(grouped, F.floor(i / F.col(group_size))).otherwise(0).cast("int").alias("group"), F.when(grouped, F.col(group_radius)).otherwise(F.col(radius)).cast("int").alias("radius"))
    return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n).cast("int") - 1), one)).otherwise(F.array())
