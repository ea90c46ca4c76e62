"""From fill ratios to answers, in array expressions.

A row is a question: its options' fill ratios in order. The largest gap between sorted fills splits marked from
unmarked; the unmarked ones' mean is the baseline; what lies above the split is selected; confidence tells how far
the weakest selected option stands above the strongest other. Everything works on a row's own arrays, so nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Single-choice rows look for the gap among so many of their highest fills.
PLAUSIBLE_MARKS = 4
#: With a baseline above this every option counts as filled, and those from FILLED on are selected.
ALL_FILLED, FILLED = 0.75, 0.5
# Defaults of the configuration
FILL_THRESHOLD, SELECTION_THRESHOLD, BUBBLE_INSET, FLAG_THRESHOLD, LABEL_INSET = 0.25, 0.25, 0.75, 0.5, 0.4


def unbiased(fills: str, bias: str) -> Column:
    """Fills less each option's own bias."""
    return F.zip_with(fills, bias, lambda f, b: f - F.coalesce(b, F.lit(0.0)))


def split_rows(df: DataFrame, fills: str = "fills", kind: str = "type") -> DataFrame:
    """Adds `sorted`, `gap` (the largest) and `split` (the fill below it)."""
    n = F.size("_sorted")
    first = F.when(F.col(kind) == "multi", F.lit(1)).otherwise(F.greatest(F.lit(1), n - F.least(F.lit(PLAUSIBLE_MARKS), n) + 1))
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k >= first)
    step = lambda k: F.get(F.col("_sorted"), k) - F.get(F.col("_sorted"), k - 1)
    start = F.struct(F.lit(0.0).alias("gap"), F.get(F.col("_sorted"), n - 1).alias("split"))
    wider = lambda a, k: F.when(step(k) > a["gap"], F.struct(step(k).alias("gap"), F.get(F.col("_sorted"), k - 1).alias("split"))).otherwise(a)
    return df.withColumn("_sorted", F.array_sort(fills)).withColumn("_cut", F.aggregate(at, start, wider)).withColumns({"gap": F.col("_cut.gap"), "split": F.col("_cut.split")}).withColumnRenamed("_sorted", "sorted").drop("_cut")


def baseline_rows(df: DataFrame, fills: str = "fills") -> DataFrame:
    """Adds `all_filled`, `baseline` and `adjusted` to split rows. Sums run in the options' order."""
    low = F.filter(fills, lambda f: f <= F.col("split"))
    mean = F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, f: a + f), F.size(low))
    df = df.withColumn("_mean", mean).withColumn("all_filled", F.coalesce(F.col("_mean") > ALL_FILLED, F.lit(False)))
    df = df.withColumn("baseline", F.when(F.col("all_filled"), 0.0).otherwise(F.col("_mean"))).drop("_mean")
    return df.withColumn("adjusted", F.transform(fills, lambda f: f - F.col("baseline")))


def selected_rows(df: DataFrame, labels: str = "labels", threshold: Column | float = SELECTION_THRESHOLD) -> DataFrame:
    """Adds `chosen` (a flag for each option) and `selected` (labels in order)."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    above = F.col("split") - F.col("baseline")
    chosen = F.transform("adjusted", lambda a: (~F.col("all_filled") & (F.col("gap") >= threshold) & (a > above)) | (F.col("all_filled") & (a >= FILLED)))
    df = df.withColumn("chosen", chosen)
    return df.withColumn("selected", F.filter(labels, lambda _, i: F.get(F.col("chosen"), i)))


def confident_rows(df: DataFrame) -> DataFrame:
    """Adds `confidence`, in [0, 1], to selected rows; 0 without options."""
    taken = F.filter("adjusted", lambda _, i: F.get(F.col("chosen"), i))
    rest = F.filter("adjusted", lambda _, i: ~F.get(F.col("chosen"), i))
    zero = F.lit(0.0)
    high = F.greatest(zero, F.coalesce(F.array_max("adjusted"), zero))
    other = F.greatest(zero, F.coalesce(F.array_max(rest), zero))
    least, top = F.array_min(taken), F.array_max("sorted") - F.col("baseline")
    raw = F.when(F.size("selected") == 0, 1 - high).when(F.col("all_filled"), least).otherwise(F.try_divide(least - other, top))
    return df.withColumn("confidence", F.when(F.size("adjusted") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(zero, raw))))


def flagged_rows(df: DataFrame, threshold: Column | float = FLAG_THRESHOLD, id_col: str = "question_id", kind: str = "type") -> DataFrame:
    """Adds `flag`: little confidence, a blank question of the Q kind, or several answers where one is asked for."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    n = F.size("selected")
    blank = (n == 0) & F.coalesce(F.col(id_col).startswith("Q"), F.lit(False))
    return df.withColumn("flag", (F.col("confidence") < threshold) | blank | (~F.coalesce(F.col(kind) == "multi", F.lit(False)) & (n > 1)))


def mark(df: DataFrame, fills: str = "fills", labels: str = "labels", kind: str = "type", id_col: str = "question_id", bias: str | None = None, selection_threshold: Column | float = SELECTION_THRESHOLD, flag_threshold: Column | float = FLAG_THRESHOLD) -> DataFrame:
    """Questions with their fills to answers: selected, confidence, flag, and the steps on the way."""
    if bias:
        df = df.withColumn(fills, unbiased(fills, bias))
    df = baseline_rows(split_rows(df, fills, kind), fills)
    return flagged_rows(confident_rows(selected_rows(df, labels, selection_threshold)), flag_threshold, id_col, kind)


def gaps_by_window(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The same largest gap for fills that stand in rows of their own: (key, gap, split, n)."""
    order = Window.partitionBy(key).orderBy(value, tie)
    steps = df.select(key, F.col(value).alias("v"), F.lag(value).over(order).alias("before"), F.row_number().over(order).alias("k"))
    best = F.max(F.struct(F.coalesce(F.col("v") - F.col("before"), F.lit(0.0)).alias("gap"), (-F.col("k")).alias("k"), F.coalesce("before", "v").alias("split"))).alias("best")
    out = steps.groupBy(key).agg(best, F.max("v").alias("top"), F.count("*").alias("n"))
    return out.select(key, F.col("best.gap").alias("gap"), F.when(F.col("best.gap") > 0, F.col("best.split")).otherwise(F.col("top")).alias("split"), "n")
