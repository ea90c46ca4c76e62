"""Mixing sources to target weights.

Sizes are summed per source; weights share the whole by water filling, with no source above
`limit` times its own size. A source's repetition rate is target / size. Each document is then
emitted floor(rate) times, plus one more when a hash of its id, as a number in [0, 1), is below
the fraction: reruns agree, and no document sees another.

So that sources of few documents meet their targets too, the number that draws are held against is not the fraction itself
but, of BUCKETS even steps, the one at which the documents drawn hold the fraction of their words as nearly as can be. That is
found for each source's large documents first (those whose size has more binary digits than its mean) and then for the
small ones, which mend what the large ones are off. Draws stay seeded by the id alone, and over all seeds a document's extra copy
has the fraction's probability, but for that rounding; a source misses its target by half a small document or by a
step of its small documents, or by half a large one where the small ones are too few to mend it.

Defined results: null texts and empty texts have size 0 and still get copies by their source's rate
(0 for a source without words); a null source is a source of its own, ordered last; a null id is hashed
as the word null; repeated rows fare alike; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

WEIGHTS = (1, 2, 3)
#: Steps of the threshold of small documents.
BUCKETS = 1024


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: float = 3.0) -> DataFrame:
    """One row per source, as (source, source_size, ...), with its target.

    A source is at its limit when limit * size / weight lies under the common level (what is left,
    per unit of weight left). Ordered by that ratio, the sources at their limit come first, so the
    level is one pass of running sums. The frame has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(limit)).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    # the level that the first source below its limit meets holds for all after it
    shared = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(everything)["level"]
    return leveled.select(*sizes.columns, F.least(F.col("cap"), F.coalesce(F.col("w") * shared, F.col("cap"))).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the key."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def source_rates(slim: DataFrame, weights: tuple, limit: float) -> DataFrame:
    """(source, source_size, target, whole, small, low_step, high_step) from (source, size, u) of the documents.

    Draws of documents of up to `small` binary digits are held against low_step, the others' against high_step.
    """
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(limit), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    mean = F.floor(F.col("source_size") / F.col("n")).cast("long")
    # written first, so that its size is known: Spark broadcasts it while it is small, and shuffles beyond
    rates = cut(source_targets(sums, weights, limit).withColumn("rate", rate).withColumn("whole", F.floor("rate")).select("source", "source_size", "target", "whole", (F.col("rate") - F.col("whole")).alias("fraction"), digits(mean).alias("small")), "rates")
    same = F.col("source").eqNullSafe(F.col("of"))
    drawn = slim.join(rates.select(F.col("source").alias("of"), "small"), same)
    steps = drawn.groupBy("source", (digits(F.col("size")) <= F.col("small")).alias("low"), (step(F.col("u")) + 1).alias("step")).agg(F.sum("size").alias("s"))
    none = rates.select("source", F.explode(F.array(F.lit(False), F.lit(True))).alias("low"), F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("s"))
    part = Window.partitionBy("of", "low")  # at most BUCKETS + 1 rows
    summed = steps.unionByName(none).withColumnRenamed("source", "of").select("of", "low", "step", F.sum("s").over(part.orderBy("step")).alias("taken"), F.sum("s").over(part).alias("mass"))

    def nearest(rates: DataFrame, low: bool, wanted: Column) -> DataFrame:
        best = rates.join(summed.where(F.col("low") == low), same).groupBy("of").agg(F.min(F.struct(F.when(F.col("fraction") > 0, F.abs(F.col("taken") - wanted)).otherwise(0.0), "step", "taken")).alias("b"))
        return rates.join(best, same).drop("of")

    high = nearest(rates, False, F.col("fraction") * F.col("mass")).select(*rates.columns, F.col("b.step").alias("high_step"), F.col("b.taken").alias("high_taken"))
    both = nearest(cut(high, "high"), True, F.col("target") - F.col("whole") * F.col("source_size") - F.col("high_taken"))
    return cut(both.select("source", "source_size", "target", "whole", "small", F.col("b.step").alias("low_step"), "high_step"), "steps")


def digits(n: Column) -> Column:
    """Binary digits of a whole number."""
    return F.length(F.bin(n))


def step(u: Column) -> Column:
    return F.floor(u * BUCKETS)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, limit: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with (size, source_size, target, copies) beside their own columns."""
    size, source_size, target, copies, of, own, u = (fresh(docs, c) for c in ("size", "source_size", "target", "copies", "_of", "_own", "_u"))
    slim = cut(docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw(F.col(id_col), seed).alias("u")), "sizes")
    rates = source_rates(slim, weights, limit)
    found = rates.select(F.col("source").alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target), F.struct("whole", "small", "low_step", "high_step").alias(own))
    joined = docs.withColumn(size, n_words(text_col)).withColumn(u, draw(F.col(id_col), seed)).join(found, F.col(source_col).eqNullSafe(F.col(of)), "left")
    rate = F.col(own)
    again = step(F.col(u)) < F.when(digits(F.col(size)) <= rate["small"], rate["low_step"]).otherwise(rate["high_step"])
    return joined.withColumn(copies, (rate["whole"] + again.cast("long")).cast("int")).drop(of, own, u)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of `docs`."""
    mixed = mix(docs, **options)
    copies = next(c for c in reversed(mixed.columns))
    return mixed.withColumn(copies, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies))))).select(*docs.columns)


def plan(docs: DataFrame, weights: tuple = WEIGHTS, limit: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, copies) of each document, as `mix` has them; texts are read once, for their sizes."""
    slim = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw(F.col(id_col), seed).alias("u")), "sizes")
    rates = source_rates(slim.select("source", "size", "u"), weights, limit).withColumnRenamed("source", "of")
    met = slim.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    again = step(F.col("u")) < F.when(digits(F.col("size")) <= F.col("small"), F.col("low_step")).otherwise(F.col("high_step"))
    return met.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + again.cast("long")).cast("int").alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    planned = plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: Mixing of a CTE named `docs`, for whole statements and for the pipeline's.
MIX_CTES = r"""
sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/mix'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM docs
),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
ranked AS (SELECT *, source_size * 3.0::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sums),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM sums)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER b, 0)) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
  FROM ranked WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shared AS (SELECT arg_min(level, place) FILTER (WHERE cap / w >= level) AS level FROM leveled),
targets AS (SELECT source, source_size, n, least(cap, coalesce(w * (SELECT level FROM shared), cap)) AS target FROM leveled),
rates AS (
  SELECT source, source_size, target, floor(rate) AS whole, rate - floor(rate) AS fraction, length(bin(source_size // n)) AS small
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0 END AS rate FROM targets)
),
rated AS (
  SELECT sized.*, source_size, target, whole, length(bin(size)) <= small AS low, CAST(floor(u * 1024) AS BIGINT) AS step
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
),
steps AS (
  SELECT source, low, step, sum(s) AS s
  FROM (SELECT source, low, step + 1 AS step, size AS s FROM rated UNION ALL SELECT source, unnest([true, false]), 0, 0 FROM rates) GROUP BY source, low, step
),
summed AS (SELECT source, low, step, CAST(sum(s) OVER (PARTITION BY source, low ORDER BY step) AS BIGINT) AS taken, CAST(sum(s) OVER (PARTITION BY source, low) AS BIGINT) AS mass FROM steps),
high AS (
  SELECT r.source, arg_min(step, (CASE WHEN fraction > 0 THEN abs(taken - fraction * mass) ELSE 0.0 END, step)) AS step,
         arg_min(taken, (CASE WHEN fraction > 0 THEN abs(taken - fraction * mass) ELSE 0.0 END, step)) AS taken
  FROM rates r JOIN summed s ON r.source IS NOT DISTINCT FROM s.source WHERE NOT low GROUP BY r.source
),
best AS (
  SELECT r.source, any_value(h.step) AS high_step, arg_min(s.step, (CASE WHEN fraction > 0 THEN abs(s.taken - (target - whole * source_size - h.taken)) ELSE 0.0 END, s.step)) AS low_step
  FROM rates r JOIN summed s ON r.source IS NOT DISTINCT FROM s.source JOIN high h ON r.source IS NOT DISTINCT FROM h.source WHERE s.low GROUP BY r.source
),
mixed AS (
  SELECT rated.*, CAST(whole + CASE WHEN step < CASE WHEN low THEN low_step ELSE high_step END THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM rated JOIN best ON rated.source IS NOT DISTINCT FROM best.source
)
"""

OP5_SQL = f"WITH docs AS (SELECT * FROM documents), {MIX_CTES} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
