"""Pages of documents: blocks, subsets, spans, and which template page each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import intervals


def page_blocks(docs: DataFrame, n_pages: str, block_size, subsets) -> DataFrame:
    """One row per block: subset, block, from and thru (1-based, inclusive), or one with an error where pages don't divide.

    Blocks are dealt to subsets in turn for their counts, and lie in them in order: of b blocks over s subsets, the first
    b % s subsets hold one more. A document without pages has no blocks.
    """
    n, size = F.col(n_pages), col(block_size).cast("long")
    blocks = F.floor(n / size)
    bad = (n % size) != 0
    wanted = F.least(blocks, col(subsets).cast("long"))
    counted = docs.withColumn("error", F.when(bad, "pages don't divide into blocks")).withColumn("_b", blocks).withColumn("_s", wanted)
    at = F.when(bad, F.array(F.lit(None).cast("long"))).when(F.col("_b") == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_b") - 1, F.lit(0))))
    out = counted.withColumn("block", F.explode(at))
    floor, extra = F.floor(F.col("_b") / F.col("_s")), F.col("_b") % F.col("_s")
    head = extra * (floor + 1)
    subset = F.when(F.col("block") < head, F.floor(F.col("block") / (floor + 1))).otherwise(extra + F.floor((F.col("block") - head) / floor))
    return out.withColumn("subset", subset.cast("long")).withColumn("from", F.col("block") * size + 1).withColumn("thru", (F.col("block") + 1) * size).drop("_b", "_s")


def span_error(start, stop, n_pages) -> Column:
    """What is wrong with a span of pages; null if nothing is."""
    a, b, n = col(start), col(stop), col(n_pages)
    return F.when(a > b, "the span ends before it starts").when((a < 1) | (b > n), "the span is out of bounds")


def span_pages(spans: DataFrame, pages: DataFrame, counts: DataFrame, width: int = 32) -> DataFrame:
    """(doc, span, from, thru, page, error): a row for each page of each span, or one with what is wrong with the span.

    spans: (doc, span, from, thru), from 1 and inclusive; pages: (doc, page); counts: (doc, n_pages). Spans may overlap, and a page
    is there once for each that holds it. They meet by bins of `width` pages, not by comparing each page with each span;
    a good span without stored pages has no rows.
    """
    known = spans.join(counts.select("doc", F.col("n_pages").cast("long").alias("_n")), "doc", "left")
    checked = known.withColumn("error", span_error("from", "thru", F.coalesce("_n", F.lit(0)))).drop("_n")
    good = checked.where(F.col("error").isNull()).withColumn("_after", F.col("thru") + 1)
    met = intervals.points_in_spans(pages.select("doc", "page"), good, ["doc"], "page", "from", "_after", width)
    bad = checked.where(F.col("error").isNotNull())
    return met.select("doc", "span", "from", "thru", "page", "error").unionByName(bad.select("doc", "span", "from", "thru", F.lit(None).cast(pages.schema["page"].dataType).alias("page"), "error"))


def exam_of(page, pages_per_exam) -> Column:
    return F.floor(col(page) / col(pages_per_exam)).cast("long")


def assign_pages(scores: DataFrame, exam: str = "exam", page: str = "page", template_page: str = "template_page", n_pages: str = "n_pages", ok: str = "ok") -> DataFrame:
    """(exam, page, template_page, error): each page takes the first template page that fits, tried from its own on, in a circle.

    A page that fits none is unrecognizable, and pages that take the same template page are duplicates; either fails the exam.
    """
    turn = F.pmod(F.col(template_page) - F.col(page), F.col(n_pages))
    first = scores.groupBy(exam, page).agg(F.min(F.when(F.col(ok), F.struct(turn.alias("turn"), F.col(template_page).alias("t")))).alias("hit"))
    taken = first.select(exam, page, F.col("hit.t").alias(template_page))
    return exam_errors(taken, [exam], page, template_page).select(exam, page, template_page, "error")


# The errors of exams, as clients of the original read them
UNRECOGNIZABLE, DUPLICATE = "unrecognizable page ", "duplicate pages in an exam"


def exam_errors(placed: DataFrame, exam: list[str], page: str, template_page: str) -> DataFrame:
    """Adds `error` of its exam to each placed page: the first page that fits nowhere, else pages in the same place. An exam's pages are few."""
    together = Window.partitionBy(*exam)
    shared = F.when(F.col(template_page).isNotNull(), F.count("*").over(Window.partitionBy(*exam, template_page))).otherwise(0)
    counted = placed.withColumn("_n", shared)
    lost = F.min(F.when(F.col(template_page).isNull(), F.col(page))).over(together)
    error = F.when(lost.isNotNull(), F.concat(F.lit(UNRECOGNIZABLE), lost.cast("string"))).when(F.max("_n").over(together) > 1, F.lit(DUPLICATE))
    return counted.withColumn("error", error).drop("_n")


def misplaced(scores: DataFrame, exam: str = "exam", page: str = "page", template_page: str = "template_page", score: str = "score", least: float = 0.5) -> DataFrame:
    """Pages that match another template page than their own best, with that page."""
    other = scores.where(F.col(page) != F.col(template_page)).groupBy(exam, page).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(template_page)).alias("t"))).alias("best"))
    own = scores.where(F.col(page) == F.col(template_page)).select(exam, page, F.col(score).alias("own"))
    hit = other.join(own, [exam, page], "left")
    return hit.where((F.coalesce("own", F.lit(0.0)) < least) & (F.col("best.s") >= least)).select(exam, page, (-F.col("best.t")).alias("found"))
