"""A marking job end to end: requests, stored pages and a template to marks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, marking, results, runs
from ..sources import templates as T
from ..sources.cuts import cut, join_small


def mark_pages(pages: DataFrame, questions: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Answers of each (scan, question): pages (scan_id, template_id, page_index, binary), questions as templates.questions gives them.

    Fills come from the pages' run lengths, in DataFrame functions throughout. A page that can't be marked is one row with
    its error and nulls. sizes: as runs.measured takes them.
    """
    measured = runs.measured(pages, questions, sizes)
    flat = measured.select(
        "scan_id", "template_id", "page_index", "ordinal", "error", "settings", "dxs", "dys", "fills",
        F.col("question.id").alias("question_id"), F.coalesce("question.type", F.lit("")).alias("type"),
        F.col("question.bubbleWidth").alias("w"), F.col("question.bubbleHeight").alias("h"), F.col("question.options").alias("options"),
        F.transform("question.options", lambda o: o["label"]).alias("labels"), F.transform("question.options", lambda o: F.coalesce(o["baselineBias"], F.lit(0.0))).alias("bias"),
    )
    answers = marking.mark(flat, bias="bias", selection_threshold=F.col("settings.selectionThreshold"), flag_threshold=F.col("settings.flagThreshold"))
    return answers.withColumn("boxes", geometry.option_boxes("options", "w", "h", "selected", "dxs", "dys")).withColumn("bounds", geometry.question_bounds("options", "w", "h", "dxs", "dys")).select("scan_id", "template_id", "page_index", "ordinal", "question_id", "selected", "confidence", "flag", "boxes", "bounds", "error")


def run_job(requests: DataFrame, scans: DataFrame, scan_pages: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, results) of jobs: requests (job, position, scan_id, template_id); templates parsed, as (id, template).

    A scan that is missing, has another number of pages than its template, or a page that can't be marked becomes an
    error row; the others go on. Who needs both frames writes the answers first: each works the pixels out.
    """
    sizes = templates.select(F.col("id").alias("template_id"), F.size(T.normal_pages()).alias("n_pages"))
    outcomes = results.requested_scans(requests, scans.select(F.col("id").alias("scan_id")), scan_pages.select("scan_id", "page_index"), sizes)
    outcomes = outcomes.join(requests.select("job", "position", "template_id").hint("shuffle_hash"), ["job", "position"])
    # the scans asked for are ids alone: pixels meet them where they are read while those are few, and by a shuffle, once, where they are many
    wanted = cut(outcomes.where(F.col("error").isNull()).select("scan_id", "template_id").distinct(), "wanted")
    asked = lambda rows: join_small(rows, wanted, ["scan_id"], "inner")
    stored = scan_pages.select("scan_id", "page_index", "binary")
    pages = asked(stored).select("scan_id", "template_id", "page_index", "binary")
    sizes = asked(runs.page_sizes(stored, ["scan_id", "page_index"])).select("scan_id", "template_id", "page_index", "rows", "cols", "error")
    answers = mark_pages(pages, T.questions(templates), sizes)
    mark = F.struct(F.col("question_id").alias("questionId"), F.col("flag").alias("flagged"), F.when(F.size("selected") > 0, F.col("selected")).alias("selected"), "confidence")
    bad = F.col("error").isNotNull()
    per_scan = answers.groupBy("scan_id", "template_id").agg(
        F.min(F.when(bad, F.struct("page_index", "error"))).alias("bad"),
        F.array_sort(F.collect_list(F.when(~bad, F.struct("page_index", "ordinal", mark.alias("mark"))))).alias("m"),
    )
    message = F.format_string("page %d: %s", F.col("bad.page_index"), F.col("bad.error"))
    marked = outcomes.join(per_scan, ["scan_id", "template_id"], "left").select(
        "job", "position", "scan_id", "n_pages", F.coalesce("error", F.when(F.col("bad").isNotNull(), message)).alias("error"), F.transform("m", lambda x: x["mark"]).alias("marks")
    )
    return answers, results.marking_results(marked)
