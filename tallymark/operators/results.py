"""Batches: scans that are asked for, their errors, and results as nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requested_scans(requests: DataFrame, scans: DataFrame, pages: DataFrame, template_pages: DataFrame) -> DataFrame:
    """(job, position, scan_id, n_pages, error): a row for each scan that a job asks for, with what keeps it from being marked.

    requests: (job, position, scan_id, template_id); scans: (scan_id); pages: (scan_id, page_index); template_pages: (template_id, n_pages).
    """
    # as many as there are scans: Spark would take them for few by the size of packed files, and gather them in the driver
    counted = pages.groupBy("scan_id").agg(F.count("*").alias("n_pages")).hint("shuffle_hash")
    stored = scans.select("scan_id", F.lit(True).alias("_stored")).distinct().hint("shuffle_hash")
    found = requests.join(stored, "scan_id", "left").join(counted, "scan_id", "left")
    found = found.join(template_pages.select("template_id", F.col("n_pages").alias("_wanted")), "template_id", "left")
    n = F.coalesce("n_pages", F.lit(0))
    error = (
        F.when(F.col("_wanted").isNull(), "template not found")
        .when(F.col("_stored").isNull() | (n == 0), "scan not found")
        .when(n != F.col("_wanted"), F.format_string("scan has %d pages, the template %d", n, F.col("_wanted")))
    )
    return found.select("job", "position", "scan_id", n.alias("n_pages"), error.alias("error"))


def marking_results(outcomes: DataFrame) -> DataFrame:
    """One row per job: pages_marked, scans and errors, each in the order asked for, and whether all failed.

    outcomes: (job, position, scan_id, n_pages, error), and marks where there are any. Arrays hold one job's scans.
    """
    ok = F.col("error").isNull()
    good = F.struct("position", "scan_id", *(["marks"] if "marks" in outcomes.columns else []))
    grouped = outcomes.groupBy("job").agg(
        F.coalesce(F.sum(F.when(ok, F.col("n_pages"))), F.lit(0)).cast("long").alias("pages_marked"),
        F.array_sort(F.collect_list(F.when(ok, good))).alias("scans"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("position", "scan_id", "error")))).alias("errors"),
    )
    return grouped.withColumn("failed", (F.size("scans") == 0) & (F.size("errors") > 0))


def scan_results(exams: DataFrame) -> DataFrame:
    """One row per document: ids of the scans that were stored and errors with their spans; exams: (doc, block, from, thru, scan_id, error)."""
    return exams.groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("scan_id", F.lit("")) != "", F.struct("block", "scan_id")))), lambda x: x["scan_id"]).alias("scan_ids"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("from", "thru", "error")))).alias("errors"),
    )


def wire_marks(marks: DataFrame) -> DataFrame:
    """Marks as JSON: geometry is left out, and no selection is null."""
    return marks.select("scan_id", F.to_json(F.struct(F.col("question_id").alias("questionId"), F.col("flag").alias("flagged"), F.when(F.size("selected") > 0, F.col("selected")).alias("selected"), "confidence"), {"ignoreNullFields": "false"}).alias("json"))
