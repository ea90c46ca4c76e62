"""A scanning job end to end: pages of documents and their templates to straightened pages in the templates' order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import pages as P
from ..operators import raster
from ..operators.guard import PANIC, TEMPLATE
from ..schemas import MATRIX
from ..sources import templates as T
from ..sources.cuts import columns_of, cut, join_small

#: Classes of errors, the gravest first.
_GRAVE = (PANIC, TEMPLATE)


def _grave(*classes) -> F.Column:
    """The gravest of some classes of errors."""
    found = F.filter(F.array(*classes), lambda c: c.isNotNull())
    out = F.get(found, F.lit(0))
    for kind in reversed(_GRAVE):
        out = F.when(F.array_contains(found, kind), kind).otherwise(out)
    return out


def straighten(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, template_id, page, n_places, exam, place, template_page, picture, binary, turned, error, error_class, scale): a row per page.

    pages: (doc, template_id, page, gray), counted from 0 in each document; templates: (template_id, template, grid) as
    Store.template_grids gives them. Pages are placed in rounds: in round r each page not yet placed is held against the one
    template page r places on from its own, in a circle, upside down too; the first that fits is taken. A round's rows are
    written, and the next reads those of them that are left. A page that fits nowhere has the error of its own place and the gravest class of
    its tries. Template pages are joined as rows of their own, so they may have different numbers of anchors, and pixels meet
    them without a shuffle while they are few. `scale` is the page's resolution beside the one that its template is set for.
    """
    flat = cut(T.preprocessing_pages(templates), "template-pages")
    sizes = cut(flat.groupBy("template_id").agg(F.first("n_places").alias("n_places"), F.first("page_of_template").alias("any_page")), "template-sizes")
    rounds = flat.agg(F.max("n_places")).first()[0] or 1
    t, n = F.col("any_page"), F.col("n_places")
    ratio = scalars.size_ratio(F.col("gray.cols"), F.col("gray.rows"), F.nullif(t["width"], F.lit(0)), F.nullif(t["height"], F.lit(0)))
    scale = F.when(F.coalesce(t["config"]["referenceRatio"], F.lit(0.0)) > 0, ratio / F.nullif(t["config"]["referenceRatio"], F.lit(0.0))).otherwise(F.lit(1.0))
    met = join_small(pages.select("doc", "template_id", "page", "gray"), sizes, ["template_id"])
    left = met.select("doc", "template_id", "page", "gray", n, P.exam_of("page", n).alias("exam"), (F.col("page") % n).cast("int").alias("place"), scale.alias("scale"), *[F.lit(None).cast("string").alias(c) for c in ("first_error", "first_class")])
    done = []
    for turn in range(rounds):
        at = ((F.col("place") + turn) % n).cast("int")
        tried = join_small(left.withColumn("template_page", at), columns_of(flat, "template_id", "template_page", "page_of_template", "patterns"), ["template_id", "template_page"])
        fitted = raster.fit_pages(tried, template_page="page_of_template")
        fitted = fitted.withColumns({"first_error": F.coalesce("first_error", "error"), "first_class": _grave(F.col("first_class"), F.col("error_class"))})
        fitted = cut(fitted, f"round-{turn}")
        over = F.col("error").isNull() | F.coalesce(n <= turn + 1, F.lit(True))
        done.append(fitted.where(over))
        left = fitted.where(~over).select(*left.columns)
        if left.isEmpty():
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    good = F.col("error").isNull()
    one = lambda c, kind: F.when(good, F.col(c)).otherwise(F.lit(None).cast(kind)).alias(c)
    return rows.select(
        "doc", "template_id", "page", "n_places", "exam", "place", one("template_page", "int"), one("picture", MATRIX), one("binary", MATRIX), one("turned", "boolean"),
        F.when(~good, F.col("first_error")).alias("error"), F.when(~good, F.col("first_class")).alias("error_class"), "scale",
    )


def order_errors(straight: DataFrame) -> DataFrame:
    """(doc, exam, place, template_page, turned, error): pages that fit another template page than their own, with an error of class `order`.

    The search has held each page against all template pages, both ways up, its own first.
    """
    found = straight.where(F.col("template_page") != F.col("place"))
    return found.select("doc", "exam", "place", "template_page", "turned", F.format_string("page %d belongs in place %d", "place", "template_page").alias("error"))


def drift_metric(straight: DataFrame, name: str = "drift") -> tuple[DataFrame, Observation]:
    """The pages, and what an action on them finds on its way: pages, drifted (far from the template's resolution), and the least and largest scale."""
    seen = Observation(name)
    scale = F.col("scale")
    return straight.observe(seen, F.count("*").alias("pages"), F.count_if(scalars.drifts(scale)).alias("drifted"), F.min(scale).alias("least"), F.max(scale).alias("most")), seen


def exam_outcomes(straight: DataFrame) -> DataFrame:
    """(doc, exam, place, template_page, error, error_class) of each page, with the error of its whole exam.

    An exam fails by a page that fits nowhere (class `quality`, or `template` or `panic` where that is at fault) or by two pages in
    one place (`order`); a document whose pages don't divide into exams fails as a whole (`count`). Documents are
    counted by a grouping; an exam's pages meet in windows over one slim frame.
    """
    slim = straight.select("doc", "n_places", "exam", "place", "template_page", F.col("error_class").alias("why"))
    docs = slim.groupBy("doc").agg(F.count("*").alias("n"), F.first("n_places").alias("m")).hint("shuffle_hash")  # not few, however small their files
    parts = F.when(F.coalesce("m", F.lit(0)) < 1, "template not found").when(F.col("n") % F.nullif(F.col("m"), F.lit(0)) != 0, F.format_string("%d pages don't divide into exams of %d", "n", "m"))
    rows = slim.join(docs.select("doc", parts.alias("count_error")), "doc")
    why = F.collect_set("why").over(Window.partitionBy("doc", "exam"))
    gravest = F.coalesce(*[F.when(F.array_contains(why, kind), kind) for kind in _GRAVE], F.get(why, F.lit(0)))
    rows = P.exam_errors(rows, ["doc", "exam"], "place", "template_page").withColumn("gravest", gravest)
    kind = F.when(F.col("count_error").isNotNull(), "count").when(F.col("error").isNull(), F.lit(None).cast("string")).when(F.col("gravest").isNotNull(), F.col("gravest")).otherwise("order")
    return rows.select("doc", "exam", "place", "template_page", F.coalesce("count_error", "error").alias("error"), kind.alias("error_class"))


def exam_rows(outcomes: DataFrame, pages_per_exam: DataFrame, job: str) -> DataFrame:
    """(doc, block, from, thru, scan_id, error) of each exam, as results.scan_results takes them; pages_per_exam: (doc, n_places).

    Ids follow from job, document and exam, so that a task that runs again gives the same ones; failed exams have none.
    """
    exams = outcomes.where(F.col("exam").isNotNull()).groupBy("doc", "exam").agg(F.min("error").alias("error"), F.count("*").alias("n")).join(pages_per_exam, "doc")
    first = F.col("exam") * F.col("n_places")
    id_ = F.sha2(F.concat_ws("/", F.lit(job), F.col("doc").cast("string"), F.col("exam").cast("string")), 256)
    return exams.select("doc", F.col("exam").alias("block"), (first + 1).alias("from"), (first + F.col("n")).alias("thru"), F.when(F.col("error").isNull(), id_).alias("scan_id"), "error")


def stored_rows(straight: DataFrame, exams: DataFrame, created_at_unix_ms: int) -> tuple[DataFrame, DataFrame]:
    """(scans, scan_pages) of the exams that succeeded, as Store.save_scans takes them; exams as exam_rows gives them."""
    good = exams.where(F.col("scan_id").isNotNull()).select("doc", F.col("block").alias("exam"), "scan_id")
    pages = straight.join(good, ["doc", "exam"])
    page_id = F.concat_ws("-", "scan_id", F.col("template_page").cast("string"))
    scan_pages = pages.select(page_id.alias("id"), F.concat(page_id, F.lit("-picture")).alias("picture_key"), F.col("template_page").alias("page_index"), "scan_id", "binary", "picture")
    scans = pages.where(F.col("template_page") == 0).select(F.col("scan_id").alias("id"), F.col("template_id").alias("preprocessing_template_id"), F.lit(created_at_unix_ms).cast("long").alias("created_at_unix_ms"))
    return scans, scan_pages
