"""Snippets end to end: questions asked for of stored scans, to parts of their pages' pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, raster
from ..sources import templates as T
from ..sources.cuts import cut, join_small

BOX = ("x", "y", "width", "height")


def question_places(templates: DataFrame) -> DataFrame:
    """(template_id, question_id, page_index, x, y, width, height): where each question is cut out.

    Of questions with the same id the first of the last page that has one counts. One without options has no box.
    """
    box = geometry.snippet_bounds("question.options", F.col("question.bubbleWidth"), F.col("question.bubbleHeight"))
    placed = T.questions(templates).select("template_id", F.col("question.id").alias("question_id"), "page_index", "ordinal", box.alias("box"))
    one = placed.groupBy("template_id", "question_id").agg(F.max_by(F.struct("page_index", "box"), F.struct("page_index", -F.col("ordinal"))).alias("p"))
    return one.select("template_id", "question_id", "p.page_index", *[F.col(f"p.box.{c}").alias(c) for c in BOX])


def requested_snippets(requests: DataFrame, pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(request, scan_id, template_id, question_id, page_index, page_id, x, y, width, height, error): what each request cuts out.

    requests: (request, scan_id, template_id, question_id); pages: (id, scan_id, page_index); templates parsed, as
    (id, template). What can't be found is an error, the first of template, question and page; nulls are found nowhere.
    Of pages with the same index the smallest id counts. Other columns don't matter.
    """
    known = cut(templates.select(F.col("id").alias("template_id"), F.lit(True).alias("_known")).distinct(), "known-templates")
    places = cut(question_places(templates), "question-places")
    asked = join_small(requests.select("request", "scan_id", "template_id", "question_id"), known, ["template_id"])
    asked = join_small(asked, places, ["template_id", "question_id"])
    first = pages.groupBy("scan_id", "page_index").agg(F.min("id").alias("page_id"))
    found = asked.join(first, ["scan_id", "page_index"], "left")
    error = (
        F.when(F.col("_known").isNull(), "template not found")
        .when(F.col("page_index").isNull(), "question not found")
        .when(F.col("page_id").isNull(), "page not found")
        .when(F.col("x").isNull(), "question without options")
    )
    return found.select("request", "scan_id", "template_id", "question_id", "page_index", "page_id", *BOX, error.alias("error"))


def snippets(requests: DataFrame, scan_pages: DataFrame, templates: DataFrame) -> DataFrame:
    """The rows of requested_snippets with the part of the page's picture as `snippet`, blank beyond the page.

    Each different box of a page is cut once, where the page is read while boxes are few, so that pictures aren't
    shuffled for requests and repeated requests share a snippet. A picture that can't be read is its requests' error.
    """
    asked = cut(requested_snippets(requests, scan_pages.select("id", "scan_id", "page_index"), templates), "asked-snippets")
    boxes = cut(asked.where(F.col("error").isNull()).select("page_id", *BOX).distinct(), "boxes")
    met = join_small(scan_pages.select(F.col("id").alias("page_id"), "picture"), boxes, ["page_id"], "inner")
    parts = raster.crop(met.withColumn("bounds", F.struct(*BOX))).groupBy("page_id", *BOX).agg(F.min("snippet").alias("snippet"))
    out = asked.join(parts, ["page_id", *BOX], "left")
    error = F.coalesce("error", F.when(F.col("snippet").isNull(), "picture can't be read"))
    return out.select(*[c for c in asked.columns if c != "error"], "snippet", error.alias("error"))
