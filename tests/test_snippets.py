"""Snippets of stored pages, by cutting them out of arrays, and what can't be cut out."""

import json

import numpy as np
import pytest

from tallymark import schemas
from tallymark.plans import snippets
from tallymark.sources import matrices, templates

OPTIONS = [{"label": c, "x": 40 + 30 * i, "y": 50} for i, c in enumerate("ABC")]


def question(name, dy=0, options=OPTIONS):
    return {"id": name, "bubbleWidth": 21, "bubbleHeight": 16, "options": [{**o, "y": o["y"] + dy} for o in options]}


DOC = {"pages": [{"questions": [question("Q1"), question("Q2", 60), question("Q9", 5)]}, {"questions": [question("Q9", 20), question("Q9", 90), question("Q3", options=[]), question("Q4", -45)]}]}
LEGACY = {"questions": [question("Q1", 30)]}


def parsed(spark, **docs):
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, json string")
    return templates.parse(rows, schemas.MARKING_TEMPLATE).select("id", "template")


def pixels(seed):
    return np.random.default_rng(seed).integers(0, 256, (160, 140)).astype(np.uint8)


def stored(spark, pages):
    rows = [(i, scan, page, picture if picture is None else matrices.to_row(picture), "x") for i, scan, page, picture in pages]
    kind = schemas.TABLES["scan_pages"]["picture"].dataType.simpleString()
    return spark.createDataFrame(rows, f"id string, scan_id string, page_index int, picture {kind}, snippet string")


def requests(spark, rows):
    return spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "request int, scan_id string, template_id string, question_id string, x int")


def by_hand(page, centre_y):
    """Bubbles of 21 by 16 pixels at x 40, 70 and 100, ten pixels around them."""
    y0, y1, x0, x1 = centre_y - 18, centre_y + 18, 20, 120
    out = np.zeros((y1 - y0, x1 - x0), dtype=np.uint8)
    top = max(0, y0)
    out[top - y0 :] = page[top:y1, x0:x1]
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_snippets_by_hand(spark, monkeypatch, limit):
    # joined with the small side at hand, and beyond its limit by shares
    monkeypatch.setattr(snippets.join_small, "__defaults__", ("left", 16, limit))
    a, b = pixels(1), pixels(2)
    pages = stored(spark, [("a0", "s", 0, a), ("a1", "s", 1, b), ("b0", "u", 0, b)])
    asked = [("s", "t", "Q1"), ("s", "t", "Q2"), ("s", "t", "Q9"), ("s", "t", "Q4"), ("u", "t", "Q1"), ("u", "old", "Q1"), ("s", "t", "Q1")]
    out = {r.request: r for r in snippets.snippets(requests(spark, asked), pages, parsed(spark, t=DOC, old=LEGACY)).collect()}
    want = [by_hand(a, 50), by_hand(a, 110), by_hand(b, 70), by_hand(b, 5), by_hand(b, 50), by_hand(b, 80), by_hand(a, 50)]
    assert len(out) == len(asked)
    for i, w in enumerate(want):
        assert out[i].error is None
        assert (matrices.from_row(out[i].snippet) == w).all(), asked[i]


def test_what_cannot_be_cut_out(spark):
    short = matrices.to_row(pixels(3)) | {"data": b"abc"}
    kind = schemas.TABLES["scan_pages"]["picture"].dataType.simpleString()
    pages = spark.createDataFrame([("a0", "s", 0, matrices.to_row(pixels(1))), ("b0", "u", 0, short), ("b1", "u", 1, None)], f"id string, scan_id string, page_index int, picture {kind}")
    asked = [("s", "no", "Q1"), ("s", None, "Q1"), ("s", "t", "Q8"), ("s", "t", None), ("s", "t", "Q4"), (None, "t", "Q1"), ("w", "t", "Q1"), ("u", "t", "Q3"), ("u", "t", "Q1"), ("u", "t", "Q4"), ("s", "none", "Q1"), ("s", "t", "Q1")]
    out = {r.request: r for r in snippets.snippets(requests(spark, asked), pages, parsed(spark, t=DOC, none={})).collect()}
    errors = ["template not found"] * 2 + ["question not found"] * 2 + ["page not found"] * 3 + ["question without options"] + ["picture can't be read"] * 2 + ["question not found", None]
    assert [out[i].error for i in range(len(asked))] == errors
    assert [i for i in out if out[i].snippet is not None] == [len(asked) - 1]


def test_ties_and_repeats(spark):
    # of pages with one index the smallest id counts; rows that repeat give each request one row still
    a, b = pixels(1), pixels(2)
    pages = stored(spark, [("z", "s", 0, a), ("b", "s", 0, b), ("b", "s", 0, b)])
    docs = parsed(spark, t=DOC)
    asked = requests(spark, [("s", "t", "Q1")] * 3)
    out = snippets.snippets(asked, pages, docs.unionByName(docs)).collect()
    assert len(out) == 3 and all((matrices.from_row(r.snippet) == by_hand(b, 50)).all() for r in out)


def test_empty_tables(spark):
    pages, docs, asked = stored(spark, [("a", "s", 0, pixels(1))]), parsed(spark, t=DOC), requests(spark, [("s", "t", "Q1")])
    assert snippets.snippets(asked.where("false"), pages, docs).count() == 0
    assert snippets.snippets(asked, pages.where("false"), docs).first().error == "page not found"
    assert snippets.snippets(asked, pages, docs.where("false")).first().error == "template not found"


def test_pictures_go_to_python_once(spark):
    pages = stored(spark, [("a0", "s", 0, pixels(1))])
    asked = snippets.snippets(requests(spark, [("s", "t", "Q1")]), pages, parsed(spark, t=DOC))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "NestedLoop" not in plan and "Cartesian" not in asked._jdf.queryExecution().executedPlan().toString()
