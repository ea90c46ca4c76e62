"""What no page and no template can do: end the others' job."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scanning import SIDE, document, drawn

from tallymark import schemas
from tallymark.operators import guard, raster
from tallymark.plans import marking_job, scanning
from tallymark.sources import matrices, templates
from tallymark.sources.store import Store

M = schemas.MATRIX.simpleString()
SHORT = {"rows": 40, "cols": 160, "type": 0, "data": b"abc"}


def test_steps_give_values_or_errors():
    def fails(e):
        raise e

    assert guard.guarded(lambda x: x + 1, 2) == guard.Outcome(3)
    for error, kind in ((guard.PageError("p"), "quality"), (guard.TemplateError("t"), "template"), (ZeroDivisionError("z"), "panic"), (MemoryError("m"), "panic"), (KeyError("k"), "panic")):
        got = guard.guarded(fails, error)
        assert got.value is None and got.error_class == kind and got.error
    with pytest.raises(KeyboardInterrupt):
        guard.guarded(fails, KeyboardInterrupt())


# --- marking


def sheet():
    page = np.zeros((40, 160), dtype=np.uint8)
    page[5:35, 45:75][raster.disk(30, 30, 11)] = 255
    return matrices.to_row(page)


def question(**changes):
    q = {"id": "Q1", "bubbleWidth": 30, "bubbleHeight": 30, "type": "", "options": [{"label": c, "x": 20 + 40 * i, "y": 20} for i, c in enumerate("ABCD")]}
    return {k: v for k, v in (q | changes).items() if v is not ...}


BROKEN_QUESTIONS = [
    (question(bubbleWidth=...), []),
    (question(bubbleHeight=None), []),
    (question(bubbleWidth=-5), []),
    (question(bubbleWidth=2**31 - 1, bubbleHeight=2**31 - 1), []),
    (question(options=None), []),
    (question(options=...), []),
    (question(id=None, options=[{"label": "A", "y": 20}, {"label": "B", "x": 60, "y": 20}, None]), ["B"]),
    (question(options=[{"x": 2**31 - 1, "y": -(2**31)}, {"label": "B", "x": 60, "y": 20}]), ["B"]),
    (None, None),
]


def test_missing_numbers_of_marking_templates(spark):
    docs = [("t", json.dumps({"pages": [{"questions": [question()]}]}))] + [(f"u{i}", json.dumps({"pages": [{"questions": [q]}]})) for i, (q, _) in enumerate(BROKEN_QUESTIONS)]
    t = templates.parse(spark.createDataFrame(docs, "id string, json string"), schemas.MARKING_TEMPLATE)
    pages = spark.createDataFrame([(d, d, 0, sheet()) for d, _ in docs], f"scan_id string, template_id string, page_index int, binary {M}")
    got = {r.scan_id: r for r in marking_job.mark_pages(pages, templates.questions(t)).collect()}
    assert got["t"].selected == ["B"] and got["t"].error is None and len(got) == len(docs)
    for i, (broken, selected) in enumerate(BROKEN_QUESTIONS):
        assert got[f"u{i}"].error == (None if broken else "mark template contains no questions") and got[f"u{i}"].selected == selected, i


def test_unreadable_pages_of_a_marking_job(spark):
    t = templates.parse(spark.createDataFrame([("t", json.dumps({"pages": [{"questions": [question()]}]}))], "id string, json string"), schemas.MARKING_TEMPLATE)
    wide = {"rows": 2**30, "cols": 2**30, "type": 0, "data": b"abc"}
    rows = [("good", 0, sheet()), ("short", 0, SHORT), ("wide", 0, wide), ("minus", 0, {"rows": -1, "cols": -3, "type": 0, "data": b"abc"}), ("none", 0, None)]
    names = [r[0] for r in rows]
    request = spark.createDataFrame([(1, k, s, "t") for k, s in enumerate(names)], "job int, position int, scan_id string, template_id string")
    pages = spark.createDataFrame(rows, f"scan_id string, page_index int, binary {M}")
    answers, result = marking_job.run_job(request, spark.createDataFrame([(s,) for s in names], "id string"), pages, t)
    (row,) = result.collect()
    assert [s.scan_id for s in row.scans] == ["good"] and [e.scan_id for e in row.errors] == names[1:]
    assert row.errors[0].error == "page 0: 3 bytes are no 40 x 160 matrix" and not row.failed
    assert answers.where("error is not null").count() == 4


# --- scanning


def grids(spark, tmp_path, *docs):
    store = Store(spark, f"file://{tmp_path}/store")
    store.save_preprocessing_documents(spark.createDataFrame(list(docs), "id string, json string"))
    return store.template_grids()


def uneven():
    """The two-page template with a fourth anchor on its second page."""
    doc = json.loads(document())
    first = json.loads(document())["pages"][0]["anchors"][2]
    middle = {"image": first["image"], "center": {"x": 120, "y": 120}, "roi": {"min": {"x": 80, "y": 80}, "max": {"x": 160, "y": 160}}}
    doc["pages"][1]["anchors"].append(middle)
    return json.dumps(doc)


def four_marks():
    page = drawn(1)
    page[100:140, 100:140] = drawn(0)[180:220, 20:60]
    return page


def fed(spark, docs, template="t"):
    rows = [(d, template, i, p if p is None or isinstance(p, dict) else matrices.to_row(p)) for d, some in docs.items() for i, p in enumerate(some)]
    return spark.createDataFrame(rows, f"doc string, template_id string, page int, gray {M}").coalesce(1)


def test_pages_with_different_numbers_of_anchors(spark, tmp_path):
    templates_ = grids(spark, tmp_path, ("t", uneven()))
    assert [len(p) for p in templates_.first().grid] == [3, 4]
    front, back = drawn(0), four_marks()
    straight = scanning.straighten(fed(spark, {"right": [front, back], "swapped": [back, front[::-1, ::-1]], "three": [drawn(1), front]}), templates_)
    got = {(r.doc, r.page): r for r in straight.collect()}
    assert [got["right", i].template_page for i in (0, 1)] == [0, 1] and [got["swapped", i].template_page for i in (0, 1)] == [1, 0]
    assert got["swapped", 1].turned and not got["swapped", 0].turned
    order = {(r.doc, r.place): (r.template_page, r.turned, r.error) for r in scanning.order_errors(straight).collect()}
    assert order == {("swapped", 0): (1, False, "page 0 belongs in place 1"), ("swapped", 1): (0, True, "page 1 belongs in place 0"), ("three", 1): (0, False, "page 1 belongs in place 0")}
    assert got["three", 0].template_page is None and got["three", 0].error_class == "quality" and got["three", 1].template_page == 0
    for key, page in ((("right", 1), back), (("swapped", 0), back)):
        assert (matrices.from_row(got[key].binary) != raster.binarize(page, 3, 3, 91, 5.0)).mean() < 0.02


def test_bad_pages_beside_a_good_exam(spark, tmp_path):
    good = [drawn(0), drawn(1)]
    docs = {"good": good, "short": [SHORT, good[1]], "none": [None, good[1]], "tiny": [np.zeros((1, 1), np.uint8), good[1]], "huge": [{"rows": 2**30, "cols": 2**30, "type": 0, "data": b"x"}, good[1]], "flat": [np.full((SIDE, SIDE), 7, np.uint8), good[1]]}
    straight = scanning.straighten(fed(spark, docs), grids(spark, tmp_path, ("t", document())))
    rows = straight.collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.error is None) == (r.doc == "good" or r.page == 1) and (r.binary is None) == (r.error is not None)
        assert r.error is None or r.error_class == "quality"
    outcome = {(r.doc, r.place): r for r in scanning.exam_outcomes(straight).collect()}
    assert outcome["good", 0].error is None and all(outcome[d, 1].error == "unrecognizable page 0" for d in docs if d != "good")


BROKEN_NUMBERS = [
    (("width",), None, "template"),
    (("height",), 0, "template"),
    (("width",), 1, "quality"),
    (("config", "minAnchorConfidence"), ..., None),
    (("config", "blurSize"), ..., "template"),
    (("config", "adaptiveBlockSize"), None, None),
    (("pages", 0, "anchors", 0, "center"), None, None),
    (("pages", 0, "anchors", 1, "roi"), None, "quality"),
    (("pages", 0, "anchors", 1, "roi", "max", "x"), ..., "quality"),
]


def test_missing_numbers_of_preprocessing_templates(spark, tmp_path):
    known = grids(spark, tmp_path, ("t", document())).select("template_id", "template", "grid")
    text = known.select(F.to_json("template").alias("j")).first().j
    all_, pages = known, fed(spark, {"good": [drawn(0), drawn(1)]})
    for i, (path, value, _) in enumerate(BROKEN_NUMBERS):
        at = doc = json.loads(text)
        for step in path[:-1]:
            at = at[step]
        if value is ...:
            at.pop(path[-1], None)
        else:
            at[path[-1]] = value
        all_ = all_.unionByName(known.select(F.lit(f"b{i}").alias("template_id"), F.from_json(F.lit(json.dumps(doc)), schemas.PREPROCESSING_TEMPLATE).alias("template"), "grid"))
        pages = pages.unionByName(fed(spark, {f"b{i}": [drawn(0)]}, f"b{i}"))
    got = {(r.doc, r.page): r for r in scanning.straighten(pages, all_).collect()}
    assert got["good", 0].error is None and got["good", 1].error is None and len(got) == 2 + len(BROKEN_NUMBERS)
    assert [got[f"b{i}", 0].error_class for i in range(len(BROKEN_NUMBERS))] == [kind for *_, kind in BROKEN_NUMBERS]


def test_templates_without_patterns_or_pages(spark, tmp_path):
    known = grids(spark, tmp_path, ("t", document()))
    fewer = known.select(F.lit("fewer").alias("template_id"), "template", F.slice("grid", 1, 1).alias("grid"))
    hole = known.select(F.lit("hole").alias("template_id"), "template", F.transform("grid", lambda p: F.transform(p, lambda m, i: F.when(i > 0, m))).alias("grid"))
    bare = known.select(F.lit("bare").alias("template_id"), F.col("template").withField("pages", F.filter("template.pages", lambda p: F.lit(False))).alias("template"), "grid")
    one = known.select(F.lit("one").alias("template_id"), F.col("template").withField("pages", F.transform("template.pages", lambda p: p.withField("anchors", F.slice(p["anchors"], 1, 1)))).alias("template"), F.transform("grid", lambda p: F.slice(p, 1, 1)).alias("grid"))
    pages = fed(spark, {"good": [drawn(0), drawn(1)]})
    for name in ("fewer", "hole", "bare", "one", "nobody"):
        pages = pages.unionByName(fed(spark, {name: [drawn(0), drawn(1)]}, name))
    straight = scanning.straighten(pages, known.select("template_id", "template", "grid").unionByName(fewer).unionByName(hole).unionByName(bare).unionByName(one))
    got = {(r.doc, r.page): r for r in straight.collect()}
    assert len(got) == 12 and got["good", 0].error is None
    assert all(got[name, 0].error_class == "template" for name in ("hole", "bare", "one", "nobody"))
    assert got["fewer", 0].error is None and got["fewer", 1].error_class == "template"
    assert got["nobody", 0].error == got["bare", 0].error == "template not found"


def test_drift_is_counted_on_the_way(spark, tmp_path):
    doc = json.loads(document())
    doc["config"]["referenceRatio"] = 1.0
    scaled = lambda k: np.kron(drawn(0), np.ones((k, k), np.uint8))
    pages = fed(spark, {"same": [drawn(0), drawn(1)], "double": [scaled(2), drawn(1)], "none": [None, None]})
    known = grids(spark, tmp_path, ("t", json.dumps(doc)))
    straight, seen = scanning.drift_metric(scanning.straighten(pages, known))
    rows = straight.collect()
    far = [r for r in rows if r.scale is not None and not 0.67 <= r.scale <= 1.5]
    assert seen.get == {"pages": 6, "drifted": len(far), "least": 1.0, "most": 2.0} and [(r.doc, r.page) for r in far] == [("double", 0)]


def test_crops_of_unreadable_pages(spark):
    df = spark.createDataFrame([(1, SHORT, (0, 0, 5, 5)), (2, sheet(), (0, 0, 5, 5)), (3, sheet(), None)], f"k int, picture {M}, bounds struct<x:int,y:int,width:int,height:int>").coalesce(1)
    assert [r.snippet is None for r in raster.crop(df).orderBy("k").collect()] == [True, False, True]

