"""Blocks, assignments, validation, templates, store, jobs."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions import scalars
from tallymark.operators import alignment, pages, results, validation
from tallymark.sources import templates
from tallymark.sources.store import Store
from tallymark.streaming import jobs


# The expected spans are those of the original
@pytest.mark.parametrize(
    ("n", "size", "subsets", "spans"),
    [(12, 4, 1, [(1, 12)]), (12, 2, 2, [(1, 6), (7, 12)]), (12, 2, 3, [(1, 4), (5, 8), (9, 12)]), (20, 2, 3, [(1, 8), (9, 14), (15, 20)]), (12, 4, 3, [(1, 4), (5, 8), (9, 12)]), (8, 4, 3, [(1, 4), (5, 8)]), (0, 1, 3, [])],
)
def test_block_subsets(spark, n, size, subsets, spans):
    df = spark.createDataFrame([(1, n)], "doc int, n long")
    got = pages.page_blocks(df, "n", F.lit(size), F.lit(subsets)).groupBy("subset").agg(F.min("from").alias("a"), F.max("thru").alias("b")).orderBy("subset").collect()
    assert [(r.a, r.b) for r in got] == spans


def test_blocks_that_do_not_divide(spark):
    (row,) = pages.page_blocks(spark.createDataFrame([(1, 10)], "doc int, n long"), "n", F.lit(4), F.lit(2)).collect()
    assert row.error and row.block is None


def test_span_errors(spark):
    df = spark.createDataFrame([(1, 2), (6, 88), (0, 2), (4, 2), (56, 102)], "a int, b int")
    assert [r[0] is None for r in df.select(pages.span_error("a", "b", F.lit(88))).collect()] == [True, True, False, False, False]


def test_assignment(spark):
    ok = {"swapped": [[0, 1], [1, 0]], "lost": [[1, 0], [0, 0]], "twice": [[1, 0], [1, 0]]}
    rows = [(e, p, t, 2, bool(m[p][t])) for e, m in ok.items() for p in range(2) for t in range(2)]
    got = {(r.exam, r.page): (r.template_page, r.error) for r in pages.assign_pages(spark.createDataFrame(rows, "exam string, page long, template_page long, n_pages long, ok boolean")).collect()}
    assert got["swapped", 0] == (1, None) and got["swapped", 1] == (0, None)
    assert got["lost", 0][1] == "unrecognizable page 1"
    assert got["twice", 1][1] == "duplicate pages in an exam"


TEMPLATE = '{"Config":{"fillThreshold":0.25},"pages":[{"questions":[{"ID":"Q1","bubbleWidth":26,"bubbleHeight":26,"type":"multi","options":[{"label":"A","X":1,"y":2},{"label":"B","x":3,"y":4}]}]}]}'


def parsed(spark, *texts):
    return templates.parse(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, json string"), schemas.MARKING_TEMPLATE)


def test_templates_are_read_without_regard_to_case(spark):
    old = '{"questions":[{"id":"Q9","bubbleWidth":5,"bubbleHeight":5,"options":[{"label":"A","x":1,"y":1}]}]}'
    df = parsed(spark, TEMPLATE, old, "{broken", None)
    assert [r.malformed for r in df.orderBy("id").collect()] == [False, False, True, True]
    got = templates.options(df.where(~F.col("malformed"))).orderBy("template_id", "option_index").collect()
    assert [(r.question_id, r.option.label, r.option.x) for r in got] == [("Q1", "A", 1), ("Q1", "B", 3), ("Q9", "A", 1)]
    (s,) = {r.settings for r in templates.questions(df.where("id = '0'")).collect()}
    assert (s.selectionThreshold, s.bubbleInset, s.flagThreshold) == (0.25, 0.75, 0.5)
    (s,) = {r.settings for r in templates.questions(df.where("id = '0'"), strict_wire=True).collect()}
    assert (s.bubbleInset, s.flagThreshold, s.labelInset) == (0, 0, 0.4)


def test_violations_in_document_order(spark):
    bad = TEMPLATE.replace('"B"', '" "').replace('"bubbleWidth":26', '"bubbleWidth":0')
    found = validation.marking_violations(parsed(spark, TEMPLATE, bad, '{"pages":[]}', '{"pages":[{"questions":[]}]}'))
    first = {r.id: r.message for r in validation.first_violations(found).collect()}
    assert first == {"1": "pages[0]: questions[0]: bubbleWidth must be positive", "2": "pages must contain at least one page", "3": "pages[0]: questions must contain at least one question"}


def test_preprocessing_rules(spark):
    anchor = '{"image":"x","center":{"x":%d,"y":1},"roi":{"min":{"x":0,"y":0},"max":{"x":5,"y":5}}}'
    doc = '{"width":10,"height":10,"config":{"blurSize":%d,"morphCloseSize":3,"minAnchorConfidence":0.5,"adaptiveBlockSize":91,"adaptiveC":-5},"pages":[{"anchors":[%s]}]}'
    texts = [doc % (3, ",".join([anchor % 10] * 3)), doc % (4, ",".join([anchor % 1] * 3)), doc % (3, ",".join([anchor % 1] * 2)), doc % (3, ",".join([anchor % 11] + [anchor % 1] * 2)), doc % (3, ",".join([anchor % 1] * 2 + [anchor % 11]))]
    df = templates.parse(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, json string"), schemas.PREPROCESSING_TEMPLATE)
    first = {r.id: r.message for r in validation.first_violations(validation.preprocessing_violations(df)).collect()}
    assert first == {"1": "blurSize must be odd", "2": "each page must have at least 3 anchors", "3": "center is out of bounds"}
    strict = {r.id for r in validation.preprocessing_violations(df, all_anchors=True).collect()}
    assert "4" in strict


def test_first_and_count_by_row(spark):
    anchor = '{"image":"x","center":{"x":%d,"y":1},"roi":{"min":{"x":0,"y":0},"max":{"x":5,"y":5}}}'
    doc = '{"width":10,"height":10,"config":{"blurSize":3,"morphCloseSize":%d,"minAnchorConfidence":0.5,"adaptiveBlockSize":91},"pages":[null,{"anchors":[%s]},{}]}'
    texts = [("a", doc % (3, ",".join([anchor % 10] * 3))), ("b", doc % (-1, ",".join([anchor % 11, anchor % 1]))), ("b", doc % (-1, "")), ("c", None)]
    df = templates.parse(spark.createDataFrame(texts, "id string, json string"), schemas.PREPROCESSING_TEMPLATE).repartition(2)
    found = validation.preprocessing_violations(df)
    want = {r.id: (r.message, r.n) for r in validation.first_violations(found).join(found.groupBy("id").agg(F.count("*").alias("n")), "id").collect()}
    few = "each page must have at least 3 anchors"
    assert want == {"a": (few, 2), "b": ("morphCloseSize must be nonnegative", 2 + 3 + 2 + 3), "c": ("at least one page must be included", 4)}
    assert {r.id: (r.message, r.violations) for r in validation.first_and_count(df, validation.preprocessing_rules(F.col("template"))).collect()} == want


def test_ids_that_repeat_on_any_page(spark):
    question = '{"id":"%s","bubbleWidth":1,"bubbleHeight":1,"options":[{"label":"A","x":1,"y":1}]}'
    page = lambda *ids: '{"questions":[%s]}' % ",".join(question % i for i in ids)
    (one,) = templates.parse(spark.createDataFrame([("1", '{"pages":[%s,{},null,%s]}' % (page("x", "y", "x"), page("z", "x", "y")))], "id string, json string"), schemas.MARKING_TEMPLATE).select("id", "template").collect()
    found = validation.marking_violations(spark.createDataFrame([one, one], "id string, template " + schemas.MARKING_TEMPLATE.simpleString()))
    got = sorted((list(r.position), r.message) for r in found.where("message like '%duplicate%'").collect())
    assert got == [x for x in [([2, 0, 2, 0], 'pages[0]: duplicate question id "x"'), ([2, 3, 1, 0], 'pages[3]: duplicate question id "x"'), ([2, 3, 2, 0], 'pages[3]: duplicate question id "y"')] for _ in range(2)]


@pytest.mark.parametrize("name", ["scan_template_violations", "template_violations"])
def test_violations_are_grouped_where_their_ids_meet(spark, name):
    from tallymark.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # from the root down: what sorts and groups texts comes before the exchange of slim rows; nothing is exploded below it
    assert plan.rindex("Sort") < plan.index("Exchange") and "Generate" not in plan


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("scans").count() == 0
    scans = spark.createDataFrame([("s1", "t", 10), ("s2", "t", 20), ("s3", "t", 30)], "id string, preprocessing_template_id string, created_at_unix_ms long")
    there = spark.createDataFrame([(f"{s}p{i}", i, s) for s in ("s1", "s2", "s3") for i in (1, 0)], "id string, page_index int, scan_id string")
    store.save_scans(scans, there)
    assert [r.page_index for r in store.scan_pages("s2").collect()] == [0, 1]
    assert store.one_page("s2", 1).first().id == "s2p1"
    assert store.delete_scans_before(20) == 1 and {r.id for r in store.read("scans").collect()} == {"s2", "s3"}
    assert store.read("scan_pages").count() == 4
    unknown = spark.createDataFrame([("nobody",)], "id string")
    assert store.delete_scans(unknown) == 0
    saved = store.save_marking_templates(parsed(spark, TEMPLATE)).first()
    assert store.by_id("marking_templates", saved.id).count() == 1
    anchors = spark.createDataFrame([("t", 0, 0, (1, 2, 0, bytearray(b"ab")))], schema="template_id string, page_index int, anchor_index int, matrix struct<rows:int,cols:int,type:int,data:binary>")
    store.save_preprocessing_templates(spark.createDataFrame([("t", '{"image":"abc"}')], "id string, json string"), anchors)
    assert store.by_id("preprocessing_templates", "t").first().json == '{"image":""}'
    assert {r.part: r.bytes for r in store.usage().collect()} == {"matrices": 2}
    wanted = spark.createDataFrame([("t", 3)], "template_id string, n long")
    assert store.heal(wanted) == 1 and store.read("anchors").count() == 0


def test_results_keep_order_and_errors(spark):
    req = spark.createDataFrame([(1, k, s, "t") for k, s in enumerate(["b", "x", "a", "c"])], "job int, position int, scan_id string, template_id string")
    scans = spark.createDataFrame([("a",), ("b",), ("c",)], "scan_id string")
    got = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)], "scan_id string, page_index int")
    (row,) = results.marking_results(results.requested_scans(req, scans, got, spark.createDataFrame([("t", 2)], "template_id string, n_pages long"))).collect()
    assert row.pages_marked == 4 and [s.scan_id for s in row.scans] == ["b", "a"] and not row.failed
    assert [e.scan_id for e in row.errors] == ["x", "c"]


def test_unreadable_scans_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    scans = spark.createDataFrame([(s, "t", 10) for s in ("good", "short", "none")], "id string, preprocessing_template_id string, created_at_unix_ms long")
    rows = [("g0", 0, "good", (1, 2, 0, bytearray(b"ab"))), ("s0", 0, "short", (1, 2, 0, bytearray(b"a"))), ("n0", 0, "none", None)]
    store.save_scans(scans, spark.createDataFrame(rows, "id string, page_index int, scan_id string, binary struct<rows:int,cols:int,type:int,data:binary>"))
    assert store.heal_scans() == 2 and [r.id for r in store.read("scans").collect()] == ["good"] and store.read("scan_pages").count() == 1
    anchors = spark.createDataFrame([("t", 1, 0, (1, 1, 0, bytearray(b"a"))), ("t", 0, 1, (1, 1, 0, bytearray(b"b"))), ("t", 0, 0, (1, 1, 0, bytearray(b"c"))), ("u", 0, 0, (1, 1, 0, bytearray(b"d")))], "template_id string, page_index int, anchor_index int, matrix struct<rows:int,cols:int,type:int,data:binary>")
    store.save_preprocessing_templates(spark.createDataFrame([("t", "{}"), ("u", "{}")], "id string, json string"), anchors)
    assert [bytes(r.matrix.data) for r in store.template_anchors("t").collect()] == [b"c", b"b", b"a"]


def test_keys(spark):
    digest = hashlib.sha512(b"open").hexdigest()
    rows = [("open", digest), ("open", digest.upper()), ("shut", digest), ("", digest), (None, digest), ("any", None), (None, "")]
    df = spark.createDataFrame(rows, "key string, digest string")
    assert [r[0] for r in df.select(scalars.key_allowed("key", "digest")).collect()] == [True, True, False, False, False, True, True]


def test_fit(spark):
    df = spark.createDataFrame([(100, 200, 50, 300)], "w int, h int, tw int, th int")
    got = df.select(*[scalars.fit("w", "h", "tw", "th", how).alias(how) for how in ("contain", "cover", "fill")]).first()
    assert tuple(got) == (0.5, 1.5, 1.0)


def test_query_values(spark):
    df = spark.createDataFrame([("1",), ("-2",), ("x",), ("",), (None,), ("TRUE",), ("f",)], "v string")
    got = df.select(scalars.query_value("v", "int", 7), scalars.query_value("v", "uint", 7), scalars.query_value("v", "bool", "true"), scalars.query_value("v", "string", "d")).collect()
    assert [tuple(r) for r in got] == [(1, 1, True, "1"), (-2, None, None, "-2"), (None, None, None, "x"), (7, 7, True, "d"), (7, 7, True, "d"), (None, None, True, "TRUE"), (None, None, False, "f")]


def test_exams_and_misplaced_pages(spark):
    assert [r[0] for r in spark.range(5).select(pages.exam_of("id", F.lit(2))).collect()] == [0, 0, 1, 1, 2]
    scores = [(1, 0, 0, 0.9), (1, 0, 1, 0.95), (1, 1, 0, 0.8), (1, 1, 1, 0.2), (2, 0, 0, 0.1), (2, 0, 1, 0.3), (3, 0, 1, 0.7)]
    df = spark.createDataFrame(scores, "exam int, page int, template_page int, score double")
    assert sorted(tuple(r) for r in pages.misplaced(df).collect()) == [(1, 1, 0), (3, 0, 1)]


def test_option_groups(spark):
    df = spark.createDataFrame([(i, 2) for i in range(5)] + [(3, 0)], "i int, size int")
    assert [r[0] for r in df.select(alignment.option_group("i", "size")).collect()] == [0, 0, 1, 1, 2, 0]
    assert [r[0] for r in df.select(alignment.option_group("i", 3)).collect()] == [0, 0, 0, 1, 1, 1]


def test_wrong_jobs(spark):
    df = spark.createDataFrame([("t", ["a"]), ("", ["a"]), (None, ["a"]), ("t", []), ("t", None), ("t", ["a", ""]), ("t", [None])], "template string, scans array<string>")
    assert [r[0] for r in df.select(validation.job_violations(df)).collect()] == [None, *["template is required"] * 2, *["scans must contain at least one id"] * 2, *["scan ids cannot be empty"] * 2]


def test_results_on_the_wire(spark):
    marks = spark.createDataFrame([("s", "Q1", True, [], 0.5), ("s", "Q2", False, ["A", "B"], 1.0)], "scan_id string, question_id string, flag boolean, selected array<string>, confidence double")
    got = sorted(r.json for r in results.wire_marks(marks).collect())
    assert [json.loads(x) for x in got] == [{"questionId": "Q1", "flagged": True, "selected": None, "confidence": 0.5}, {"questionId": "Q2", "flagged": False, "selected": ["A", "B"], "confidence": 1.0}]
    exams = spark.createDataFrame([("d", 1, 3, 4, "s2", None), ("d", 0, 1, 2, "s1", None), ("d", 2, 5, 6, None, "lost"), ("e", 0, 1, 2, "", "bad")], "doc string, block int, from int, thru int, scan_id string, error string")
    found = {r.doc: (r.scan_ids, [tuple(e) for e in r.errors]) for r in results.scan_results(exams).collect()}
    assert found == {"d": (["s1", "s2"], [(5, 6, "lost")]), "e": ([], [(1, 2, "bad")])}


def test_job_states(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", at(0), "start", 0.0), ("a", at(1), "progress", 0.4), ("a", at(2), "finish", 1.0), ("a", at(3), "progress", 0.1), ("a", at(4), "finish", 0.0), ("b", at(0), "start", 0.0), ("b", at(1), "start", 0.0), ("b", at(2), "progress", 7.0)]
    events = spark.createDataFrame(rows, "job string, ts timestamp, kind string, value double")
    got = {r.job: r for r in jobs.job_states(events).collect()}
    assert got["a"].progress == 1.0 and got["a"].success and got["a"].finished == at(2)
    assert got["b"].progress == 1.0 and got["b"].finished is None and got["b"].started == at(0)
    assert [r.ts for r in jobs.start_conflicts(events).collect()] == [at(1)]
    assert jobs.last_items(events, 0, "ts", "job").count() == 0 and jobs.last_items(events, 99, "ts", "job").count() == 8


def ran(stream, tmp_path, name):
    """All rows that a stream puts out over what is there, in order."""
    rows = []
    q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return rows


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    source, kinds = str(tmp_path / "in"), "job string, ts timestamp, kind string, value double"
    for rows in ([("a", at(0), "start", 0.0), ("a", at(1), "progress", 0.5)], [("a", at(2), "finish", 1.0), ("a", at(3), "progress", 0.2), ("b", at(4), "progress", 0.3)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
    states = [r for r in ran(jobs.stream_job_states(stream), tmp_path, "states") if r.job == "a"]
    assert states[-1].success and states[-1].progress == 1.0 and states[-1].finished == at(2) and states[-1].n_events == 3
    rings = [r["items"] for r in ran(jobs.stream_last_items(stream, 2, "job", "ts", "value"), tmp_path, "rings") if r.job == "a"]
    assert rings[-1] == [1.0, 0.2]
    assert max(r.peak for r in ran(jobs.stream_peaks(stream, "ts", "value", "2 seconds", "1 hour"), tmp_path, "peaks")) == 1.0
