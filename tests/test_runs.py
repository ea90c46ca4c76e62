"""Run lengths and interval joins, held against arrays of pixels."""

import numpy as np
import pixel_arrays
import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import intervals, raster, runs
from tallymark.sources import cuts, matrices, templates

M = schemas.MATRIX.simpleString()


def test_runs_of_pages(spark):
    rng = np.random.default_rng(1)
    pages = {"a": (rng.random((9, 150)) < 0.5).astype(np.uint8) * 255, "b": np.zeros((4, 5), np.uint8), "c": np.full((3, 7), 255, np.uint8), "d": np.eye(6, dtype=np.uint8), "e": np.array([[0, 10, 13, 32, 0]], np.uint8)}
    rows = [(k, matrices.to_row(p)) for k, p in pages.items()] + [("null", None), ("short", {"rows": 2, "cols": 2, "type": 0, "data": b"abc"}), ("empty", {"rows": 0, "cols": 0, "type": 0, "data": b""})]
    got = runs.ink_runs(spark.createDataFrame(rows, f"k string, binary {M}"), ["k"]).collect()
    for k, p in pages.items():
        drawn = np.zeros(p.shape, dtype=bool)
        for r in got:
            if r.k == k:
                assert r.x0 < r.x1 and not drawn[r.y, max(0, r.x0 - 1) : r.x1 + 1].any()
                drawn[r.y, r.x0 : r.x1] = True
        assert (drawn == (p != 0)).all()
    assert {r.k for r in got} <= set(pages)


def test_overlaps_by_hand(spark):
    rng = np.random.default_rng(2)
    left = [(int(rng.integers(2)), i, int(a), int(a + rng.integers(0, 90))) for i, a in enumerate(rng.integers(-50, 200, 60))]
    right = [(int(rng.integers(2)), i, int(a), int(a + rng.integers(0, 90))) for i, a in enumerate(rng.integers(-50, 200, 60))]
    a = intervals.pieces(spark.createDataFrame(left, "k int, l int, x0 int, x1 int"), "x0", "x1", 32)
    b = intervals.touched(spark.createDataFrame(right, "k int, r int, y0 int, y1 int"), F.col("y0"), F.col("y1"), 32)
    met = a.join(b, ["k", "bin"]).select("l", "r", intervals.overlap(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).alias("n")).groupBy("l", "r").agg(F.sum("n").alias("n")).where("n > 0")
    want = {(i, j, min(x1, y1) - max(x0, y0)) for k, i, x0, x1 in left for q, j, y0, y1 in right if k == q and min(x1, y1) > max(x0, y0)}
    assert {tuple(r) for r in met.collect()} == want


def test_disks_as_rows(spark):
    got = runs.disk_rows(spark.range(0, 16).select(F.col("id").cast("int").alias("radius"))).collect()
    for radius in range(16):
        drawn = np.zeros((41, 41), dtype=bool)
        for r in got:
            if r.radius == radius and r.reach >= 0:
                drawn[20 + r.dy, 20 - r.reach : 20 + r.reach + 1] = True
        assert (drawn == raster.disk(41, 41, radius)).all()


def sheet(seed, size=180):
    """A page with discs near its bubbles, some of them shifted, and specks."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    out = (rng.random((size, size)) < 0.02).astype(np.uint8) * 255
    shift = rng.integers(-3, 4, 2)
    for cx, cy in ((30, 40), (70, 40), (110, 40), (150, 40), (30, 100), (70, 100), (5, 170)):
        if rng.random() < 0.6:
            out[(x - cx - shift[0]) ** 2 + (y - cy - shift[1]) ** 2 <= rng.integers(5, 13) ** 2] = 255
    return out


def template(**config):
    option = lambda c, x, y: f'{{"label":"{c}","x":{x},"y":{y}}}'
    question = lambda i, w, h, options: f'{{"id":"Q{i}","bubbleWidth":{w},"bubbleHeight":{h},"options":[{",".join(options)}]}}'
    some = [question(1, 26, 26, [option(c, x, 40) for c, x in zip("ABCD", (30, 70, 110, 150), strict=True)]), question(2, 21, 30, [option("A", 30, 100), option("B", 70, 100)]), question(3, 20, 20, [option("A", 5, 170)]), question(4, 24, 10, [option("A", 110, 100)])]
    fields = ",".join(f'"{k}":{v}' for k, v in config.items())
    return f'{{"config":{{{fields}}},"pages":[{{"questions":[{",".join(some)}]}}]}}'


@pytest.mark.parametrize("config", [{}, {"searchRadius": 4}, {"searchRadius": 2, "searchGroupSize": 2, "groupSearchRadius": 3, "labelInset": 0.0}, {"bubbleInset": 1.5, "labelInset": 2.0, "searchRadius": 1}])
def test_fills_are_those_of_arrays(spark, config):
    t = templates.parse(spark.createDataFrame([("t", template(**config))], "id string, json string"), schemas.MARKING_TEMPLATE)
    questions = templates.questions(t)
    rows = [(f"s{i}", "t", 0, matrices.to_row(sheet(i))) for i in range(8)]
    pages = spark.createDataFrame(rows, f"scan_id string, template_id string, page_index int, binary {M}")
    want = {(f"s{i}", q.ordinal): pixel_arrays.question_fills(sheet(i), q.question, q.settings) for i in range(8) for q in questions.collect()}
    got = {(r.scan_id, r.ordinal): (r.fills, r.dxs, r.dys) for r in runs.measured(pages, questions).collect()}
    assert got == want and len(got) == 32
    assert any(any(dx) for _, dx, _ in got.values()) == bool(config.get("searchRadius"))


def test_a_side_too_large_to_send_is_salted(spark):
    small = cuts.cut(spark.createDataFrame([("t", i, f"v{i}") for i in range(5)], "k string, i int, v string"), "small")
    large = spark.range(200).select(F.lit("t").alias("k"), (F.col("id") % 6).cast("int").alias("i"), "id")
    want = sorted(cuts.join_small(large, small, ["k", "i"]).collect(), key=str)
    salted = cuts.join_small(large, small, ["k", "i"], limit=0)
    assert sorted(salted.collect(), key=str) == want and len(want) == 200 and sum(r.v is None for r in want) == 33
    cuts.drop(small)


def test_lines_of_one_run_and_of_several(spark):
    lines = [b"\x00\x00\x00\x00", b"\xff\xff\xff\xff", b"\x00\x01\xff\x00", b"\xff\x00\x00\xff", b"\x00\x00\x00\x80", b"\x20\x00\x20\x00"]
    page = [("p", {"rows": len(lines), "cols": 4, "data": b"".join(lines)})]
    got = sorted((r.y, r.x0, r.x1) for r in runs.ink_runs(spark.createDataFrame(page, f"k string, binary {M}"), ["k"]).collect())
    assert got == [(1, 0, 4), (2, 1, 3), (3, 0, 1), (3, 3, 4), (4, 3, 4), (5, 0, 1), (5, 2, 3)]


def test_drawn_sheets_are_stored_before_they_are_marked(spark):
    from tallymark.plans import queries

    # what asks for scans and their pages by id reads stored columns; it drew all pages again
    assert "MapInPandas" not in queries.mark_drawn_sheets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_small_files_are_not_sent_whole(spark):
    # ids beside one text take little in files, and much in the driver's memory, which is what counts
    many = cuts.cut(spark.range(cuts.MANY_ROWS + 1).select("id", F.lit("sheet").alias("t")), "many")
    few = cuts.cut(spark.range(5000).select("id", F.lit("sheet" * 40).alias("t")), "few")
    large = spark.range(0, 300_000, 3).withColumn("x", F.col("id") * 2)
    for small, limit, found in ((many, 1 << 20, 33_334), (few, 1 << 18, 1_667)):
        assert cuts.table_bytes(small) < limit < cuts.memory_of(small)[1]
        met = cuts.join_small(large, small, ["id"], "inner", limit=limit)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in plan and ("shuffle_hash" in plan) == (small is many)
        assert met.where("t like 'sheet%' and x = 2 * id").count() == found
    assert "broadcast" in cuts.join_small(large, few, ["id"], "inner")._jdf.queryExecution().optimizedPlan().toString()
    for small in (many, few):
        cuts.drop(small)


def test_memory_of_nested_rows(spark):
    rows = cuts.cut(spark.createDataFrame([(1, [["ab", None]], {"k": b"xyz"}), (2, None, None)], "a int, b array<array<string>>, c map<string,binary>"), "nested")
    n, size = cuts.memory_of(rows)
    assert n == 2 and 100 < size < 400
    cuts.drop(rows)


def test_pixels_asked_for_by_many_scans_are_shuffled_once(spark, monkeypatch):
    from tallymark.plans import queries

    want = sorted(queries.mark_drawn_sheets(spark, "/root/testdata/sf0.001").collect(), key=str)
    monkeypatch.setattr(cuts, "MANY_ROWS", 50)
    monkeypatch.setattr(cuts.join_small, "__defaults__", ("left", 16, 2000))
    got = queries.mark_drawn_sheets(spark, "/root/testdata/sf0.001")
    assert sorted(got.collect(), key=str) == want and len(want) == 200


def test_ids_are_not_gathered_in_the_driver(spark):
    from tallymark.operators import results
    from tallymark.plans import scanning

    ids = cuts.cut(spark.range(1000).select(F.col("id").alias("scan_id"), F.lit(0).alias("page_index")), "ids")
    requests = ids.select(F.lit(1).alias("job"), F.col("scan_id").alias("position"), "scan_id", F.lit("t").alias("template_id"))
    sizes = spark.createDataFrame([("t", 1)], "template_id string, n_pages int")
    found = results.requested_scans(requests, ids.select("scan_id"), ids, sizes)
    assert found._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") == 2
    assert found.where("error is null and n_pages = 1").count() == 1000
    straight = ids.select(F.col("scan_id").alias("doc"), F.lit(1).alias("n_places"), F.lit(0).cast("long").alias("exam"), F.lit(0).alias("place"), F.lit(0).alias("template_page"), F.lit(None).cast("string").alias("error_class"))
    outcomes = scanning.exam_outcomes(straight)
    assert "BroadcastHashJoin" not in outcomes._jdf.queryExecution().executedPlan().toString()
    assert outcomes.where("error is null").count() == 1000
    cuts.drop(ids)
