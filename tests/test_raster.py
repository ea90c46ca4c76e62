"""Pixels: masks, thresholds, anchors, warps, and sheets from end to end."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pixel_arrays
import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import raster
from tallymark.plans import marking_job, queries
from tallymark.sources import matrices, templates


def page(*discs, size=400, radius=11):
    y, x = np.mgrid[:size, :size]
    out = np.zeros((size, size), dtype=np.uint8)
    for cx, cy in discs:
        out[(x - cx) ** 2 + (y - cy) ** 2 <= radius**2] = 255
    return out


def template(kind="", **config):
    options = ",".join(f'{{"label":"{c}","x":{x},"y":115}}' for c, x in zip("ABC", (65, 115, 165), strict=True))
    question = f'{{"id":"Q1","bubbleWidth":30,"bubbleHeight":30,"type":"{kind}","options":[{options}]}}'
    config = {"fillThreshold": 0.5, "bubbleInset": 0.75, "flagThreshold": 0.5} | config
    fields = ",".join(f'"{k}":{v}' for k, v in config.items())
    return f'{{"config":{{{fields}}},"pages":[{{"questions":[{question}]}}]}}'


def answers(spark, pixels, text):
    t = templates.parse(spark.createDataFrame([("t", text)], "id string, json string"), schemas.MARKING_TEMPLATE)
    rows = spark.createDataFrame([("s", "t", i, matrices.to_row(p)) for i, p in enumerate(pixels)], f"scan_id string, template_id string, page_index int, binary {schemas.MATRIX.simpleString()}")
    return marking_job.mark_pages(rows, templates.questions(t)).orderBy("page_index").collect()


# Places and sizes of the original's synthetic sheet
A, B, C = (65, 115), (115, 115), (165, 115)


@pytest.mark.parametrize(
    ("discs", "kind", "selected", "flag"),
    [((A,), "", ["A"], False), ((), "", [], True), ((A, B), "", ["A", "B"], True), ((A, B), "multi", ["A", "B"], False)],
)
def test_sheets(spark, discs, kind, selected, flag):
    (row,) = answers(spark, [page(*discs)], template(kind))
    assert (row.selected, row.flag) == (selected, flag)
    assert [(b.x, b.y, b.width) for b in row.boxes] == [(50, 100, 30), (100, 100, 30), (150, 100, 30)]
    assert tuple(row.bounds) == (50, 100, 130, 30)


def test_a_shifted_row_is_found_within_its_radius(spark):
    shifted = [(x + 8, y + 8) for x, y in (A, B, C)]
    (row,) = answers(spark, [page(*shifted)], template())
    assert row.selected == []
    (row,) = answers(spark, [page(*shifted, radius=15)], template(searchRadius=8))
    assert row.selected == ["A", "B", "C"] and row.flag
    assert [(b.x, b.y) for b in row.boxes] == [(58, 108), (108, 108), (158, 108)]


def test_job_with_errors(spark):
    t = templates.parse(spark.createDataFrame([("t", template())], "id string, json string"), schemas.MARKING_TEMPLATE)
    req = spark.createDataFrame([(1, 0, "s1", "t"), (1, 1, "gone", "t"), (1, 2, "s2", "t")], "job int, position int, scan_id string, template_id string")
    pages_ = spark.createDataFrame([("s1", 0, matrices.to_row(page(A))), ("s2", 0, matrices.to_row(page(A)))], f"scan_id string, page_index int, binary {schemas.MATRIX.simpleString()}")
    _, result = marking_job.run_job(req, spark.createDataFrame([("s1",), ("s2",)], "id string"), pages_, t)
    (row,) = result.collect()
    assert row.pages_marked == 2 and [e.scan_id for e in row.errors] == ["gone"]
    assert [s.marks[0].selected for s in row.scans] == [["A"], ["A"]]


def test_pages_that_cannot_be_marked(spark):
    two = template().replace('"pages":[', '"pages":[{"questions":[]},')
    docs = spark.createDataFrame([("t", template()), ("two", two)], "id string, json string")
    t = templates.parse(docs, schemas.MARKING_TEMPLATE)
    good, empty = matrices.to_row(page(A)), {"rows": 0, "cols": 0, "type": 0, "data": b""}
    rows = [("none", 0, None), ("good", 0, good), ("empty", 0, empty), ("halves", 0, good), ("halves", 1, None)]
    pages_ = spark.createDataFrame(rows, f"scan_id string, page_index int, binary {schemas.MATRIX.simpleString()}").coalesce(1)
    req = spark.createDataFrame([(1, k, s, "two" if s == "halves" else "t") for k, s in enumerate(["none", "good", "empty", "halves"])], "job int, position int, scan_id string, template_id string")
    _, result = marking_job.run_job(req, spark.createDataFrame([(s,) for s in ("none", "good", "empty", "halves")], "id string"), pages_, t)
    (row,) = result.collect()
    assert row.pages_marked == 1 and [(s.scan_id, s.marks[0].selected) for s in row.scans] == [("good", ["A"])]
    assert [(e.scan_id, e.error) for e in row.errors] == [
        ("none", "page 0: cannot evaluate an empty image"),
        ("empty", "page 0: cannot evaluate an empty image"),
        ("halves", "page 0: mark template contains no questions"),
    ]


def test_a_null_page_beside_a_good_one(spark):
    df = spark.createDataFrame([(1, matrices.to_row(page(A)), (0, 0, 10, 10)), (2, None, (0, 0, 10, 10))], f"k int, picture {schemas.MATRIX.simpleString()}, bounds struct<x:int,y:int,width:int,height:int>").coalesce(1)
    assert [r.snippet is None for r in raster.crop(df).orderBy("k").collect()] == [False, True]
    assert matrices.from_row({"rows": 2.0, "cols": 1.0, "data": b"ab"}).shape == (2, 1)
    assert matrices.from_row({"rows": float("nan"), "cols": float("nan"), "data": b"ab"}) is None


def test_alignment_without_a_valid_offset():
    shapes = pixel_arrays.masks(30, 30, 0.75, 0.4)
    blank, full = np.zeros((400, 400), dtype=np.uint8), np.full((400, 400), 255, dtype=np.uint8)
    assert pixel_arrays.align(blank, [A, B, C], shapes, 0.0, 4) == (0, 0) == pixel_arrays.align(blank, [A, B, C], shapes, 0.25, 4)
    full[:119, :] = 0  # ink only below: the guards would move down
    assert pixel_arrays.align(full, [(65, 100), (115, 100)], shapes, 0.0, 1) == (0, 0)


def test_surface_by_brute_force():
    rng = np.random.default_rng(1)
    p = (rng.random((60, 70)) < 0.4).astype(np.uint8) * 255
    for cx, cy, r in ((30, 30, 5), (8, 50, 9), (69, 1, 3)):
        mask = raster.disk(15, 13, 6)
        want = [[pixel_arrays.fill_ratio(p, cx + dx, cy + dy, mask) for dx in range(-r, r + 1)] for dy in range(-r, r + 1)]
        assert (pixel_arrays._surface(p, cx, cy, mask, r) == np.array(want)).all()


def test_disks():
    assert raster.disk(7, 7, 0).sum() == 1 and raster.disk(9, 9, 1).sum() == 5
    big = raster.disk(61, 61, 25)
    assert abs(big.sum() - np.pi * 25**2) < 60 and (big == big[::-1]).all() and (big == big.T).all()
    assert raster.disk(5, 5, -1).sum() == 0


def test_files():
    m = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (matrices.decode(matrices.encode(m)) == m).all()
    for bad in (b"", b"123456789012", matrices.encode(m)[:-3]):
        with pytest.raises(ValueError):
            matrices.decode(bad)


def test_matrix_files(spark, tmp_path):
    (tmp_path / "a.m4t").write_bytes(matrices.encode(page(A)))
    (tmp_path / "b.m4t").write_bytes(b"not one")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in matrices.read_matrix_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.m4t", "b.m4t"} and got["b.m4t"].error
    assert (matrices.from_row(got["a.m4t"].matrix) == page(A)).all()


def test_binarize():
    gray = np.full((120, 120), 220, dtype=np.uint8)
    gray[40:60, 40:60] = 20
    out = raster.binarize(gray, 3, 3, 31, 10.0)
    assert out[50, 50] == 255 and out[10, 10] == 0
    flat = raster.binarize(np.full((30, 30), 90, dtype=np.uint8), 3, 0, 11, -5.0)
    assert (flat == 255).all()
    with pytest.raises(raster.PageError):
        raster.binarize(np.zeros((0, 0), dtype=np.uint8), 3, 3)
    with pytest.raises(ValueError, match="odd"):
        raster.binarize(gray, 4, 3)


def test_anchor():
    field = np.zeros((300, 300), dtype=np.uint8)
    field[105:155, 105:155] = 255
    pattern = np.zeros((60, 60), dtype=np.uint8)
    pattern[5:55, 5:55] = 255
    x, y = raster.find_anchor(field, pattern, (0, 0, 300, 300), 0.5)
    assert abs(x - 130) <= 2 and abs(y - 130) <= 2
    with pytest.raises(raster.PageError):
        raster.find_anchor(field, pattern, (0, 0, 300, 300), 2.0)


def test_anchor_turns_share_the_fields_transform(monkeypatch):
    rng = np.random.default_rng(4)
    page = np.where(raster.blur(rng.integers(0, 256, (97, 89)).astype(np.uint8), 9) > 128, 255, 0).astype(np.uint8)
    pattern = page[31:54, 40:57].copy()
    calls = []
    rfft2 = np.fft.rfft2
    monkeypatch.setattr(np.fft, "rfft2", lambda *args: calls.append(1) or rfft2(*args))
    want = raster.find_anchor(page, pattern, (10, 5, 83, 88), 0.3)
    first, calls = len(calls), calls.clear() or calls
    # a second page with the same pattern: one transform, of its region; there were two for each turn
    assert raster.find_anchor(page, pattern, (10, 5, 83, 88), 0.3) == want == (40 + 8, 31 + 11) and len(calls) == 1 < first
    # the score at each place is the correlation coefficient, by brute force, also where all is blank
    page[5:40, 10:40] = 0
    spectrum, power, shape = raster._field_parts(page[5:88, 10:83], *pattern.shape)
    own, strength = raster._pattern_parts(pattern.tobytes(), pattern.shape, 1.5, shape)
    cross = np.fft.irfft2(spectrum * own, shape)[22 : 22 + power.shape[0], 16 : 16 + power.shape[1]]
    turned = raster.rotate(pattern, 1.5).astype(float).ravel()
    for y, x in ((0, 0), (3, 2), (26, 30), (40, 41), (60, 56)):
        part = page[5 + y : 28 + y, 10 + x : 27 + x].astype(float).ravel()
        product = ((part - part.mean()) * (turned - turned.mean())).sum()
        assert abs(cross[y, x] - product) < 1e-3 and abs(power[y, x] * strength - ((part - part.mean()) ** 2).sum() * ((turned - turned.mean()) ** 2).sum()) < 1e-3 * max(1, power[y, x] * strength)


def test_pages_warped_together():
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (20, 31)).astype(np.uint8) for _ in range(2)]
    forward = np.array([[1.1, 0.2, -3.5], [-0.1, 0.9, 2.25]])
    back = np.linalg.inv(np.vstack([forward, [0, 0, 1]]))
    for page, got in zip(pages, raster.warp_all(pages, forward, 40, 25), strict=True):
        for v, u in itertools.product(range(25), range(40)):
            x, y = back[0, 0] * u + back[0, 1] * v + back[0, 2], back[1, 0] * u + back[1, 1] * v + back[1, 2]
            x0, y0 = math.floor(x), math.floor(y)
            level = sum(float(page[j, i]) * abs(1 - abs(x - i)) * abs(1 - abs(y - j)) for i in (x0, x0 + 1) for j in (y0, y0 + 1) if 0 <= i < 31 and 0 <= j < 20)
            assert abs(got[v, u] - level) <= 0.5 + 1e-6


def test_warp_and_lines():
    out = raster.warp(page(A, size=200), np.array([[1.0, 0, 5], [0, 1, 5]]), 200, 200)
    assert out[120, 70] == 255 and out[0, 0] == 0
    assert raster.in_a_line([(0, 0), (1, 1), (2, 2)]) and not raster.in_a_line([(0, 0), (1, 1), (2, 3)])


def test_resize():
    p = np.kron(np.array([[0, 200], [100, 50]], dtype=np.uint8), np.ones((10, 10), dtype=np.uint8))
    assert (raster.resize(p, 2, 2) == [[0, 200], [100, 50]]).all()
    assert raster.resize(p, 40, 40).shape == (40, 40)


def sheet_with_anchors(size=300):
    gray = np.full((size, size), 230, dtype=np.uint8)
    for k, (cx, cy) in enumerate([(40, 40), (260, 40), (40, 260)]):
        gray[cy - 12 : cy + 12, cx - 12 : cx + 12] = 10
        gray[cy - 4 : cy + 4 + 3 * k, cx - 4 : cx + 4] = 230
    return gray


def test_pages_are_straightened_and_turned(spark):
    gray = sheet_with_anchors()
    binary = raster.binarize(gray, 3, 3, 91, 5.0)
    corners = [(40, 40), (260, 40), (40, 260)]
    patterns = [binary[y - 20 : y + 20, x - 20 : x + 20] for x, y in corners]
    anchors = [{"image": "x", "center": {"x": x, "y": y}, "roi": {"min": {"x": max(0, x - 40), "y": max(0, y - 40)}, "max": {"x": min(300, x + 40), "y": min(300, y + 40)}}} for x, y in corners]
    doc = {"width": 300, "height": 300, "config": {"blurSize": 3, "morphCloseSize": 3, "minAnchorConfidence": 0.8, "adaptiveBlockSize": 91, "adaptiveC": 5.0}, "pages": [{"anchors": anchors}]}
    rows = [(i, 0, matrices.to_row(g), doc, [matrices.to_row(p) for p in patterns]) for i, g in enumerate([gray, gray[::-1, ::-1], np.full((300, 300), 200, dtype=np.uint8)])]
    m = schemas.MATRIX.simpleString()
    df = spark.createDataFrame(rows, f"id int, page_index int, gray {m}, template {schemas.PREPROCESSING_TEMPLATE.simpleString()}, patterns array<{m}>")
    got = raster.preprocess_pages(df).orderBy("id").collect()
    assert [r.turned for r in got] == [False, True, None] and got[2].error
    for r in got[:2]:
        assert (matrices.from_row(r.binary) != binary).mean() < 0.02


def test_crop(spark):
    m = schemas.MATRIX.simpleString()
    df = spark.createDataFrame([(matrices.to_row(page(A)), (-5, 100, 75, 30))], f"picture {m}, bounds struct<x:int,y:int,width:int,height:int>")
    out = matrices.from_row(raster.crop(df).first().snippet)
    assert out.shape == (30, 75) and out[15, 70] == 255 and (out[:, :5] == 0).all()


def test_images_to_gray(spark):
    rgb = np.zeros((120, 130, 3), dtype=np.uint8)
    rgb[:, :, 2] = 255
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame([(("a", 120, 130, 3, 16, bytearray(rgb.tobytes())),), (("b", 50, 130, 1, 0, bytearray(50 * 130)),)], f"image {kind}")
    red, small = matrices.gray_of_images(df).select(F.col("matrix")).collect()
    assert matrices.from_row(red.matrix)[0, 0] == 76 and small.matrix is None


def test_pixels_leave_a_worker_in_portions(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, work, schema: work)

    def parts(work, batch, column):
        """The frames that a worker gives, none of which holds much more than a portion; it gave a whole batch as one."""
        frames = list(work(iter([batch])))
        pixels = [[0 if m is None else len(m["data"]) for m in f[column]] for f in frames]
        assert len(frames) > 1 and all(sum(some[:-1]) < matrices.PORTION_BYTES for some in pixels)
        return pd.concat(frames)

    docs = parts(queries.drawn_exams(spark, "/root/testdata/sf0.001"), pd.DataFrame({"doc": range(140)}), "gray")
    assert list(zip(docs["doc"], docs["page"], strict=True)) == [(k, i) for k in range(140) for i in range(3 if k % 7 == 6 else 2)]
    sheets = parts(queries.drawn_pages(spark, "/root/testdata/sf0.001"), pd.DataFrame({"scan_id": range(1000), "p_size": 1}), "binary")
    assert list(sheets["scan_id"]) == list(range(1000)) and [m is None for m in sheets["binary"]] == [k % 10 == 0 for k in range(1000)]

    kind, template = schemas.MATRIX.simpleString(), queries.exam_template(spark).first()
    known = json.dumps({"width": 160, "height": 160, "config": template.template.config.asDict(), "anchors": [a.asDict(True) for a in template.template.pages[0].anchors]})
    n = 180
    gray = [matrices.to_row(queries.exam_page(0)) if k % 50 else None for k in range(n)]
    batch = pd.DataFrame({"doc": range(n), "gray": gray, "text": known, "patterns": [template.grid[0]] * n})
    found = parts(raster.locate_anchors(spark.createDataFrame([], f"doc long, gray {kind}, text string, patterns array<{kind}>"), template_page="text"), batch, "binary")
    assert list(found["doc"]) == list(range(n)) and list(found["error"].isna()) == [bool(k % 50) for k in range(n)]
    found["map"], found["size"] = [{"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}] * n, [{"width": 200, "height": 200}] * n
    straight = parts(raster.warp_pages(spark.createDataFrame([], f"gray {kind}, points array<double>, map map<string,double>, size map<string,int>, binary {kind}, turned boolean, error string, error_class string")), found, "picture")
    assert list(straight["doc"]) == list(range(n)) and [m is None for m in straight["binary"]] == [k % 50 == 0 for k in range(n)]
    cut = parts(raster.crop(spark.createDataFrame([], f"doc long, picture {kind}, bounds map<string,int>")), straight[["doc", "picture"]].assign(bounds=[{"x": 0, "y": 0, "width": 300, "height": 100}] * n), "snippet")
    assert list(cut["doc"]) == list(range(n)) and [m is None for m in cut["snippet"]] == [k % 50 == 0 for k in range(n)]


def test_regions_without_contrast_match_nothing():
    pattern = np.zeros((9, 9), dtype=np.uint8)
    pattern[2:7, 3:5] = 255
    for level in (0, 255):
        field = np.full((40, 40), level, dtype=np.uint8)
        with pytest.raises(raster.PageError, match="0.00"):
            raster.find_anchor(field, pattern, (5, 5, 35, 35), 0.8)
        assert raster.find_anchor(field, pattern, (5, 5, 35, 35), 0.0) == (9, 9)
