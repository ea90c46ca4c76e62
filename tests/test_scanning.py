"""Scanning: encoded anchors, templates and scans read back, and pages to exams."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions import scalars as S
from tallymark.operators import raster, results
from tallymark.plans import scanning
from tallymark.sources import matrices
from tallymark.sources.store import Store

M = schemas.MATRIX.simpleString()
SIDE = 240
#: Corners in which each page of the two-page template has its marks.
CORNERS = [[(40, 40), (200, 40), (40, 200)], [(40, 40), (200, 40), (200, 200)]]


def png(samples, color, rules=(0,), bits=8):
    """An image file whose rows take these filters in turn."""
    h, w = samples.shape[:2]
    flat = samples.reshape(h, -1)
    if bits == 16:
        flat = np.repeat(flat, 2, axis=1)
    step = flat.shape[1] // w
    wide = np.zeros((h + 1, flat.shape[1] + step), dtype=int)
    wide[1:, step:] = flat
    body = b""
    for y in range(h):
        rule = rules[y % len(rules)]
        left, up, corner = wide[y + 1, :-step], wide[y, step:], wide[y, :-step]
        near = np.stack([left, up, corner])
        paeth = np.take_along_axis(near, np.abs(left + up - corner - near).argmin(axis=0)[None], 0)[0]
        guess = [0 * left, left, up, (left + up) // 2, paeth][rule]
        body += bytes([rule]) + ((flat[y].astype(int) - guess) % 256).astype(np.uint8).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    palette = chunk(b"PLTE", bytes(range(30))) if color == 3 else b""
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, 0)) + palette + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [8, 16])
def test_images_with_all_filters(bits):
    rng = np.random.default_rng(1)
    gray = rng.integers(0, 256, (12, 17), dtype=np.uint8)
    assert (matrices.decode_image(png(gray, 0, (0, 1, 2, 3, 4), bits)) == gray).all()
    rgb = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    want = matrices.gray_levels(rgb)
    assert (matrices.decode_image(png(rgb, 2, (4, 3, 2, 1), bits)) == want).all()
    alpha = np.dstack([rgb, rgb[..., :1]])
    assert (matrices.decode_image(png(alpha, 6, (3, 4), bits)) == want).all()
    assert (matrices.decode_image(matrices.encode(gray)) == gray).all()


def test_images_with_palettes_and_broken_ones():
    at = np.arange(10, dtype=np.uint8).reshape(2, 5)
    want = matrices.gray_levels(np.arange(30, dtype=np.uint8).reshape(2, 5, 3))
    assert (matrices.decode_image(png(at, 3)) == want).all()
    good = png(at, 0)
    for bad in (b"", b"GIF89a", good[:30], good[:50], png(at + 1, 3), good.replace(b"IDAT", b"XDAT")):
        with pytest.raises(ValueError):
            matrices.decode_image(bad)


def drawn(index):
    """A gray page of the template with a different mark in each corner."""
    gray = np.full((SIDE, SIDE), 230, dtype=np.uint8)
    for k, (x, y) in enumerate(CORNERS[index]):
        gray[y - 12 : y + 12, x - 12 : x + 12] = 10
        gray[y - 4 : y + 4 + 3 * k, x - 4 : x + 4] = 230
    return gray


def document(broken=None):
    def anchor(i, x, y):
        image = drawn(i)[y - 20 : y + 20, x - 20 : x + 20]
        return {"image": base64.b64encode(png(image, 0, (4,))).decode() if broken is None else broken, "center": {"x": x, "y": y}, "roi": {"min": {"x": max(0, x - 40), "y": max(0, y - 40)}, "max": {"x": min(SIDE, x + 40), "y": min(SIDE, y + 40)}}}

    pages = [{"anchors": [anchor(i, x, y) for x, y in CORNERS[i]]} for i in (0, 1)]
    return json.dumps({"width": SIDE, "height": SIDE, "config": {"blurSize": 3, "morphCloseSize": 3, "minAnchorConfidence": 0.8, "adaptiveBlockSize": 91, "adaptiveC": 5.0}, "pages": pages})


def test_documents_to_exams_and_back(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = [("t", document()), ("bad", document("!!")), ("text", document(base64.b64encode(b"no image at all").decode())), ("junk", "{")]
    verdicts = {r.id: r.error for r in store.save_preprocessing_documents(spark.createDataFrame(docs, "id string, json string")).collect()}
    assert verdicts.pop("t") is None and all(verdicts.values()) and len(verdicts) == 3
    assert [r.id for r in store.read("preprocessing_templates").collect()] == ["t"] and store.read("anchors").count() == 6
    assert '"image":""' in store.by_id("preprocessing_templates", "t").first().json
    grids = store.template_grids()
    row = grids.first()
    assert [len(p) for p in row.grid] == [3, 3]
    want = raster.binarize(drawn(1)[180:220, 180:220], 3, 3, 91, 5.0)
    assert (matrices.from_row(row.grid[1][2]) == want).all()

    front, back, blank = drawn(0), drawn(1), np.full((SIDE, SIDE), 200, dtype=np.uint8)
    fed = {"swapped": [back, front[::-1, ::-1]], "twice": [front, front], "lost": [front, blank, front, back], "odd": [front, back, front], "none": [front, None]}
    rows = [(d, "x" if d == "none" else "t", i, None if p is None else matrices.to_row(p)) for d, some in fed.items() for i, p in enumerate(some)]
    pages = spark.createDataFrame(rows, f"doc string, template_id string, page int, gray {M}")
    straight = scanning.straighten(pages, grids)
    straight.write.parquet(f"{tmp_path}/straight")
    straight = spark.read.parquet(f"{tmp_path}/straight")
    outcomes = scanning.exam_outcomes(straight)
    got = {(r.doc, r.exam, r.place): r for r in outcomes.collect()}
    assert len(got) == 12
    assert [got["swapped", 0, i].template_page for i in (0, 1)] == [1, 0] and got["swapped", 0, 0].error is None
    assert got["twice", 0, 0].error == "duplicate pages in an exam" and got["twice", 0, 1].error_class == "order"
    assert got["lost", 0, 0].error == "unrecognizable page 1" and got["lost", 0, 0].error_class == "quality" and got["lost", 1, 1].error is None
    assert got["odd", 0, 0].error == "3 pages don't divide into exams of 2" and got["odd", 1, 0].error_class == "count"
    assert got["none", None, None].error == "template not found"

    exams = scanning.exam_rows(outcomes, straight.groupBy("doc").agg(F.first("n_places").alias("n_places")), "job")
    per_doc = {r.doc: r for r in results.scan_results(exams).collect()}
    assert len(per_doc["swapped"].scan_ids) == 1 and [(e["from"], e["thru"]) for e in per_doc["lost"].errors] == [(1, 2)] and len(per_doc["lost"].scan_ids) == 1
    store.save_scans(*scanning.stored_rows(straight, exams, 10))
    (scan,) = per_doc["swapped"].scan_ids
    first, second = store.load_scan(scan).collect()
    assert first.page_index == 0 and (matrices.from_row(first.binary) != raster.binarize(front, 3, 3, 91, 5.0)).mean() < 0.02
    assert (matrices.from_row(second.binary) != raster.binarize(back, 3, 3, 91, 5.0)).mean() < 0.02
    assert store.read("scans").count() == 2 and store.load_scan("nobody").count() == 0


def test_what_cannot_be_read_goes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([("t", document()), ("u", document())], "id string, json string")
    store.save_preprocessing_documents(docs)
    store.delete("anchors", store.read("anchors").where("template_id = 't' and page_index = 1 and anchor_index = 0").select("id"))
    assert store.load_template("t").count() == 0 and store.load_template("u").count() == 1 and store.load_template("v").count() == 0
    assert [r.id for r in store.read("preprocessing_templates").collect()] == ["u"] and store.read("anchors").count() == 6
    scans = spark.createDataFrame([("s", "u", 1), ("r", "u", 1)], "id string, preprocessing_template_id string, created_at_unix_ms long")
    store.save_scans(scans, spark.createDataFrame([("a", 0, "s", (1, 2, 0, bytearray(b"ab"))), ("b", 1, "s", (1, 2, 0, bytearray(b"a"))), ("c", 0, "r", (1, 1, 0, bytearray(b"a")))], f"id string, page_index int, scan_id string, binary {M}"))
    assert store.load_scan("s").count() == 0 and store.load_scan("r").count() == 1
    assert [r.id for r in store.read("scans").collect()] == ["r"]


def test_settings_follow_the_resolution(spark):
    kind = schemas.PREPROCESSING_CONFIG.simpleString()
    rows = [(1.4, (3, 3, 0.5, 91, -5.0, 1.4)), (2.8, (3, 3, 0.5, 91, -5.0, 1.4)), (0.1, (3, 3, 0.5, 91, -5.0, 1.4)), (2.8, (0, 0, 0.5, 0, -5.0, 1.4)), (2.8, (3, 3, 0.5, 91, -5.0, None)), (2.8, (3, 3, 0.5, 91, -5.0, 0.0))]
    df = spark.createDataFrame(rows, f"ratio double, config {kind}")
    got = [tuple(r.c)[:2] + (r.c.adaptiveBlockSize,) for r in df.select(S.scaled_config(F.col("config"), F.col("ratio")).alias("c")).collect()]
    assert got == [(3, 3, 91), (7, 6, 183), (1, 0, 7), (0, 0, 0), (3, 3, 91), (3, 3, 91)]


def test_positive_values(spark):
    df = spark.createDataFrame([("5",), ("0",), ("x",), ("",), (None,)], "v string")
    got = [tuple(r.q) for r in df.select(S.positive_query("v", "dpi", 300).alias("q")).collect()]
    assert got == [(5, None), (None, "dpi must be positive"), (None, "dpi is not a whole number"), (300, None), (300, None)]
    assert df.select(S.positive_query("v", "limit").alias("q")).collect()[3].q.error


def test_documents_are_checked_before_they_are_stored(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    changes = [(("width",), 0), (("height",), ...), (("config", "blurSize"), 4), (("config", "blurSize"), ...), (("config", "minAnchorConfidence"), ...), (("config", "adaptiveBlockSize"), ...), (("pages",), []), (("pages",), ...), (("pages", 0, "anchors"), []), (("pages", 1, "anchors", 2, "image"), ...), (("pages", 0, "anchors", 0, "center", "x"), SIDE + 1)]
    docs = [("good", document())]
    for i, (path, value) in enumerate(changes):
        at = doc = json.loads(document())
        for step in path[:-1]:
            at = at[step]
        at.pop(path[-1]) if value is ... else at.__setitem__(path[-1], value)
        docs.append((f"d{i:02}", json.dumps(doc)))
    got = {r.id: r.error for r in store.save_preprocessing_documents(spark.createDataFrame(docs, "id string, json string")).collect()}
    # The texts of messages are those that clients of the original read
    want = ["width must be positive", "height must be positive", "blurSize must be odd", "blurSize must be positive", "minAnchorConfidence must be in (0, 1)", "adaptiveBlockSize is required", "at least one page must be included", "at least one page must be included", "each page must have at least 3 anchors", "images must be set for each anchor", "center is out of bounds"]
    assert got.pop("good") is None and [got[f"d{i:02}"] for i in range(len(changes))] == want
    assert [r.id for r in store.read("preprocessing_templates").collect()] == ["good"] and store.read("anchors").count() == 6

    question = {"id": "Q1", "bubbleWidth": 9, "bubbleHeight": 9, "options": [{"label": "A", "x": 1, "y": 1}]}
    marking = [("m", {"pages": [{"questions": [question]}]}), ("width", {"pages": [{"questions": [{k: v for k, v in question.items() if k != "bubbleWidth"}]}]}), ("twice", {"pages": [{"questions": [question, question]}]}), ("none", {"pages": []})]
    rows = [(k, json.dumps(d)) for k, d in marking] + [("junk", "{")]
    got = {r.id: r.error for r in store.save_marking_documents(spark.createDataFrame(rows, "id string, json string")).collect()}
    assert got["m"] is None and got["junk"] == "the document is malformed" and got["width"] == "pages[0]: questions[0]: bubbleWidth must be positive"
    assert got["twice"] == 'pages[0]: duplicate question id "Q1"' and got["none"]
    assert [r.id for r in store.read("marking_templates").collect()] == ["m"]
