"""The marking core on hand-made rows, and its invariants."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallymark.operators import alignment, marking


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "question_id string, type string, labels array<string>, fills array<double>")
    return [r.asDict() for r in marking.mark(df, **options).orderBy("question_id").collect()]


@pytest.mark.parametrize(
    ("kind", "fills", "selected", "flag"),
    [
        ("", [0.9, 0.1, 0.12], ["A"], False),
        ("single", [0.1, 0.1, 0.1], [], True),
        ("single", [0.9, 0.9, 0.1], ["A", "B"], True),
        ("multi", [0.9, 0.9, 0.1], ["A", "B"], False),
        ("single", [0.95, 0.96, 0.97], ["A", "B", "C"], True),
        ("multi", [0.95, 0.96, 0.97], ["A", "B", "C"], False),
    ],
)
def test_rows(spark, kind, fills, selected, flag):
    (row,) = run(spark, [("Q1", kind, ["A", "B", "C"], fills)])
    assert row["selected"] == selected
    assert row["flag"] is flag


def test_only_q_questions_are_flagged_when_blank(spark):
    rows = run(spark, [(q, "single", ["A", "B"], [0.1, 0.1]) for q in ("L1", "Q1", "q1")])
    assert [r["flag"] for r in rows] == [False, True, False]


def test_one_option_and_none(spark):
    one, none = run(spark, [("L1", "single", ["A"], [0.6]), ("L2", "single", [], [])])
    assert one["selected"] == [] and one["gap"] == 0.0
    assert none["selected"] == [] and none["confidence"] == 0.0


def test_thresholds(spark):
    row = ("L1", "single", ["A", "B"], [0.5, 0.3])
    assert run(spark, [row], selection_threshold=0.25)[0]["selected"] == []
    assert run(spark, [row], selection_threshold=0.1)[0]["selected"] == ["A"]
    assert run(spark, [row], flag_threshold=1.1)[0]["flag"] and not run(spark, [row], flag_threshold=0.0)[0]["flag"]


def by_hand(kind, fills, threshold=0.25):
    s, n = sorted(fills), len(fills)
    lo = 1 if kind == "multi" else max(1, n - min(4, n) + 1)
    gap, split = 0.0, s[-1]
    for i in range(lo, n):
        if s[i] - s[i - 1] > gap:
            gap, split = s[i] - s[i - 1], s[i - 1]
    low = [f for f in fills if f <= split]
    mean = 0.0
    for f in low:
        mean += f
    mean /= len(low)
    full, base = mean > 0.75, 0.0 if mean > 0.75 else mean
    return [i for i, f in enumerate(fills) if (full and f - base >= 0.5) or (not full and gap >= threshold and f - base > split - base)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["", "multi"]), st.lists(st.floats(0, 1), min_size=1, max_size=12)), min_size=1, max_size=20))
def test_selection_by_hand(spark, rows):
    data = [(f"Q{i:03}", kind, [str(k) for k in range(len(f))], f) for i, (kind, f) in enumerate(rows)]
    for got, (kind, fills) in zip(run(spark, data), rows, strict=True):
        assert got["selected"] == [str(i) for i in by_hand(kind, fills)]
        assert 0 <= got["confidence"] <= 1


def test_offsets_prefer_the_centre_then_the_first(spark):
    rows = [("a", 0, 0, [0.1, 0.5], [0.0, 0.0]), ("a", 1, 0, [0.1, 0.5], [0.0, 0.0]), ("b", 0, 0, [0.01, 0.9], [0.0, 0.0]), ("b", 1, -1, [0.1, 0.4], [0.0, 0.0]), ("b", -1, 1, [0.1, 0.4], [0.0, 0.0])]
    rows += [("c", 0, 0, [0.3, 0.3], [0.2, 0.2]), ("c", 2, 1, [0.3, 0.3], [0.9, 0.8]), ("d", 0, 0, [0.3, 0.3], [0.2, 0.2]), ("d", 2, 1, [0.3, 0.35], [0.3, 0.3])]
    df = spark.createDataFrame(rows, "q string, dx int, dy int, fills array<double>, guards array<double>")
    got = {r.q: (r.dx, r.dy) for r in alignment.best_offsets(df, ["q"], 0.25).collect()}
    assert got == {"a": (0, 0), "b": (1, -1), "c": (2, 1), "d": (0, 0)}
