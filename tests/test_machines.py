"""Streams with state, replayed in batches and held against the batch functions and by hand."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallymark.streaming import jobs, machines, samples

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machines.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replay(spark, tmp_path, batches, schema, build):
    """What each batch gives: its rows are written as one file, and the stream runs until it has none left."""
    source, out = tmp_path / "source", []
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(source / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source))
    query = build(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: out.append((i, [r.asDict() for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive
    return [rows for _, rows in sorted(out, key=lambda x: x[0])]


def at(s):
    return T0 + dt.timedelta(seconds=s)


RING = "key string, kind string, value double, ts timestamp, seq long"


def test_ring_with_a_flush_in_the_middle(rocks, tmp_path):
    rows = [("a", "add", float(i), at(i), i) for i in range(5)]
    batches = [rows[:2], [*rows[2:], ("b", "add", 9.0, at(2), 7)], [("a", "add", 5.0, at(10), 10), ("a", "flush", None, at(11), 11), ("a", "add", 6.0, at(12), 12)], [("b", "flush", None, at(20), 20)], [("a", "add", 7.0, at(30), 30), ("b", "add", 1.0, at(30), 31)]]
    got = replay(rocks, tmp_path, batches, RING, lambda s: machines.stream_ring(s, 3))
    last = {}
    for r in itertools.chain(*got):
        last[r["key"]] = r["items"]
    seen = [[(r["key"], r["items"], r["evicted"], r["flushed"]) for r in sorted(b, key=lambda r: r["key"])] for b in got if b]
    assert seen == [[("a", [0.0, 1.0], 0, 0)], [("a", [2.0, 3.0, 4.0], 2, 0), ("b", [9.0], 0, 0)], [("a", [6.0], 1, 1)], [("b", [], 0, 1)], [("a", [6.0, 7.0], 0, 0), ("b", [1.0], 0, 0)]]
    whole = rocks.createDataFrame(list(itertools.chain(*batches)), RING)
    assert {r.key: r["items"] for r in machines.ring_by_replay(whole, 3).collect()} == last


def test_last_of_a_ring(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "items array<double>")
    for n, want in ((2, [2.0, 3.0]), (0, []), (-1, []), (9, [1.0, 2.0, 3.0])):
        assert [r.x for r in df.select(machines.last_of("items", n).alias("x")).collect()] == [want, []]


def test_ranks_and_peaks_of_a_hot_key_go_by_stretches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(40), rng.choice([None, *range(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, kind string, started int, value int")
    order, seen, tops, want = sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])), {}, {}, {}
    for i, kind, _, value in order:
        seen[kind] = seen.get(kind, 0) + 1
        tops[kind] = max((v for v in (tops.get(kind), value) if v is not None), default=None)
        want[i] = (seen[kind], tops[kind])
    got = {r.id: r["rank"] for r in jobs.ranked(df, "kind", "started", "id").collect()}
    peaks = {r.id: r.peak for r in jobs.running_peak(df, "kind", "started", "id", "value").collect()}
    assert {i: (got[i], peaks[i]) for i in got} == want and len(got) == len(peaks) == 400
    dealt = jobs._stretches(df, "kind", ["started", "id"]).groupBy("_stretch").count().collect()
    assert max(r["count"] for r in dealt) < 200  # the hot key's 330 rows and more are dealt to several tasks


JOB = "job string, ts timestamp, seq long, kind string, value double, note string"


def by_hand(events):
    """States and turned down events of a job's whole history."""
    state, errors = None, []
    for _, t, seq, kind, value, note in sorted(events, key=lambda e: (e[1], e[2])):
        if kind == "start" and state is not None:
            errors.append((seq, "conflict"))
        elif kind == "start":
            state = [t, None, None, 0.0, None]
        elif state is None:
            errors.append((seq, "not found"))
        elif kind == "note":
            state[4] = note
        elif state[1] is not None:
            errors.append((seq, "finished"))
        elif kind == "progress":
            state[3] = min(1.0, max(0.0, value))
        else:
            state[1:4] = [t, value > 0, 1.0]
    return state, errors


def test_jobs_with_conflicts_and_late_updates(rocks, tmp_path):
    rng = random.Random(3)
    events = [(f"j{rng.randrange(5)}", at(i), i, rng.choice(["start", "start", "progress", "progress", "note", "finish"]), rng.choice([-1.0, 0.3, 0.8, 2.0]), f"n{i}") for i in range(70)]
    got = list(itertools.chain(*replay(rocks, tmp_path, [events[:30], events[30:45], events[45:]], JOB, lambda s: machines.stream_jobs(s, ttl_ms=10**9))))
    last = {r["job"]: r for r in got if r["output"] == "state"}
    errors = {}
    for r in got:
        if r["output"] == "error":
            errors.setdefault(r["job"], []).append((r["seq"], r["reason"]))
    names = {e[0] for e in events}
    want = {j: by_hand([e for e in events if e[0] == j]) for j in names}
    for j, (state, turned_down) in want.items():
        assert sorted(errors.get(j, [])) == turned_down
        assert state is None or [last[j][c] for c in ("started", "finished", "success", "progress", "notes")] == state
    df = rocks.createDataFrame(events, JOB)
    conflicts = {(r.job, r.seq) for r in jobs.start_conflicts(df, tie="seq").collect()}
    assert {(j, s) for j, some in errors.items() for s, reason in some if reason == "conflict"} == conflicts
    begun = df.join(df.where("kind = 'start'").groupBy("job").agg(F.min(F.struct("ts", "seq")).alias("first")), "job").where("struct(ts, seq) >= first").drop("first")
    states = {r.job: (r.started, r.finished, r.success, r.progress) for r in jobs.job_states(begun, tie="seq").collect()}
    assert states == {j: (r["started"], r["finished"], r["success"], r["progress"]) for j, r in last.items()}


def test_jobs_are_forgotten_by_their_start(rocks, tmp_path):
    event = lambda j, s, kind, value=0.5: (j, at(s), s, kind, value, None)
    batches = [[event("old", 0, "start"), event("old", 50, "progress")], [event("new", 700, "start")], [event("new", 720, "progress")], [event("old", 730, "progress"), event("old", 731, "start")]]
    got = replay(rocks, tmp_path, batches, JOB, lambda s: machines.stream_jobs(s, ttl_ms=600_000, late="10 seconds"))
    flat = [(r["job"], r["output"], r["reason"]) for r in itertools.chain(*got)]
    assert flat.count(("old", "evicted", None)) == 1 and ("new", "evicted", None) not in flat
    gone = flat.index(("old", "evicted", None))
    assert flat.index(("old", "error", "not found")) > gone and ("old", "state", None) in flat[gone:]


def test_progress_of_exams_that_end_again(rocks, tmp_path):
    schema = "job string, exam long, ts timestamp"
    order = [3, 1, 1, 0, 3, 2, 4, 0]
    rows = [("a", e, at(i)) for i, e in enumerate(order)] + [("b", 0, at(3)), ("b", 0, at(4)), ("nobody", 5, at(5))]
    totals = rocks.createDataFrame([("a", 5), ("b", 4)], "job string, total int")
    got = list(itertools.chain(*replay(rocks, tmp_path, [rows[:3], rows[3:6], rows[6:]], schema, lambda s: machines.stream_progress(s, totals))))
    of_a = [(r["done"], r["progress"]) for r in got if r["job"] == "a"]
    assert of_a == [(2, 0.4), (4, 0.8), (5, 1.0)] and sum(r["repeats"] for r in got) == len(rows) - 7
    last = {r["job"]: (r["done"], r["total"], r["progress"]) for r in got}
    whole = machines.progress_by_replay(rocks.createDataFrame(rows, schema), totals)
    assert last == {r.job: (r.done, r.total, r.progress) for r in whole.collect()} and last["nobody"] == (1, None, 0.0)


def test_samples_of_this_machine(spark, tmp_path):
    one = samples.sample(0.05)
    assert 0 <= one["cpu_percent"] <= 100 and one["threads"] and all(0 <= t <= 100 for t in one["threads"])
    assert one["in_use"] > 0 and one["free"] > 0 and 0 < one["own"] < one["in_use"] + one["free"] and one["disk_used"] > 0
    query = samples.stream_samples(spark, 2).writeStream.format("memory").queryName("samples").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(processingTime="1 second").start()
    for _ in range(60):
        if query.exception() or spark.table("samples").count() >= 4:
            break
        query.awaitTermination(1)
    query.stop()
    rows = spark.table("samples")
    assert rows.select("tick").distinct().count() == rows.count() >= 4 and rows.where("cpu_percent between 0 and 100 and in_use > 0 and host is not null").count() == rows.count()
    peak = jobs.peaks_by_window(rows, "ts", "own", "1 hour").agg(F.max("peak")).first()[0]
    assert peak == rows.agg(F.max("own")).first()[0]
