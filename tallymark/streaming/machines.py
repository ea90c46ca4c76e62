"""Streams with state of their own: a ring with flush, a job machine with timers and conflicts, progress by distinct exams.

State is kept by `transformWithState`, which needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). Each key's
state is bounded: a ring by its capacity, a job by one row. Events of one batch are taken in the order of their times,
ties by `seq`; what comes in a later batch counts as later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import last_items_per

#: What the state store of these streams must be.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame], ts: str, seq: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([ts, seq], kind="stable")


# --- ring


class Ring(StatefulProcessor):
    """The last values of a key; a flush empties it, and at capacity the oldest goes."""

    def __init__(self, capacity: int, key: str, kind: str, value: str, ts: str, seq: str):
        self.capacity, self.key, self.kind, self.value, self.ts, self.seq = capacity, key, kind, value, ts, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", T.StructType([T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [v for (v,) in self.items.get()] if self.items.exists() else []
        added = evicted = flushed = 0
        for row in _in_order(rows, self.ts, self.seq).to_dict("records"):
            if row[self.kind] == "flush":
                flushed += 1
                held = []
            elif self.capacity > 0:
                added += 1
                evicted += len(held) == self.capacity
                held = [*held[len(held) == self.capacity :], float(row[self.value])]
        if held:
            self.items.put([(v,) for v in held])
        else:
            self.items.clear()
        yield pd.DataFrame({self.key: [key[0]], "items": [held], "added": [added], "evicted": [evicted], "flushed": [flushed]})

    def close(self) -> None:
        pass


def stream_ring(rows: DataFrame, capacity: int, key: str = "key", kind: str = "kind", value: str = "value", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(key, items, added, evicted, flushed): a row per key and batch that touched it; items from oldest to newest. Rows of kind `flush` empty the ring."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, items array<double>, added long, evicted long, flushed long"
    return rows.groupBy(key).transformWithStateInPandas(Ring(capacity, key, kind, value, ts, seq), schema, "Update", "None")


def last_of(items: str, n: int):
    """The last n of a ring's items, oldest first; none for n below 1, all where there are fewer."""
    size = F.size(items)
    return F.when(F.lit(n) <= 0, F.array().cast("array<double>")).otherwise(F.slice(items, F.greatest(F.lit(1), size - n + 1), F.least(F.lit(max(n, 1)), F.greatest(size, F.lit(1)))))


def ring_by_replay(rows: DataFrame, capacity: int, key: str = "key", kind: str = "kind", value: str = "value", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(key, items): what the ring holds after all rows, without a stream: the last ones behind each key's last flush."""
    place = F.struct(ts, seq)
    flushes = rows.where(F.col(kind) == "flush").groupBy(key).agg(F.max(place).alias("_flush"))
    left = rows.where(F.col(kind) != "flush").join(flushes, key, "left").where(F.col("_flush").isNull() | (place > F.col("_flush")))
    newest = last_items_per(left, capacity, key, ts, seq).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ts, seq, F.col(value).cast("double").alias("v")))).alias("_items"))
    return rows.select(key).distinct().join(newest, key, "left").select(key, F.coalesce(F.col("_items.v"), F.array().cast("array<double>")).alias("items"))


# --- jobs

#: Why an event of a job is turned down.
CONFLICT, FINISHED, UNKNOWN = "conflict", "finished", "not found"
_JOB = T.StructType([T.StructField("started", T.LongType()), T.StructField("finished", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("progress", T.DoubleType()), T.StructField("notes", T.StringType())])


class Jobs(StatefulProcessor):
    """One job: a start registers it, a finish ends it, and a timer of the event time forgets it, `ttl_ms` after its start."""

    def __init__(self, ttl_ms: int, job: str):
        self.ttl_ms, self.job = ttl_ms, job

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _JOB)

    def _row(self, job, out: str, at: int, seq, reason: str | None, state: tuple) -> tuple:
        started, finished, success, progress, notes = state
        stamp = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        return (job, out, stamp(at), seq, reason, stamp(started), stamp(finished), success, progress, notes)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[self.job, "output", "ts", "seq", "reason", "started", "finished", "success", "progress", "notes"])
        frame["seq"], frame["success"] = frame["seq"].astype(object).where(frame["seq"].notna(), None), frame["success"].astype(object)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        none, out, touched, at, seq = (None, None, None, 0.0, None), [], False, None, None
        for row in _in_order(rows, "ts", "seq").to_dict("records"):
            at, seq, what, value = row["ts"].value // 1000, row["seq"], row["kind"], row["value"]
            if what == "start":
                if state is not None:
                    out.append(self._row(key[0], "error", at, seq, CONFLICT, state))
                    continue
                state = (at, None, None, 0.0, None)
                self.handle.registerTimer(max(at // 1000 + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
            elif state is None:
                out.append(self._row(key[0], "error", at, seq, UNKNOWN, none))
                continue
            elif what == "note":
                state = (*state[:4], row["note"])
            elif state[1] is not None:
                out.append(self._row(key[0], "error", at, seq, FINISHED, state))
                continue
            elif what == "progress":
                state = (state[0], None, None, min(1.0, max(0.0, float(value))), state[4])
            else:
                state = (state[0], at, bool(value > 0), 1.0, state[4])
            touched = True
        if touched:
            self.state.update(state)
            out.append(self._row(key[0], "state", at, seq, None, state))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = tuple(self.state.get())
            self.state.clear()
            yield self._frame([self._row(key[0], "evicted", expiredTimerInfo.getExpiryTimeInMs() * 1000, None, None, state)])

    def close(self) -> None:
        pass


def stream_jobs(events: DataFrame, ttl_ms: int = 600_000, late: str = "1 minute", job: str = "job") -> DataFrame:
    """(job, output, ts, seq, reason, started, finished, success, progress, notes) of events (job, ts, seq, kind, value, note).

    Outputs are `state`, one for each job and batch that changed it; `error`, one for each event that is turned down: a second
    start (`conflict`), progress or another finish after the first (`finished`), anything of an unknown job (`not found`); and
    `evicted`, once the watermark, `late` behind the newest event, has passed the start by `ttl_ms`. Notes may be written after the finish.
    A job that was evicted may start anew.
    """
    schema = f"{job} {events.schema[job].dataType.simpleString()}, output string, ts timestamp, seq long, reason string, started timestamp, finished timestamp, success boolean, progress double, notes string"
    return events.withWatermark("ts", late).groupBy(job).transformWithStateInPandas(Jobs(ttl_ms, job), schema, "Update", "EventTime")


# --- progress


class Done(StatefulProcessor):
    """How many different exams of a job are over, of how many; an exam that comes again counts once. All is forgotten `ttl_ms` after the job's first batch."""

    def __init__(self, job: str, exam: str, total: str, ts: str, ttl_ms: int):
        self.job, self.exam, self.total, self.ts, self.ttl_ms = job, exam, total, ts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("exam", T.LongType())]), T.StructType([T.StructField("n", T.IntegerType())]))
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.count.exists()
        n, repeats, total = self.count.get()[0] if known else 0, 0, None
        newest = 0
        for batch in rows:
            newest = max(newest, int(batch[self.ts].max().value // 1_000_000))
            for exam, of in zip(batch[self.exam], batch[self.total], strict=True):
                total = of if total is None or of != of else total
                if self.seen.containsKey((int(exam),)):
                    repeats += 1
                    continue
                self.seen.updateValue((int(exam),), (1,))
                n += 1
        if not known:
            self.handle.registerTimer(max(newest + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.count.update((n,))
        wanted = None if total is None or total != total else int(total)
        share = 0.0 if not wanted or wanted <= 0 else min(1.0, n / wanted)
        yield pd.DataFrame({self.job: [key[0]], "done": [n], "repeats": [repeats], "total": pd.Series([wanted], dtype=object), "progress": [share]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_progress(finished: DataFrame, totals: DataFrame, late: str = "1 minute", ttl_ms: int = 86_400_000, job: str = "job", exam: str = "exam", ts: str = "ts") -> DataFrame:
    """(job, done, repeats, total, progress): a row per job and batch, from exams (job, exam, ts) that end out of order and may end again.

    totals: (job, total), a table. Exams of a job that has no total have progress 0.
    """
    met = finished.withWatermark(ts, late).join(totals.select(job, F.col("total").cast("long").alias("total")), job, "left")
    schema = f"{job} {finished.schema[job].dataType.simpleString()}, done long, repeats long, total long, progress double"
    return met.select(job, exam, "total", ts).groupBy(job).transformWithStateInPandas(Done(job, exam, "total", ts, ttl_ms), schema, "Update", "EventTime")


def progress_by_replay(finished: DataFrame, totals: DataFrame, job: str = "job", exam: str = "exam") -> DataFrame:
    """(job, done, total, progress) after all exams, without a stream."""
    done = finished.groupBy(job).agg(F.countDistinct(exam).alias("done")).join(totals.select(job, F.col("total").cast("long").alias("total")), job, "left")
    return done.select(job, "done", "total", F.when(F.coalesce("total", F.lit(0)) > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0).alias("progress"))
