"""Jobs and telemetry as event rows: last states, time limits, last items, peaks; in batches and as streams.

Job events are (job, ts, kind, value, note), kind one of start, progress, note, finish. A job takes its first start and
its first finish; what comes after that finish changes nothing, and finishing makes progress whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import cut


def job_states(events: DataFrame, job: str = "job", ts: str = "ts", kind: str = "kind", value: str = "value", tie: str | None = None) -> DataFrame:
    """(job, started, finished, success, progress, n_events): each job's state; success is the finish's value above 0."""
    order = F.struct(ts, *([tie] if tie else []))
    first = events.groupBy(job).agg(F.min(F.when(F.col(kind) == "finish", F.struct(order.alias("o"), F.col(ts).alias("ts"), F.col(value).alias("v")))).alias("end"))
    # the end is one row per job: it joins back on the key that both are grouped by
    live = events.join(first, job).where(F.col("end").isNull() | (order <= F.col("end.o")))
    last = F.max(F.when(F.col(kind) == "progress", F.struct(order.alias("o"), F.col(value).alias("v")))).alias("p")
    out = live.groupBy(job).agg(F.min(F.when(F.col(kind) == "start", F.col(ts))).alias("started"), F.max("end").alias("end"), last, F.count("*").alias("n_events"))
    progress = F.when(F.col("end").isNotNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("p.v"), F.lit(0.0)))))
    return out.select(job, "started", F.col("end.ts").alias("finished"), (F.col("end.v") > 0).alias("success"), progress.alias("progress"), "n_events")


def start_conflicts(events: DataFrame, job: str = "job", ts: str = "ts", kind: str = "kind", tie: str | None = None) -> DataFrame:
    """Starts of jobs that had been started before."""
    order = Window.partitionBy(job).orderBy(ts, *([tie] if tie else []))
    return events.where(F.col(kind) == "start").withColumn("_n", F.row_number().over(order)).where(F.col("_n") > 1).drop("_n")


def expired(jobs: DataFrame, now: Column, seconds: int, started: str = "started") -> DataFrame:
    """Jobs that started more than so many seconds ago."""
    return jobs.where(F.col(started) < now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def in_order(jobs: DataFrame, started: str = "started", tie: str = "job") -> DataFrame:
    return jobs.orderBy(started, tie)


def _stretches(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of (key, order), with `_stretch`, the number of their range: a key's rows lie in stretches that follow each other.

    Written, so that the ranges stand: what is worked out for each stretch, and then from stretch to stretch, holds
    however many rows a key has, and none has to lie in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut(rows.repartitionByRange(parts, key, *order).withColumn("_stretch", F.spark_partition_id()), "stretches")


def ranked(jobs: DataFrame, kind: str, started: str = "started", tie: str = "job") -> DataFrame:
    """Each job with its place among those of its kind, from oldest to newest: its place in a stretch behind all of the stretches before."""
    dealt = _stretches(jobs, kind, [started, tie])
    sizes = dealt.groupBy(F.col(kind).alias("_kind"), "_stretch").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_kind").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(kind, "_stretch").orderBy(started, tie))
    met = dealt.withColumn("_own", own).join(before.withColumnRenamed("_stretch", "_at"), F.col(kind).eqNullSafe(F.col("_kind")) & (F.col("_stretch") == F.col("_at")))
    return met.select(*jobs.columns, (F.col("_before") + F.col("_own")).cast("long").alias("rank"))


def last_items(rows: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The last n rows, oldest first; none for n below 1, all where there are fewer."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(max(n, 0)).orderBy(ts, tie)


def last_items_per(rows: DataFrame, n: int, key: str, ts: str, tie: str) -> DataFrame:
    """The same for each key, as rows with their place from the end."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return rows.withColumn("from_end", place).where(F.col("from_end") <= max(n, 0))


def running_peak(samples: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """Each sample with the highest value so far: in its stretch up to it, and in all of the stretches before."""
    dealt = _stretches(samples, key, [ts, tie])
    tops = dealt.groupBy(F.col(key).alias("_key"), "_stretch").agg(F.max(value).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.max(value).over(Window.partitionBy(key, "_stretch").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_own", own).join(before.select("_key", F.col("_stretch").alias("_at"), "_before"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")))
    return met.select(*samples.columns, F.greatest("_own", "_before").alias("peak"))


def peaks_by_window(samples: DataFrame, ts: str, value: str, width: str, key: str | None = None) -> DataFrame:
    """Highest value and number of samples for each span of time."""
    keys = [F.window(ts, width).alias("w"), *([F.col(key)] if key else [])]
    out = samples.groupBy(*keys).agg(F.max(value).alias("peak"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([key] if key else []), "peak", "n")


def stream_job_states(events: DataFrame, ttl_ms: int = 600_000, late: str = "1 minute", job: str = "job", ts: str = "ts", kind: str = "kind", value: str = "value") -> DataFrame:
    """The same state machine over a stream: a row per job and batch that touched it.

    A state goes once the watermark, `late` behind the newest event, has passed its start by `ttl_ms`.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, finished, success, progress, n = state.get if state.exists else (None, None, None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        at = rows[ts].iloc[0].value // 1000
        for row in rows.itertuples():
            if finished is not None:
                break
            at, what, v = getattr(row, ts).value // 1000, getattr(row, kind), getattr(row, value)
            n += 1
            if what == "start" and started is None:
                started = at
            elif what == "progress":
                progress = min(1.0, max(0.0, float(v)))
            elif what == "finish":
                finished, success, progress = at, bool(v > 0), 1.0
        state.update((started, finished, success, progress, n))
        state.setTimeoutTimestamp(max((started if started is not None else at) // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        stamp = lambda us: pd.Timestamp(us, unit="us") if us is not None else pd.NaT
        yield pd.DataFrame({job: [key[0]], "started": [stamp(started)], "finished": [stamp(finished)], "success": [success], "progress": [progress], "n_events": [n]})

    kind_of = events.schema[job].dataType.simpleString()
    return events.withWatermark(ts, late).groupBy(job).applyInPandasWithState(step, f"{job} {kind_of}, started timestamp, finished timestamp, success boolean, progress double, n_events long", "started long, finished long, success boolean, progress double, n long", "update", "EventTimeTimeout")


def stream_last_items(rows: DataFrame, n: int, key: str, ts: str, value: str) -> DataFrame:
    """A ring of the last n values per key over a stream: one row per key and batch, oldest first."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values(ts, kind="stable")[value].tolist()
        held = (held + [float(v) for v in new])[-n:] if n > 0 else []
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "items": [held]})

    kind_of = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind_of}, items array<double>", "items array<double>", "update", "NoTimeout")


def stream_peaks(samples: DataFrame, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Peaks per span of a stream; rows later than `late` behind the newest are dropped."""
    return peaks_by_window(samples.withWatermark(ts, late), ts, value, width)
