"""Samples of the machines that run the tasks: processor, memory and disk, as a stream of one row a period.

Spark's rate source gives the ticks; a task that gets one reads its own host's figures from the operating system. What the
host does not tell is null. Peaks, rings and windows of jobs and machines take these rows like any others.
"""

from __future__ import annotations

import os
import re
import shutil
import socket
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SAMPLE = "tick long, ts timestamp, host string, cpu_percent double, threads array<double>, in_use long, free long, own long, disk_used long, disk_free long"


def _numbers(path: str, pattern: str) -> dict[str, int]:
    """Names and whole numbers in a file of the operating system; none where there is no such file."""
    try:
        with open(path) as lines:
            return {m[1]: int(m[2]) for line in lines if (m := re.match(pattern, line))}
    except OSError:
        return {}


def _times() -> dict[str, tuple[int, int]]:
    """(busy, all) ticks of each processor since the start; `cpu` is all of them."""
    out = {}
    try:
        with open("/proc/stat") as lines:
            for line in lines:
                name, *ticks = line.split()
                if name.startswith("cpu"):
                    n = [int(x) for x in ticks]
                    out[name] = sum(n) - sum(n[3:5]), sum(n)
    except OSError:
        pass
    return out


def sample(wait: float = 0.1, disk: str = "/") -> dict:
    """One reading of this host; processors are watched for `wait` seconds."""
    before = _times()
    time.sleep(wait)
    after = _times()
    share = {k: 100.0 * (after[k][0] - b) / max(1, after[k][1] - a) for k, (b, a) in before.items() if k in after}
    memory = _numbers("/proc/meminfo", r"(\w+):\s+(\d+) kB")
    free, total = memory.get("MemAvailable"), memory.get("MemTotal")
    own = _numbers("/proc/self/status", r"(VmRSS):\s+(\d+) kB").get("VmRSS")
    used = shutil.disk_usage(disk)
    kilo = lambda n: None if n is None else n * 1024
    return {
        "host": socket.gethostname(), "cpu_percent": share.pop("cpu", None), "threads": [min(100.0, max(0.0, v)) for v in share.values()],
        "in_use": None if total is None or free is None else (total - free) * 1024, "free": kilo(free), "own": kilo(own), "disk_used": used.used, "disk_free": used.free,
    }


def stream_samples(spark: SparkSession, per_second: int = 1, disk: str = os.sep) -> DataFrame:
    """(tick, ts, host, cpu_percent, threads, in_use, free, own, disk_used, disk_free): a stream of `per_second` rows a second, bytes as they are."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", 1).load()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"tick": tick, "ts": ts, **sample(disk=disk)} for tick, ts in zip(batch["value"], batch["timestamp"], strict=True)]
            frame = pd.DataFrame(rows, columns=["tick", "ts", "host", "cpu_percent", "threads", "in_use", "free", "own", "disk_used", "disk_free"])
            yield frame

    return ticks.mapInPandas(work, SAMPLE)
