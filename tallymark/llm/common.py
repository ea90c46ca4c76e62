"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SCOPES = threading.local()


class scratch:
    """A scope whose cut tables are deleted at its end, but for the kept ones, which count for the scope around it.

    It may end once everything that is returned reads kept tables or the inputs only.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def __enter__(self) -> scratch:
        self.outer = getattr(_SCOPES, "open", None)
        _SCOPES.open = self
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.cut_path)
        return df

    def __exit__(self, *_) -> None:
        _SCOPES.open = self.outer
        for path in self.made:
            if path in self.kept:
                if self.outer:
                    self.outer.made.append(path)
            else:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and a lost executor costs nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if scope := getattr(_SCOPES, "open", None):
        scope.made.append(path)
    return out


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name near `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back at its end: Python workers outlive their tasks, and idle ones count too."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches sorted by `keys`, dealt anew so that no group is split: (rows, bounds of the groups)."""
    held = None
    for batch in batches:
        rows = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        bounds = _bounds(rows, keys)
        if len(bounds) > 2:
            yield rows.iloc[: bounds[-2]], bounds[:-1]
        held = rows.iloc[bounds[-2] :].reset_index(drop=True) if len(bounds) > 1 else None
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _bounds(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    if not len(rows):
        return np.zeros(1, dtype=int)
    new = np.zeros(len(rows), dtype=bool)
    for key in keys:
        column = rows[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    new[0] = True
    return np.append(np.nonzero(new)[0], len(rows))


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that connect what a symmetric boolean matrix connects, one fewer than rows in each component."""
    found, left = [], np.ones(len(linked), dtype=bool)
    for seed in range(len(linked)):
        if not left[seed]:
            continue
        left[seed] = False
        front = np.array([seed])
        while len(front):
            front = np.nonzero(linked[front].any(axis=0) & left)[0]
            left[front] = False
            found += [(seed, int(other)) for other in front]
    return found
