"""Repeated substrings by names of growing strings around anchors.

This takes from prefix doubling that positions are named by growing strings, and those with a unique name leave. It is not
prefix doubling itself: that has one row for each byte, about 14 times the input on disk, and makes each rank of a pair of
the ranks before it. Here windows are chosen by content: each window of `length` bytes
has one anchor, the string of ANCHOR bytes with the smallest hash in it, and equal windows have it at the same place.
Windows with one anchor are ranked together:

1. by the anchor's string: windows whose anchor is unique are unique and leave;
2. by all that those windows cover: where that is repeated, all of the anchor's windows are repeated and settled;
3. the others (one of each different covered string) go on in groups of GROUP neighbouring windows, ranked by the longer
   string that the group has in common, which is all but GROUP - 1 bytes of a window;
4. what is still not unique is ranked window by window, by the whole length.

Each rank is a 64-bit name of the string and its place beside the anchor; Spark groups equal names, and rows with a
unique name go no further. Bytes of repeated windows are removed. No step compares two rows with each other, so
groups of copies cost in proportion to their rows.

Defined results: null and empty texts have no bytes; texts under `length` bytes stay whole; matches never cross documents;
rows that repeat are copies of each other; ids only tell rows apart; very long texts are read in overlapping steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

LENGTH = 400
ANCHOR = 128
GROUP = 16
#: Windows of a text handled at once.
STEP = 1 << 20

_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_BYTES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) for seed in (11, 12)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, at least n of each."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = []
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _POWERS.append((both[0], both[1]))
    return _POWERS


class Names:
    """Names of substrings of a byte array from sums over its prefixes; equal strings have equal names."""

    def __init__(self, data: np.ndarray):
        self.powers = _powers(len(data) + 1)
        self.sums = []
        for table_, (up, _) in zip(_BYTES, self.powers, strict=True):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(table_[data] * up[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def fast(self, size: int) -> np.ndarray:
        """A weaker name of each substring of this size, to choose anchors by."""
        s = self.sums[0]
        return _mix((s[size:] - s[:-size]) * self.powers[0][1][: len(s) - size])

    def of(self, start: np.ndarray, stop: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
        """Names of data[start:stop], and of a place, which is part of the name."""
        first, second = ((s[stop] - s[start]) * down[start] for s, (_, down) in zip(self.sums, self.powers, strict=True))
        tail = (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(place).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return _mix(_mix(first) + _mix(second + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(3) + tail).view(np.int64)


def anchors(data: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """Anchor positions with the range of distances back to their windows' starts (near to far), the anchor's name and that of all they cover."""
    names = Names(data)
    n_windows, reach = len(data) - length + 1, length - anchor + 1
    value = names.fast(anchor)
    value = (value & ~_LOW) | np.arange(len(value), dtype=np.uint64)
    rows = -(-len(value) // reach)
    padded = np.full(rows * reach, ~np.uint64(0))
    padded[: len(value)] = value
    grid = padded.reshape(rows, reach)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    at = (np.minimum(ahead[:n_windows], behind[reach - 1 : reach - 1 + n_windows]) & _LOW).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    last = np.append(first[1:], n_windows) - 1
    at = at[first]
    return {"at": at, "near": at - last, "far": at - first, "name": names.of(at, at + anchor), "cover": names.of(first, last + length, at - first)}


def steps(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Slices of a text of this size that hold all its windows, each in one slice."""
    for start in range(0, max(0, size - length + 1), STEP):
        yield start, min(size, start + STEP + length - 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("binary").alias("data"))


def anchored(docs: DataFrame, length: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, near, far, name, cover): one row for each anchor of each text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[pd.DataFrame] = []
            with np.errstate(over="ignore"):
                for doc, raw in zip(batch["doc"], batch["data"], strict=True):
                    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
                    for lo, hi in steps(len(data), length):
                        one = anchors(data[lo:hi], length, anchor)
                        one["at"] = one["at"] + lo
                        found.append((np.full(len(one["at"]), doc), *one.values()))
            if found:
                yield pd.DataFrame(dict(zip(("doc", "at", "near", "far", "name", "cover"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    return cut(_keyed(docs, id_col, text_col).mapInPandas(work, "doc long, at int, near int, far int, name long, cover long"), "anchors")


def open_contexts(docs: DataFrame, wanted: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, at, near, far, settled, context) of the anchors `wanted`: the bytes that their windows cover."""
    per_doc = cut(wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "near", "far", "settled")).alias("anchors")), "wanted")
    texts = _keyed(docs, id_col, text_col).join(per_doc, "doc")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, raw, found in zip(batch["doc"], batch["data"], batch["anchors"], strict=True):
                yield pd.DataFrame([(doc, a["at"], a["near"], a["far"], a["settled"], raw[a["at"] - a["far"] : a["at"] - a["near"] + length]) for a in found], columns=["doc", "at", "near", "far", "settled", "context"])

    rows = texts.mapInPandas(work, "doc long, at int, near int, far int, settled boolean, context binary")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "contexts")


def _joined(raws: list[bytes]) -> tuple[Names, np.ndarray]:
    starts = np.cumsum([0] + [len(r) for r in raws])
    return Names(np.frombuffer(b"".join(raws), dtype=np.uint8)), starts[:-1]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of all ranges first..last."""
    size = last - first + 1
    row = np.repeat(np.arange(len(size)), size)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def grouped_windows(contexts: DataFrame, length: int, group: int) -> DataFrame:
    """(row, part, name, settled): the string that each group of neighbouring windows has in common."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                batch = whole.iloc[lo : lo + 2000]
                with np.errstate(over="ignore"):
                    names, base = _joined(batch["context"].tolist())
                    near, far = batch["near"].to_numpy(dtype=np.int64), batch["far"].to_numpy(dtype=np.int64)
                    i, part = _spread(near // group, far // group)
                    start = base[i] + far[i] - part * group
                    name = names.of(start, start + length - group + 1, part + 1)
                yield pd.DataFrame({"row": batch["row"].to_numpy()[i], "part": part, "name": name, "settled": batch["settled"].to_numpy()[i]})

    return cut(contexts.select("row", "near", "far", "settled", "context").mapInPandas(work, "row long, part int, name long, settled boolean"), "groups")


def single_windows(contexts: DataFrame, parts: DataFrame, length: int, group: int) -> DataFrame:
    """(doc, start, name, settled): the windows of the groups that are left."""
    left = contexts.join(parts, "row").select("doc", "at", "near", "far", "settled", "context", "parts")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                batch = whole.iloc[lo : lo + 2000]
                with np.errstate(over="ignore"):
                    names, base = _joined(batch["context"].tolist())
                    near, far = batch["near"].to_numpy(dtype=np.int64), batch["far"].to_numpy(dtype=np.int64)
                    n = batch["parts"].map(len).to_numpy()
                    owner, part = np.repeat(np.arange(len(batch)), n), np.concatenate(batch["parts"].tolist()).astype(np.int64)
                    k, back = _spread(np.maximum(near[owner], part * group), np.minimum(far[owner], part * group + group - 1))
                    i = owner[k]
                    start = base[i] + far[i] - back
                    name = names.of(start, start + length, back + 1)
                yield pd.DataFrame({"doc": batch["doc"].to_numpy()[i], "start": batch["at"].to_numpy()[i] - back, "name": name, "settled": batch["settled"].to_numpy()[i]})

    return cut(left.mapInPandas(work, "doc long, start int, name long, settled boolean"), "windows")


def _still_open(rows: DataFrame, name: str) -> DataFrame:
    """Names that more than one row has, one of them not settled."""
    return cut(rows.groupBy("name").agg(F.count("*").alias("n"), F.min("settled").alias("settled")).where((F.col("n") > 1) & ~F.col("settled")).select("name"), name)


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, first, last): ranges of the windows that occur elsewhere too; doc is xxhash64(id, text)."""
    found = anchored(docs, length, anchor, id_col, text_col)
    ranks = cut(found.groupBy("name").agg(F.count("*").alias("n"), (F.min("cover") == F.max("cover")).alias("same")).where(F.col("n") > 1).select("name", "same"), "ranks")
    again = cut(found.join(ranks, "name"), "again")
    mixed = again.where(~F.col("same"))
    covers = cut(mixed.groupBy("name", "cover").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at", "near", "far")).alias("one")), "covers")
    settled = again.where("same").select("doc", "at", "near", "far").unionAll(mixed.join(covers.where(F.col("n") > 1), ["name", "cover"]).select("doc", "at", "near", "far"))
    contexts = open_contexts(docs, covers.select("one.*", (F.col("n") > 1).alias("settled")), length, id_col, text_col)
    groups = grouped_windows(contexts, length, group)
    parts = cut(groups.join(_still_open(groups, "open-groups"), "name").groupBy("row").agg(F.collect_list("part").alias("parts")), "parts")
    windows = single_windows(contexts, parts, length, group)
    single = windows.where(~F.col("settled")).join(_still_open(windows, "open-windows"), "name").select("doc", F.col("start").alias("first"), F.col("start").alias("last"))
    return settled.select("doc", (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last")).unionAll(single)


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_bytes, the removed spans (start, end), and the remaining bytes as `kept`; these take other names where they clash."""
    own = docs.select(*keep)
    doc, data, ranges, n_bytes, spans, kept = (fresh(own, c) for c in ("_doc", "_data", "_ranges", "n_bytes", "spans", "kept"))
    found = repeated_windows(docs, length, anchor, group, id_col, text_col).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(ranges))
    found = cut(found.withColumnRenamed("doc", doc), "ranges")
    rows = docs.select(*keep, F.xxhash64(F.col(id_col), F.col(text_col)).alias(doc), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(data))
    joined = rows.join(found, doc, "left").select(*own.columns, data, ranges)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts, left = [], []
            for raw, some in zip(batch[data], batch[ranges], strict=True):
                text = np.frombuffer(raw, dtype=np.uint8)
                depth = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(depth, [r["first"] for r in some], 1)
                np.add.at(depth, [r["last"] + length for r in some], -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.nonzero(np.diff(np.concatenate([[False], gone, [False]])))[0]
                cuts.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                left.append(text[~gone].tobytes())
            out = batch.drop(columns=[data, ranges])
            out[n_bytes], out[spans], out[kept] = batch[data].map(len), cuts, left
            yield out

    none = F.array().cast("array<struct<start:int,end:int>>")
    schema = own.withColumns({n_bytes: F.lit(0).cast("long"), spans: none, kept: F.lit(b"")}).schema
    whole = joined.where(F.col(ranges).isNull()).select(*own.columns, F.length(data).cast("long").alias(n_bytes), none.alias(spans), F.col(data).alias(kept))
    return whole.unionAll(joined.where(F.col(ranges).isNotNull()).mapInPandas(work, schema))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
