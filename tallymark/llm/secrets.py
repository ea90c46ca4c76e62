"""Secret scans with corpus-wide ownership frequency.

Patterns find spans in each text. Every span's value is hashed and counted over the whole corpus by distinct
repositories (rows) and owners: a value of many owners or repositories is a widely copied example, one of few looks live.
Base spans always stay. Long mixed tokens that no base pattern covers are candidates; live ones are added as spans of
the kind `owned`, copied ones are not.

Only hashes, owners and positions are shuffled, never texts: `redact` counts the candidates first and then finds the spans
anew beside each text. Texts meet verdicts only where they hold a candidate.

Defined results: a null or empty text has no spans; a null owner counts as an owner of its own; repeated rows are
repositories of their own, of the same owner; positions are code points; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, table

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED = (re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9].*[0-9]"))
#: A value with more owners than this, or in more repositories, is an example that people copy.
MAX_OWNERS, MAX_REPOSITORIES = 2, 1000
#: Bits for each character of a candidate, at least.
MIN_ENTROPY = 3.5
SPANS = "array<struct<start:int,kind:int,end:int,value:long>>"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def find(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value), by start and kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b, _ in found)
    at = reach = 0  # base spans that begin before the candidate's end, and how far they go
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and all(p.search(m[0]) for p in MIXED) and entropy(m[0]) >= MIN_ENTROPY:
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted((a, kind, b, int.from_bytes(hashlib.blake2b(f"{kind}:{v}".encode(), digest_size=8).digest(), "big", signed=True)) for a, kind, b, v in found)


def _verdicts(values: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(value, owners, repositories, live) from rows (value, owner, row). A hot value is counted in parts, by row and owner first."""
    owners = values.groupBy("value", "owner", "row").agg(F.lit(1).alias("n")).groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    counted = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return cut(counted.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)), "owners")


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", keep: tuple[str, ...] | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, str]:
    """The documents' columns `keep` (all but the text, if not given) with their final spans, and the new column's name.

    A span is (start, kind, end, owners, repositories, live).
    """
    out, row, text, owner, of, found = (fresh(docs, c) for c in ("spans", "_row", "_text", "_owner", "_of", "_found"))
    shown = [c for c in docs.columns if c != text_col] if keep is None else list(keep)
    rows = docs.select(*shown, F.col(text_col).alias(text), F.col(owner_col).cast("string").alias(owner), F.monotonically_increasing_id().alias(row))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[dict(zip(("start", "kind", "end", "value"), x, strict=True)) for x in find(t)] if t else [] for t in batch[text]]
            batch = batch.drop(columns=text)
            batch[found] = spans
            yield batch

    schema = rows.drop(text).withColumn(found, F.array().cast(SPANS)).schema
    scanned = cut(rows.mapInPandas(lean(work), schema), "scanned")
    spans = scanned.where(F.size(found) > 0).select(F.col(row).alias("row"), F.col(owner).alias("owner"), F.explode(found).alias("s")).select("row", "owner", "s.*")
    judged = spans.join(_verdicts(spans, max_owners, max_repositories), "value").where((F.col("kind") < 3) | F.col("live"))
    final = judged.groupBy(F.col("row").alias(of)).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias(out))
    return scanned.drop(found, owner).join(final, F.col(row) == F.col(of), "left").drop(of, row), out


def listed(spans, only_base: bool):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] < 3) if only_base else spans
    words = F.transform(kept, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(words, ","), F.lit(""))


def live_values(docs: DataFrame, text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(text_key, live): the live candidate values of each text that holds one, by the hash of the text."""
    rows = docs.where(F.col(text_col).rlike(CANDIDATE.pattern)).select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.monotonically_increasing_id().alias("row"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [list({x[3] for x in find(t) if x[1] == 3}) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["value"] = values
            yield out[out["value"].map(len) > 0]

    found = cut(rows.mapInPandas(lean(work), "text_key long, owner string, row long, value array<long>"), "candidates")
    values = found.withColumn("value", F.explode("value"))
    live = _verdicts(values, max_owners, max_repositories).where("live").select("value")
    return cut(values.join(live, "value").groupBy("text_key").agg(F.collect_set("value").alias("live")), "live")


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", mark: str = "[{kind}]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The documents with every span replaced by its mark; overlapping spans become one mark. Texts without spans don't change."""
    key, live = fresh(docs, "_text_key"), fresh(docs, "_live")
    values = live_values(docs, text_col, owner_col, max_owners, max_repositories).select(F.col("text_key").alias(key), F.col("live").alias(live))
    # the table's files tell its size: Spark broadcasts it while it is small; beyond, only texts with candidates are shuffled
    held = F.coalesce(F.col(text_col).rlike(CANDIDATE.pattern), F.lit(False))
    with_values = docs.where(held).join(values, F.xxhash64(text_col) == F.col(key), "left").drop(key)
    rows = with_values.unionByName(docs.where(~held).withColumn(live, F.lit(None).cast("array<long>")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[text_col] = [cover(t, set() if own is None else set(own)) if t else t for t, own in zip(batch[text_col], batch[live], strict=True)]
            yield batch.drop(columns=live)

    def cover(text: str, own: set[int]) -> str:
        out, at = [], 0
        for start, kind, end, value in find(text):
            if kind == 3 and value not in own:
                continue
            if start >= at:
                out += [text[at:start], mark.format(kind=KINDS[kind])]
            at = max(at, end)
        return "".join(out) + text[at:]

    return rows.mapInPandas(lean(work), docs.schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found, name = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    spans = F.col(name)
    count = lambda test: F.coalesce(F.size(F.filter(spans, test)), F.lit(0)).cast("long")
    # a test takes one argument: Spark hands the index to a second, whatever its default
    of_kind = lambda k: lambda s: s["kind"] == k
    return found.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(spans, True).cast("binary"), 256).alias("base_sha256"),
        listed(spans, False).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
