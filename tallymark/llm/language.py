"""Language identification by prediction by partial matching.

A tree of byte contexts is counted for each language: how often each byte follows each context of up to
`max_order` bytes. Statistics are frozen after training. A text costs, per language, the sum of its bytes' code lengths:
the longest context known to the language predicts the byte, or an escape (as probable as the context's share of new
bytes, method C) goes to the next shorter one, down to even odds over all bytes. The language with the
shortest code wins.

Trees are fitted on a sample bounded by `max_docs` documents for each language, whole texts, chosen by a hash of
the id; all documents are scored, in full. All languages' code lengths for one context and byte stand in one row, so a
text needs one search for each byte and order.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the first language by code point;
a null language teaches nothing; without any training row everything is `und`; a null id counts as the empty word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

MAX_ORDER = 3
#: Training documents for each language, about.
MAX_DOCS = 400
#: Bytes scored at once.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte the `order` bytes before it and itself, as one number; missing bytes are 0."""
    key = data.astype(np.uint64)
    out = key.copy()
    for back in range(1, order + 1):
        out[back:] |= key[:-back] << np.uint64(8 * back)
    return out


def gram_counts(texts: DataFrame, max_order: int) -> DataFrame:
    """(lang, size, gram, n): how often each string of 1 to max_order + 1 bytes occurs in each language."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                # texts are kept apart by max_order spaces
                data = np.frombuffer((b" " * max_order).join(map(prepared, part["text"])), dtype=np.uint8)
                for order in range(min(max_order + 1, len(data))):
                    grams, n = np.unique(windows(data, order)[order:], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "size": order + 1, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})

    counted = texts.select("lang", "text").mapInPandas(work, "lang string, size int, gram long, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """All languages' trees as sorted keys with a row of code lengths each."""

    def __init__(self, counts: pd.DataFrame, max_order: int):
        self.langs = sorted(counts["lang"].unique(), key=lambda s: s.encode())
        self.max_order = max_order
        at = {lang: i for i, lang in enumerate(self.langs)}
        n_langs = len(self.langs)
        self.even = np.full((256, n_langs), 8.0)
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for order in range(max_order + 1):
            of = counts[counts["size"] == order + 1]
            grams, row = np.unique(of["gram"].to_numpy(dtype=np.uint64), return_inverse=True)
            n = np.zeros((len(grams), n_langs))
            n[row, of["lang"].map(at).to_numpy(dtype=int)] = of["n"]
            contexts, parent = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, parent, n)
            np.add.at(kinds, parent, n > 0)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(known, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[parent])
            shorter = self._cost(grams & np.uint64((1 << (8 * order)) - 1), order - 1) if order else self.even[grams.astype(int)]
            self.keys.append(grams)
            self.bits.append(np.where(n > 0, own, escape[parent] + shorter))
            self.contexts.append(contexts)
            self.escapes.append(escape)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))

    def _cost(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Code lengths (grams x languages) of each gram's last byte after the bytes before it."""
        at, found = self._find(self.keys[order], grams)
        out = self.bits[order][at] if len(self.keys[order]) else np.zeros((len(grams), len(self.langs)))
        rest = np.nonzero(~found)[0]
        if len(rest):
            some = grams[rest]
            context, seen = self._find(self.contexts[order], some >> np.uint64(8))
            escape = np.where(seen[:, None], self.escapes[order][context], 0.0) if len(self.contexts[order]) else 0.0
            if order == 0:
                shorter = self.even[(some & np.uint64(255)).astype(int)]
            else:
                shorter = self._cost(some & np.uint64((1 << (8 * order)) - 1), order - 1)
            out[rest] = escape + shorter
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns); texts don't see each other."""
        out = np.zeros((len(texts), len(self.langs)))
        gap = b" " * self.max_order
        group: list[int] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if group and (text is None or size + len(text) > CHUNK):
                data = b"".join(gap + texts[j] for j in group)
                ends = np.cumsum([len(texts[j]) + len(gap) for j in group])
                self._add(data, ends, out, group)
                group, size = [], 0
            if text is None:
                break
            if len(text) > CHUNK:  # in steps, each with the bytes before it as context
                for at in range(0, len(text), CHUNK):
                    before = (gap + text[:at])[-self.max_order :] if self.max_order else b""
                    data = before + text[at : at + CHUNK]
                    self._add(data, np.array([len(data)]), out, [i])
            elif text:
                group.append(i)
                size += len(text) + len(gap)
        return out

    def _add(self, data: bytes, ends: np.ndarray, out: np.ndarray, rows: list[int]) -> None:
        cost = self._cost(windows(np.frombuffer(data, dtype=np.uint8), self.max_order), self.max_order)
        starts = np.concatenate([[0], ends[:-1]])
        for back in range(self.max_order):  # the gaps are context only
            cost[starts + back] = 0
        out[rows] += np.add.reduceat(cost, starts, axis=0)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(labelled: DataFrame, max_order: int = MAX_ORDER, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees | None:
    """Trees from about `max_docs` documents of each language; None without any."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1_000_000)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, -(-max_docs * 1_000_000 // n))))]), F.col("lang"))
    counts = gram_counts(rows.where(F.col("draw") < share), max_order).toPandas()  # bounded by the sample
    return ContextTrees(counts, max_order) if len(counts) else None


def predict(docs: DataFrame, trees: ContextTrees | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score, the winner's share of probability under even priors; these take other names where they clash."""
    kept = docs.select(*keep)
    raw, lang_pred, likely = (fresh(kept, c) for c in ("_text", "lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = [prepared(t) if model and t and _LETTER.search(t) else b"" for t in batch[raw]]
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t]
            if rows:
                bits = model.code_lengths([texts[i] for i in rows])
                best = bits.argmin(axis=1)
                more = bits - bits[np.arange(len(rows)), best][:, None]
                pred[rows] = np.array(model.langs, dtype=object)[best]
                score[rows] = 1 / np.exp2(-np.minimum(more, 1000)).sum(axis=1)
            out = batch.drop(columns=raw)
            out[lang_pred], out[likely] = pred, score
            yield out

    rows = docs.select(*keep, F.col(text_col).alias(raw))
    schema = kept.withColumn(lang_pred, F.lit("")).withColumn(likely, F.lit(0.0)).schema
    return rows.mapInPandas(work, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out()))
    return predict(docs, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
