"""Benchmark decontamination: an FM-index for each shard of the documents, searched for the benchmark's phrases.

A task reads its documents shard by shard. A shard's words become symbols; words that no phrase holds are all the same to a
search, so they end a run, and runs too short for any phrase are left out. The suffixes of what is left are sorted by prefix
doubling, and their Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with counts for each word of them. All
phrases step backward through its ranks at once; those that occur are located by walking to sampled positions. A
document's hits are merged to spans of words, given in code points too, so that `decontaminate` can cut them out.

Documents stay where they are read: nothing is shuffled and no group forms, however often a passage occurs. Phrases are dealt to
blocks of at most BLOCK, of which one is broadcast for each pass over the documents; the passes are chained, each adding to
the spans of the one before, so the benchmark may be of any size.

Defined results: null texts and items have no words; an item without words, or with a null id, is never found; items with equal phrases are all
found; repeated item ids count once; repeated documents fare alike; an empty benchmark leaves all clean; very long texts are
cut to pieces that overlap; other columns of the documents stay, and new ones take other names where they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, table

WINDOW = 10
#: Phrases that a pass looks for, at most about.
BLOCK = 1 << 17
#: Symbols in a shard, about.
SHARD = 1 << 21
#: Every so many positions, and each run's first, are kept for locating.
SAMPLE = 8
#: Rows that are located at once.
LOCATED = 1 << 20
SPAN = "struct<word:int,after:int,start:int,end:int>"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each byte in lower case, or a space where it is in no word. Bytes of 128 and more are parts of characters beyond ASCII.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


# --- the index


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling. Zeros are separators, each its own smallest symbol in its turn; the text ends with one."""
    n = len(text)
    ends = np.nonzero(text == 0)[0]
    order = np.concatenate([ends, (rest := np.nonzero(text)[0])[np.argsort(text[rest], kind="stable")]])
    new = np.ones(n, dtype=bool)
    new[len(ends) + 1 :] = np.diff(text[order[len(ends) :]]) != 0
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # only suffixes that share their rank go on; a separator within the prefix makes a rank unique, so position + h is in the text
    left, h = _shared(order, new), 1
    while len(left):
        pair = rank[left] * n + rank[left + h]
        by = np.argsort(pair, kind="stable")
        left, pair = left[by], pair[by]
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = rank[left]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        where = np.arange(len(left))
        begin = np.maximum.accumulate(np.where(head, where, 0))
        order[group + where - begin] = left
        rank[left] = group + np.maximum.accumulate(np.where(first, where, 0)) - begin
        left, h = _shared(left, first), 2 * h
    return order


def _shared(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What is ordered beside others of the same rank; `new` marks where a rank begins."""
    return order[~(new & np.append(new[1:], True))]


class Bits:
    """A bit vector with ranks: 64 bits to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), dtype="<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Ranks of symbols in a sequence by a matrix of bits: each level deals out the sequence by one bit of its symbols, zeros first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        starts = np.zeros(n_symbols, dtype=np.int64)
        names = np.arange(n_symbols)
        for level in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            row, zeros = Bits(bits), int(len(bits) - np.count_nonzero(bits))
            self.levels.append((level, row, zeros))
            starts = _step(row, zeros, (names >> level) & 1 == 1, starts)
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        #: Where each symbol's rows begin on the last level.
        self.starts = starts

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        for level, row, zeros in self.levels:
            i = _step(row, zeros, (symbol >> level) & 1 == 1, i)
        return i - self.starts[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i, and how often it is before."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for level, row, zeros in self.levels:
            bit = row.at(i)
            symbol |= bit.astype(np.int64) << level
            i = _step(row, zeros, bit, i)
        return symbol, i - self.starts[symbol]


def _step(row: Bits, zeros: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
    ones = row.ones(i)
    return np.where(bit, zeros + ones, i - ones)


class FMIndex:
    """Backward search and locating in a text of symbols 1 .. n_symbols - 1 with zeros as separators, one at its end."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(text)
        self.bwt = Wavelet(text[order - 1].astype(np.int64), n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # a run's first position is kept, so that no walk passes a separator
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.marked, self.samples = Bits(kept), order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each phrase; phrases are rows of symbols, filled up with zeros at their ends."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.first[-1])
        for column in range(phrases.shape[1] - 1, -1, -1):
            on = np.nonzero((low < high) & (phrases[:, column] > 0))[0]
            symbol = phrases[on, column]
            low[on], high[on] = self.first[symbol] + self.bwt.rank(symbol, low[on]), self.first[symbol] + self.bwt.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of these rows' suffixes, each by walking back to one that is kept."""
        at, walked, out = rows.copy(), 0, np.empty(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked.at(at)
            out[open_[hit]] = self.samples[self.marked.ones(at[hit])] + walked
            open_, at = open_[~hit], at[~hit]
            symbol, rank = self.bwt.symbol_and_rank(at)
            at, walked = self.first[symbol] + rank, walked + 1
        return out


# --- phrases and shards


class Phrases:
    """A block of phrases with the items that hold them, and the symbols of their words."""

    def __init__(self, pairs: list[tuple[str, str]]):
        """pairs: (item, phrase with single spaces between its words)."""
        items: dict[str, list[str]] = {}
        for item, phrase in pairs:
            items.setdefault(phrase, []).append(item)
        split = [p.encode().split(b" ") for p in items]
        self.symbols: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.symbols.setdefault(w, len(self.symbols) + 1)
        self.items = [sorted(set(some)) for some in items.values()]
        self.sizes = np.array([len(w) for w in split], dtype=np.int64)
        self.rows = np.zeros((len(split), int(self.sizes.max(initial=1))), dtype=np.int64)
        for row, words in zip(self.rows, split, strict=True):
            row[: len(words)] = [self.symbols[w] for w in words]
        #: The shortest phrase that begins with each symbol: a run without room for any is no use.
        self.shortest = np.full(len(self.symbols) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.shortest, self.rows[:, 0], self.sizes)

    def runs(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(first word, symbols) of each run of the phrases' words that has room for a phrase."""
        got = np.fromiter((self.symbols.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        gaps = np.concatenate([[-1], np.nonzero(got == 0)[0], [len(got)]])
        ends = np.repeat(gaps[1:], np.diff(gaps))[: len(got)]
        room = self.shortest[got] <= ends - np.arange(len(got))
        fits = np.unique(np.searchsorted(gaps, np.nonzero(room)[0], side="right") - 1)
        return [(int(gaps[k]) + 1, got[gaps[k] + 1 : gaps[k + 1]]) for k in fits]

    def find(self, texts: Iterable[list[bytes]], limit: int = SHARD) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Each text's number of words, its hit spans of words (first, after the last), and the items found in it, shard by shard."""
        sizes: list[int] = []
        spans: list[list[tuple[int, int]]] = []
        found: list[set[str]] = []
        longest, held, n = self.rows.shape[1], [], 0
        for d, words in enumerate(texts):
            sizes.append(len(words))
            spans.append([])
            found.append(set())
            for at, run in self.runs(words):
                # a long run is cut so that each phrase lies in a piece
                for start in range(0, max(1, len(run) - longest + 1), limit):
                    piece = run[start : start + limit + longest - 1]
                    if n and n + len(piece) > limit:
                        self._search(held, spans, found)
                        held, n = [], 0
                    held.append((d, at + start, piece))
                    n += len(piece) + 1
        if held:
            self._search(held, spans, found)
        return sizes, spans, [sorted(f) for f in found]

    def _search(self, runs: list[tuple[int, int, np.ndarray]], spans: list[list[tuple[int, int]]], found: list[set[str]]) -> None:
        """Index the runs (text, first word, symbols), and add what occurs in them to their texts' spans and items."""
        zero = np.zeros(1, dtype=np.int64)
        text = np.concatenate([x for _, _, symbols in runs for x in (symbols, zero)])
        begins = np.cumsum([0] + [len(symbols) + 1 for _, _, symbols in runs])[:-1]
        doc, offset = np.array([d for d, _, _ in runs]), np.array([at for _, at, _ in runs]) - begins
        index = FMIndex(text, len(self.symbols) + 1)
        low, high = index.search(self.rows)
        hit = np.nonzero(high > low)[0]
        depth = np.zeros(len(text) + 1, dtype=np.int64)
        for some in _batches(high[hit] - low[hit]):
            which = hit[some]
            n = high[which] - low[which]
            phrase = np.repeat(which, n)
            position = index.locate(np.repeat(low[which] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            np.add.at(depth, position, 1)
            np.add.at(depth, position + self.sizes[phrase], -1)
            for pair in np.unique(doc[np.searchsorted(begins, position, side="right") - 1] * len(self.rows) + phrase).tolist():
                found[pair // len(self.rows)].update(self.items[pair % len(self.rows)])
        edges = np.nonzero(np.diff(np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])))[0]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = int(np.searchsorted(begins, a, side="right")) - 1
            spans[doc[run]].append((a + int(offset[run]), b + int(offset[run])))


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in batches of about LOCATED rows."""
    if len(sizes):
        batch = np.cumsum(sizes) // LOCATED
        yield from np.split(np.arange(len(sizes)), np.nonzero(np.diff(batch))[0] + 1)


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of words that overlap or touch made one; (first word, after the last, first character, after the last)."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            a, b, start, end = out[-1]
            out[-1] = (a, max(b, span[1]), start, max(end, span[3]))
        else:
            out.append(span)
    return out


def _placed(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of words with their places in the text, in code points."""
    if not spans:
        return []
    ends = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, byte, char = [], 0, 0
    for a, b in spans:
        places = []
        for at in (ends[a][0], ends[b - 1][1]):
            char += len(raw[byte:at].decode("utf-8", "replace"))
            byte = at
            places.append(char)
        out.append((a, b, *places))
    return out


# --- frames


def phrase_pairs(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, phrase): every window of each item's words, or all of them where they are fewer."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(_ITEM_WORD), F.lit(0))
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return rows.select("item", F.explode(starts).alias("i"), "w").select("item", F.array_join(F.slice("w", F.col("i"), F.lit(window)), " ").alias("phrase")).distinct()


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> tuple[DataFrame, dict[str, str]]:
    """The documents with n_words, spans (array<struct<word, after, start, end>>) and items (array<string>), and those columns' names."""
    name = {c: fresh(docs, c) for c in ("n_words", "spans", "items", "_bytes")}
    size, spans, items, raw = name.values()
    pairs = cut(phrase_pairs(benchmark, window, item_col, item_text), "phrases")
    n_blocks = max(1, -(-pairs.count() // block))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item", "phrase"), F.lit(n_blocks)))
    rows = docs.withColumns({raw: F.col(text_col).cast("binary"), size: F.lit(0).cast("long"), spans: F.array().cast(f"array<{SPAN}>"), items: F.array().cast("array<string>")})
    for k in range(n_blocks):
        some = dealt.where(F.col("block") == k).select("item", "phrase").toPandas()  # about BLOCK rows
        wanted = docs.sparkSession.sparkContext.broadcast(Phrases(list(some.itertuples(index=False, name=None))))

        def work(batches: Iterator[pd.DataFrame], wanted=wanted) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [x or b"" for x in batch[raw]]
                sizes, hits, found = wanted.value.find(x.translate(_FOLD).split() for x in texts)
                held = [[(s["word"], s["after"], s["start"], s["end"]) for s in some] for some in batch[spans]]
                done = [merged(old + _placed(x, new)) for x, old, new in zip(texts, held, hits, strict=True)]
                both = [sorted({*old, *new}) for old, new in zip(batch[items], found, strict=True)]
                yield batch.assign(**{size: sizes, spans: [[dict(zip(("word", "after", "start", "end"), s, strict=True)) for s in some] for some in done], items: both})

        rows = rows.mapInPandas(lean(work), rows.schema)
    return rows.drop(raw), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, columns as before, with the benchmark's passages cut out of their texts."""
    rows, name = search(docs, benchmark, text_col=text_col, **options)
    spans = F.col(name["spans"])
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text_col)))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(F.col(text_col), a + 1, b - a)), "")
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, kept).otherwise(F.col(text_col))).select(*docs.columns)


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    rows, name = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col(name["items"])
    hit = F.aggregate(name["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["after"] - s["word"]))
    return rows.select("doc_id", name["n_words"], hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), x AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))
), h AS (SELECT rid, i, n, item FROM x JOIN p USING (n, phrase)),
c AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN f USING (rid)
"""
