"""N-gram Jaccard join: documents whose sets of word shingles overlap enough.

1. Each text becomes a set of 64-bit shingle hashes; equal sets form one class. The SKETCH smallest hashes are its sketch.
2. Classes meet in the buckets of their BAND smallest hashes (their prefix, where sets are small enough that the prefix is
   no longer). Large buckets are cut into blocks, and blocks meet in tiles. Pairs whose sketches share too little to reach the
   threshold are left; the others connect classes into coarse groups. Of each tile only connecting edges leave.
3. Within each coarse group, again in tiles, sets are joined exactly as a T-occurrence search: each set is a query to
   the tile's inverted lists. Short lists are merged by a heap (by counting, where they hold more than HEAP rows); the longest
   lists, as many as DivideSkip allows while no answer can be missed, are probed by binary search for the few rows
   that are left. Rows that reach the overlap that the threshold asks for are linked.
4. Links are contracted to connected components.

A pair at the threshold has its smallest common hash beyond both bands with a chance of (1 - similarity) ** BAND,
below 1e-12, and shares fewer than MATCHES hashes of its sketches with one below 1e-9; sets of up to 76 shingles have
their whole prefix in the band, so that no pair of those is lost. With `exact=True` every set's band is its whole prefix and
sketches rule out nothing, so no pair can be lost, for more bucket rows (a quarter of all shingles).

Defined results: texts without words, or null, have empty sets and stand alone; fewer words than a shingle make one; ids may
repeat or be null (rows count by their texts; the smallest id that is not null names a component); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, scratch, spanning_edges, table, whole_groups, width
from .components import components

WORDS = 5
#: Similarity of links in hundredths.
LIMIT = 75
BAND, SKETCH, MATCHES = 20, 48, 16
#: Rows in short lists up to which a heap merges them.
HEAP = 256
#: Rows of a block: a sixteenth of its bucket or group, within these bounds; sketches are shorter than sets.
SKETCH_BLOCK, SET_BLOCK = (512, 2048), (256, 1024)
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Rows of a tile compared with all others at once.
STRIP = 512

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACES = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in a byte array, and a hash of each."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    change = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = change[::2], change[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
    return starts, mix((sums[ends] - sums[starts]) * _powers(_UNBASE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) < CHUNK):
            size += len(raw[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(raw[at:stop]), dtype=np.uint8)
        starts, hashes = word_hashes(data)
        ends = np.cumsum([len(r) + 1 for r in raw[at:stop]])
        bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
        grams = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for k in range(words):
            grams += hashes[k : k + len(grams)] * _PLACES[k]
        grams = mix(grams)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                out.append(np.unique(grams[lo : hi - words + 1]))
            elif hi > lo:
                whole = np.uint64(hi - lo)
                for k in range(hi - lo):
                    whole = whole + hashes[lo + k] * _PLACES[k]
                out.append(mix(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        at = stop
    return out


def _needed(n: np.ndarray, m: np.ndarray, limit: int) -> np.ndarray:
    """The overlap that sets of n and m shingles must have: ceil(limit * (n + m) / (100 + limit))."""
    return -(-limit * (n + m) // (100 + limit))


def documents_sets(docs: DataFrame, words: int, id_col: str, text_col: str, limit: int = LIMIT, exact: bool = False) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, band, sketch); node names the class of equal sets, null for empty ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = shingle_sets(batch["text"].tolist(), words)
            out = batch.drop(columns="text")
            out["n_shingles"] = [len(s) for s in sets]
            out["node"] = pd.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None for s in sets], dtype="Int64")
            # the prefix: all hashes but as many as two linked sets have in common, less one
            out["band"] = [s[: len(s) - -(-limit * len(s) // 100) + 1 if exact else BAND].astype(np.int64) for s in sets]
            out["sketch"] = [s[:SKETCH].tobytes() for s in sets]
            yield out

    return cut(rows.mapInPandas(lean(work), "doc_id long, text_key long, n_shingles long, node long, band array<long>, sketch binary"), "sets")


def in_tiles(rows: DataFrame, size: str, key: str, bounds: tuple[int, int]) -> DataFrame:
    """Rows of buckets with `size` rows, dealt to tiles (i, j) of two blocks each; small buckets are one tile."""
    least, most = bounds
    block = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(size) / 16)))
    blocks = F.when(F.col(size) <= 2 * least, F.lit(1)).otherwise(F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def coarse_links(n: np.ndarray, sketches: list[bytes], token: int, limit: int, matches: int) -> np.ndarray:
    """Which rows of a tile may reach the limit, by their sizes and sketches. Rows that have met in the bucket of a smaller token are left to it."""
    lengths = np.array([len(s) // 8 for s in sketches])
    tokens, at, count = np.unique(np.frombuffer(b"".join(sketches), dtype=np.uint64), return_inverse=True, return_counts=True)
    rows, often = np.repeat(np.arange(len(n)), lengths), count[at] > 1
    column = np.cumsum(count > 1) - 1
    has = np.zeros((len(n), int((count > 1).sum())), dtype=np.float32)
    has[rows[often], column[at[often]]] = 1
    # a row's hashes are in ascending order: those before the tile's token are smaller
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = tokens[at] == np.uint64(token % 2**64)
    stop = np.full(len(n), 0)
    stop[rows[own]] = place[own]
    early = often & (place < stop[rows])
    met = np.zeros_like(has)
    met[rows[early], column[at[early]]] = 1
    met = met[:, met.any(axis=0)]
    out = np.zeros((len(n), len(n)), dtype=bool)
    for lo in range(0, len(n), STRIP):
        some = slice(lo, lo + STRIP)
        small, large = np.minimum.outer(n[some], n), np.maximum.outer(n[some], n)
        out[some] = (met[some] @ met.T == 0) & (has[some] @ has.T >= np.minimum(matches, _needed(small, large, limit))) & (100 * small >= limit * large)
    return out


def coarse_groups(classes: DataFrame, limit: int, matches: int = MATCHES) -> DataFrame:
    """(node, component) of the classes that may be linked with another."""
    tokens = classes.select("node", F.explode("band").alias("token"))
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > 1), "buckets")
    met = tokens.join(counts, "token")
    # the slim rows first: only classes that meet another carry their sketch
    slim = cut(met, "met")
    full = slim.join(classes.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    tiles = in_tiles(full, "size", "node", SKETCH_BLOCK).select("token", "i", "j", "node", "n", "sketch")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole_groups(batches, ["token", "i", "j"]):
            node, n, sketch, token = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].tolist(), rows["token"].tolist()
            a, b = [], []
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            for at in range(0, len(pairs), 4096):
                p = pairs[at : at + 4096]
                # both sketches side by side, filled up with values that match nothing; equal neighbours are common
                side = np.full((len(p), 2 * SKETCH), -1, dtype=np.int64)
                side -= np.arange(2 * SKETCH)
                for k, i in enumerate(p):
                    for half in (0, 1):
                        own = np.frombuffer(sketch[i + half], dtype=np.int64)
                        side[k, half * SKETCH : half * SKETCH + len(own)] = own
                side.sort(axis=1)
                common = (side[:, 1:] == side[:, :-1]).sum(axis=1)
                small, large = np.minimum(n[p], n[p + 1]), np.maximum(n[p], n[p + 1])
                ok = (common >= np.minimum(matches, _needed(small, large, limit))) & (100 * small >= limit * large)
                a += node[p[ok]].tolist()
                b += node[p[ok] + 1].tolist()
            for lo, hi in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
                for x, y in spanning_edges(coarse_links(n[lo:hi], sketch[lo:hi], token[lo], limit, matches)):
                    a.append(node[lo + x])
                    b.append(node[lo + y])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    dealt = tiles.repartition(width(classes.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return components(dealt.mapInPandas(lean(work), "a long, b long"))


def merged(lists: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """In how many of these lists each of n rows stands."""
    total = int(sizes.sum())
    if total > HEAP:
        return np.bincount(lists[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)], minlength=n)
    seen = np.zeros(n, dtype=np.int64)
    for row in heapq.merge(*(lists[a : a + size].tolist() for a, size in zip(starts.tolist(), sizes.tolist(), strict=True))):
        seen[row] += 1
    return seen


def t_occurrence(sets: list[np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Which rows are linked, exactly: each set in turn is searched in the inverted lists of all."""
    n = np.array([len(s) for s in sets])
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(at, kind="stable")
    lists, starts = rows[order], np.cumsum(count) - count  # the list of token t is lists[starts[t] : starts[t] + count[t]], ascending
    probes = at[order] * len(sets) + lists  # ascending: a list and a row in it as one number
    own = np.split(at, np.cumsum(n)[:-1])
    linked = np.zeros((len(sets), len(sets)), dtype=bool)
    for x, mine in enumerate(own):
        if not n[x]:
            continue
        least = -(-limit * n[x] // 100)  # no partner needs less: it has at least limit hundredths as many shingles
        mine = mine[np.argsort(count[mine], kind="stable")]
        # DivideSkip: the more answers are asked for, and the shorter the longest list, the more lists are left out of the merge
        skip = int(min(least - 1, least / (0.01 * np.log2(count[mine[-1]] + 1) + 1)))
        short, long = (mine[:-skip], mine[-skip:]) if skip > 0 else (mine, mine[:0])
        seen = merged(lists, starts[short], count[short], len(sets))
        fits = (100 * np.minimum(n, n[x]) >= limit * np.maximum(n, n[x])) & (seen >= np.maximum(1, least - skip))
        fits[: x + 1] = False
        left = np.nonzero(fits)[0]
        need = _needed(n[left], n[x], limit)
        both = seen[left]
        for step in range(0, len(long), 64):  # probe the long lists, dropping rows that can't reach what they need
            alive = both + (len(long) - step) >= need
            left, need, both = left[alive], need[alive], both[alive]
            if not len(left):
                break
            wanted = long[step : step + 64, None] * len(sets) + left
            both = both + (probes[np.minimum(np.searchsorted(probes, wanted), len(probes) - 1)] == wanted).sum(axis=0)
        linked[x, left[both >= need]] = True
    return linked | linked.T


def exact_links(docs: DataFrame, chosen: DataFrame, words: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Connecting edges (a, b) between linked classes. chosen: (doc_id, text_key, node, component, size), a text for each class."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    # the chosen grow with the documents: both sides are dealt by their key at every size
    found = texts.join(chosen.hint("merge"), (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("component", "size", "node", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = shingle_sets(batch["text"].tolist(), words)
            out = batch.drop(columns="text")
            out["shingles"] = [s.tobytes() for s in sets]
            yield out

    sets = found.mapInPandas(lean(hashed), "component long, size long, node long, shingles binary")
    tiles = in_tiles(sets, "size", "node", SET_BLOCK).select("component", "i", "j", "node", "shingles")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole_groups(batches, ["component", "i", "j"]):
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                tile = rows.iloc[lo:hi].drop_duplicates("node")
                node = tile["node"].to_numpy()
                for x, y in spanning_edges(t_occurrence([np.frombuffer(s, dtype=np.uint64) for s in tile["shingles"]], limit)):
                    a.append(node[x])
                    b.append(node[y])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    dealt = tiles.repartition(width(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInPandas(lean(join), "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) for each row; component names the group even where ids are null."""
    with scratch(docs.sparkSession) as inner:
        sets = inner.keep(documents_sets(docs, words, id_col, text_col, limit, exact))
        one = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n_shingles", "band", "sketch")
        classes = cut(sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(one).alias("one")).select("node", "one.doc_id", "one.text_key", "one.n_shingles", "one.band", "one.sketch"), "classes")
        groups = cut(coarse_groups(classes, limit, 0 if exact else MATCHES), "coarse")
        sizes = cut(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        members = cut(groups.join(sizes, "component"), "members")
        chosen = cut(classes.select("node", "doc_id", "text_key").join(members, "node"), "chosen")
        links = components(exact_links(docs, chosen, words, limit, id_col, text_col))
        named = cut(classes.select("node", "doc_id").join(links, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "named")
        least = cut(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
        final = inner.keep(cut(named.join(least, "component").select("node", "component", "least"), "final"))
    rows = sets.select("doc_id", "text_key", "n_shingles", "node").join(final, "node", "left")
    return rows.select("doc_id", "text_key", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first, by id, of each group of linked ones. Documents without words stay."""
    key, id_, own = (fresh(docs, c) for c in ("_key", "_id", "_own"))
    with scratch(docs.sparkSession) as inner:
        rows = cut(jaccard_components(docs, words, limit, id_col, text_col).where(F.col("component").isNotNull()), "grouped")
        grouped = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
        first = inner.keep(cut(grouped.select(F.col("first.doc_id").alias(id_), F.col("first.text_key").alias(key)), "first"))
        # rows that repeat id and text: one of each stays
        again = inner.keep(cut(rows.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), "repeated"))
    empty = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (F.xxhash64(text_col) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(id_))
    kept = docs.where(~empty).join(first, same, "left_semi")
    if not again.isEmpty():
        single = kept.join(again, same, "left_semi").withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, own]).drop(own)
        kept = kept.join(again, same, "left_anti").unionByName(single)
    return kept.unionByName(docs.where(empty))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
