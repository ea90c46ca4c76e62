"""Clustering, decontamination and the filter audit, against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import filter_audit, fm_index, hamerly

# --- clustering


def by_hand(rows, k, rounds, d, scale=256, seed="2"):
    kept = [(i, [max(-hamerly.MOST, min(hamerly.MOST, int(np.floor(float(np.float32(x)) * scale)))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None))[:k]
    centroids = [q for _, q in first]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        label = [nearest(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            own = [q for (_, q), at in zip(kept, label, strict=True) if at == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, nearest(q)[1], nearest(q)[0]) for i, q in kept), key=repr), centroids


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, cluster int")
    state, centroids = hamerly.cluster_vectors(df, **options)
    return state, centroids


def blobs(n, d, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, d))
    return [(i, (middles[i % 6] + rng.normal(size=d) * 0.2).astype(float).tolist()) for i in range(n)]


def test_clusters_by_hand(spark):
    rows = blobs(150, 4) + [(150, None), (151, []), (152, [1.0, None, 0.0, 0.0]), (153, [1.0, float("nan"), 0.0, 0.0]), (154, [1.0, 2.0, float("-inf"), 0.0]), (155, [1.0] * 5), (None, [0.1, 0.2, 0.3, 0.4]), (7, [0.0] * 4), (7, [0.0] * 4), (160, [0.5, -0.5, 0.0, 0.001])]
    state, centroids = clustered(spark, rows, k=9, rounds=4, d=4)
    want, middles = by_hand(rows, 9, 4, 4)
    got = hamerly.with_distances(state, centroids).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want and centroids.tolist() == middles
    # bounds hold, and spare most scans
    for r in state.collect():
        q = np.frombuffer(r.v, dtype="<i4").astype(float)
        near = np.sqrt(((np.array(middles) - q) ** 2).sum(axis=1))
        assert r.upper >= near[r.cluster] - 1e-6 and r.lower <= np.delete(near, r.cluster).min() + 1e-6
    assert state.agg(F.sum("scans")).first()[0] < 0.6 * 5 * len(want)


def test_clusters_of_ties_and_large_numbers(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    wide = [(100 + i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(8)]
    for rows in (grid, grid + wide, wide, grid[:3], [(1, [0.0, 0.0])] * 5):
        state, centroids = clustered(spark, rows, k=5, rounds=3, d=2)
        want, middles = by_hand(rows, 5, 3, 2)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in hamerly.with_distances(state, centroids).collect()), key=repr) == want
        assert centroids.tolist() == middles


def test_clusters_of_nothing(spark):
    state, centroids = clustered(spark, [(1, None), (2, [1.0])], k=3, rounds=2, d=2)
    assert state.count() == 0 and len(centroids) == 0
    assert hamerly.with_distances(state, centroids).count() == 0


# --- decontamination


def test_suffixes_in_order():
    rng = np.random.default_rng(4)
    for _ in range(30):
        text = np.append(rng.integers(0, rng.integers(2, 6), rng.integers(1, 80)), 0)
        ends = {int(p): -int(len(text) - i) for i, p in enumerate(np.nonzero(text == 0)[0])}
        # each separator is its own symbol, below all words, in its turn
        key = [[ends.get(p, int(text[p])) for p in range(s, len(text))] for s in range(len(text))]
        assert fm_index.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda s: key[s])


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    for n_symbols in (2, 3, 9, 70):
        text = np.append(rng.integers(0, n_symbols, 700), 0).astype(np.int64)
        index = fm_index.FMIndex(text, n_symbols, sample=5)
        phrases = np.zeros((60, 4), dtype=np.int64)
        for row in phrases:
            size = rng.integers(1, 5)
            row[:size] = rng.integers(1, n_symbols, size)
        low, high = index.search(phrases)
        for row, a, b in zip(phrases, low, high, strict=True):
            want = row[row > 0]
            places = [p for p in range(len(text) - len(want) + 1) if (text[p : p + len(want)] == want).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, passage in items:
        w = words_of(passage)
        if item is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def passages(seed=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "a", "éñ", "b2", "zz", "Q", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 6, 9])))) for i in range(12)] + [(3, "again the item"), (None, "a a"), (20, None), (21, " .. "), (22, "zz, ZZ-zz zz! zz zz"), (23, "zz zz zz zz zz zz")]
    docs = [(i, "".join(word() + rng.choice([" ", ", ", "\n", "🙂 ", " other "]) for _ in range(rng.randrange(40)))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (102, "..."), (None, "zz " * 300), (103, "again: THE item")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_passages_by_hand(spark, block):
    docs, items = passages()
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, spans string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, name = fm_index.search(df, bench, window=4, block=block)
    rows = got.collect()
    assert len(rows) == len(docs) and rows[0].spans == "x"
    want = sorted(((d, *hits_by_hand(t, items, 4)) for d, t in docs), key=repr)
    assert sorted(((r.doc_id, r[name["n_words"]], sum(s.after - s.word for s in r[name["spans"]]), r[name["items"]]) for r in rows), key=repr) == want
    assert any(n for _, _, n, _ in want) and any(not n for _, _, n, _ in want)
    for r in rows:
        for s in r[name["spans"]]:
            assert words_of(r.text[s.start : s.end]) == words_of(r.text)[s.word : s.after]
    clean = fm_index.decontaminate(df, bench, window=4, block=block)
    assert clean.columns == df.columns
    cut = {(r.doc_id, r.text) for r in clean.collect()}
    assert (103, "") in cut and (100, None) in cut and (102, "...") in cut
    gone = lambda text, spans: "".join(text[a:b] for a, b in zip([0, *[s.end for s in spans]], [*[s.start for s in spans], len(text)], strict=True))
    assert cut == {(r.doc_id, None if r.text is None else gone(r.text, r[name["spans"]])) for r in rows}


def test_shards_and_pieces_change_nothing():
    docs, items = passages(7)
    phrases = fm_index.Phrases([(str(i), p) for i, t in items if words_of(t) for p in {" ".join(words_of(t)[k : k + 3]) for k in range(max(1, len(words_of(t)) - 2))}])
    texts = [[w.encode() for w in words_of(t)] for _, t in docs]
    sizes, spans, found = phrases.find(texts)
    assert any(spans) and sizes == [len(t) for t in texts]
    for limit in (1, 7, 50):
        _, other, same = phrases.find(texts, limit)
        assert [[s[:2] for s in fm_index.merged([(*x, *x) for x in o])] for o in other] == spans and same == found


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    got, name = fm_index.search(docs, empty)
    assert sorted((r.doc_id, r[name["n_words"]], r[name["spans"]], r[name["items"]]) for r in got.collect()) == [(1, 3, [], []), (2, 0, [], [])]
    assert fm_index.search(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"))[0].count() == 0


# --- the audit


def audit_by_hand(docs, labels):
    text = lambda t: t or ""
    place = lambda i: float("inf") if i is None else i
    smallest = {}
    for i, t, _ in docs:
        smallest[text(t)] = min(place(i), smallest.get(text(t), float("inf")))
    out = {}
    for i, t, part in docs:
        t = text(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": place(i) > smallest[t]}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        out.setdefault(part or "", []).append((fails, good, toxic))
    rows = set()
    for part, some in out.items():
        removed_of = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = some
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                removed_of[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), sum(x[0][f] for x in some) - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in some), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        rows |= {(part, o, s, *rest, removed_of[f]) for o, s, f, *rest in steps}
    return rows


def test_audit_by_hand(spark):
    rng = random.Random(8)
    long = [" ".join(f"w{rng.randrange(n)}" for _ in range(60)) for n in (10, 60, 400)]
    texts = [None, "", "  ", "One", "ABC DEF", "a #b", *long, long[2] + " A$", long[0].upper(), "Ünï 🙂"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(120)] + [(5, "One", "a"), (5, "One", "b"), (1, "One", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(30)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, source string, part string, good int")
    got = filter_audit.audit(filter_audit.flagged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {tuple(r) for r in got.collect()} == audit_by_hand(docs, labels)
    none = filter_audit.audit(filter_audit.flagged(df.limit(0), None))
    assert none.count() == 0
    bare = filter_audit.audit(filter_audit.flagged(df, None)).where("good_lost + toxic_lost > 0")
    assert bare.count() == 0
