"""Operators on texts, against brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import bpe, html, language, mixing, ngram_join, quality, secrets, suffix_dedup, tokenfiles, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "Ünï cödé 🙂 x", None), (7, "word " * 3000, "a")]


def odd(spark, empty=False):
    """Nulls, blanks, ties, repeated rows, a long text, and columns with names that operators use."""
    rows = [] if empty else [(*r, 1, "x", 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, spans string, n_words int")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_copies(seed=1, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 30, 90, 200]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(words)))
    return out


def test_join_by_brute_force(spark):
    rows = near_copies() + [(100, None), (101, ""), (102, "A b"), (103, "a B"), (104, "a b c")]
    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {d: (len(s), group[d]) for d, s in sets.items()}
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted(d for d in sets if group[d] == d)


def test_join_of_large_groups_in_small_blocks(spark, monkeypatch):
    """Chains, whose ends are linked only through their middle, and near copies, over many blocks of a bucket and of a group."""
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", (2, 4))
    monkeypatch.setattr(ngram_join, "SET_BLOCK", (2, 4))
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(["copy"] * 3 + words[200:280] + [f"end{i}"])) for i in range(30)]
    rows += [(200 + i, " ".join(words[200:230] + [f"other{i}-{k}" for k in range(40)])) for i in range(20)]
    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d in sets}
    for _ in range(len(rows)):
        before = dict(group)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group and set(group.values()) == {0, 100, *range(200, 220)}


def test_exact_join_and_recall(spark):
    df = spark.createDataFrame(near_copies(seed=11, n=300), "doc_id long, text string")
    exact = ngram_join.jaccard_components(df, exact=True).select("doc_id", "n_shingles", "component_id")
    fast = ngram_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id")
    assert exact.count() == 300 and exact.exceptAll(fast).count() == 0


@pytest.mark.parametrize("heap", [0, 256, 10**9])
def test_t_occurrence_by_brute_force(heap, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAP", heap)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(120)]
    sets += [s[:-1] if len(s) > 4 else s for s in sets[:30]]
    got = ngram_join.t_occurrence(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * both >= 75 * (len(a) + len(b) - both))


def test_repeats_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    shared = "".join(rng.choice("abcdefgh") for _ in range(50))
    rows += [(50 + i, "".join(rng.choice("xyz") for _ in range(i * 7)) + shared[: 50 - i] + "é") for i in range(6)] + [(90, None), (91, ""), (92, "ab" * 40), (93, "ab" * 40)]
    length, seen = 20, {}
    data = {d: (t or "").encode() for d, t in rows}
    for d, b in data.items():
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = {d: set() for d in data}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup.dedup(df, length=length, anchor=6, group=4).collect():
        assert bytes(r.kept) == bytes(x for i, x in enumerate(data[r.doc_id]) if i not in gone[r.doc_id])
        assert sum(s.end - s.start for s in r.spans) == len(gone[r.doc_id]) and r.n_bytes == len(data[r.doc_id])


def test_long_texts_are_read_in_steps(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 50)
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    slices = list(suffix_dedup.steps(len(data), 20))
    windows = [w for lo, hi in slices for w in range(lo, hi - 19)]
    assert windows == list(range(481))


@pytest.fixture(scope="module")
def vocabulary():
    tokens = [bytes([i]) for i in range(256)] + [b"th", b"he", b"the", b" t", b"in", b"ing", b" the", b"an", b"and", b"th" b"an", b"aa", b"aaaa", b"nd"]
    return bpe.Vocabulary({t: i for i, t in enumerate(tokens)})


def merged(vocabulary, data):
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((vocabulary.ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(math.inf, 0))
        if best[0] == math.inf:
            return [vocabulary.ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_prefix_tables(vocabulary):
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"thean ding") for _ in range(rng.randrange(0, 30)))
        table = bpe.PrefixTable(vocabulary, data)
        assert table.tokens() == merged(vocabulary, data)
        more = bytes(rng.choice(b"thean") for _ in range(5))
        table.append(more)
        assert table.tokens() == merged(vocabulary, data + more)
        a = rng.randrange(0, len(table.data) + 1)
        b = rng.randrange(a, len(table.data) + 1)
        table.replace(a, b, b"ing")
        assert table.last == bpe.PrefixTable(vocabulary, table.data).last
        other = bytes(rng.choice(b"thean") for _ in range(9))
        assert table.become(other).tokens() == merged(vocabulary, other)


def test_round_trip_and_library(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.load(path).ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in ODD if r[0]} | {20: "a  b \n c d it's  <|endoftext|>", 21: " lead and trail ", 22: "x" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path, tokenizers.PATTERN), path).collect():
        assert list(r.token_ids) == enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    assert bpe.encode(odd(spark), path, tokenizers.PATTERN).count() == len(ODD)
    assert bpe.digests(odd(spark, empty=True), path, tokenizers.PATTERN).count() == 0


def test_token_files(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    t = lib.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [(30, "last one"), (3, None), (7, "a  b \n  c"), (5, ""), (12, "Hello, world's end " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokenfiles.write_token_files(df, f"file://{tmp_path}/t", path, 2, files=3)
    start = 0
    got = {r.doc_id: r for r in tokenfiles.read_token_files(manifest).collect()}
    for d, text in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        assert (got[d].start, got[d].n_tokens, zlib.crc32(bytes(got[d].token_bytes))) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    again = tokenfiles.read_token_files(tokenfiles.write_token_files(odd(spark), f"file://{tmp_path}/o", path, 2, files=2))
    assert again.count() == len(ODD) and again.where("doc_id is null").count() == 1
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(odd(spark, empty=True), f"file://{tmp_path}/e", path, 2)).count() == 0


def test_token_files_of_one_long_range(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokenfiles, "BATCH_CHARS", 300)
    path = tokenizers.path("byte_bpe_50k.json")
    df = spark.range(25000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 5).cast("int")).alias("text"))
    one = tokenfiles.read_token_files(tokenfiles.write_token_files(df, f"file://{tmp_path}/one", path, 2, files=1))
    many = tokenfiles.read_token_files(tokenfiles.write_token_files(df, f"file://{tmp_path}/many", path, 2, files=7))
    assert one.count() == 25000 and one.exceptAll(many).count() == 0
    assert {p.suffix for p in (tmp_path / "one").iterdir()} == {".bin", ".idx", ".doc", ".nul"} and len(list((tmp_path / "one").iterdir())) == 4


def test_token_files_with_special_tokens(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    t = lib.Tokenizer.from_file(path)
    texts = ["end of text <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n c <|endoftext|><|endoftext|> ", "plain one", "<|endoftext|> it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert want[0] == [437, 286, 2420, 220, 50256, 1306, 2]
    got = {r.doc_id: r for r in tokenfiles.read_token_files(tokenfiles.write_token_files(df, f"file://{tmp_path}/s", path, 2, files=2)).collect()}
    assert [np.frombuffer(got[i].token_bytes, dtype="<u4").tolist() for i in range(len(texts))] == want
    assert [got[i].start for i in range(len(texts))] == [sum(map(len, want[:i])) for i in range(len(texts))]


@pytest.mark.parametrize("marker", [{"content": "<|a b|>"}, {"content": "<|ab|>", "lstrip": True}])
def test_special_tokens_with_white_space(tmp_path, marker):
    tokenizers = pytest.importorskip("public_tokenizers")
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens([lib.AddedToken(marker["content"], lstrip=marker.get("lstrip", False))])
    t.save(f"{tmp_path}/own.json")
    text = f"one two {marker['content']} three"
    (got,) = tokenfiles.LibraryEncoder(f"{tmp_path}/own.json").many([text])
    assert np.frombuffer(got, dtype=np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids


def test_mixing_targets(spark):
    rng = random.Random(5)
    for k in range(3):
        sizes = {(None if i == 0 and k else f"s{i}"): rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(2 + 3 * k)}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight, total, capped = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}, sum(sizes.values()), {}
        while True:
            free = [n for n in names if n not in capped]
            share = {n: (total - sum(capped.values())) * weight[n] / sum(weight[m] for m in free) for n in free}
            over = [n for n in free if share[n] > 3 * sizes[n]]
            if not over:
                break
            capped |= {n: 3.0 * sizes[n] for n in over}
        want = share | capped
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(want)


def test_few_documents_meet_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([20, 40, 60, 100, 900]), f"s{i % 9}") for i in range(270)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.n - r.t) < 0.04 * r.t for r in per)


def test_mixing_copies(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t"), F.max("copies").alias("c")).collect()
    assert all(abs(r.n - r.t) < 0.05 * r.t and r.c <= 3 for r in per)
    first = {r.doc_id: r.copies for r in mixed.collect()}
    assert first == {r.doc_id: r.copies for r in mixing.mix(df.repartition(3)).collect()}
    assert mixing.emit(df).count() == sum(first.values())
    assert mixing.emit(odd(spark)).columns == odd(spark).columns and mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.emit(odd(spark, empty=True)).count() == 0


def test_quality_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "cc", "#d", "é"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))), "s") for i in range(60)] + [(r[0], r[1], r[2]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def measured(text):
        w = WORD.findall(text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)} if len(tri) < 500 else set(range(len(w)))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)

    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect())
    assert got == sorted(measured(t) for _, t, _ in rows)
    judged = quality.judge(odd(spark))
    assert judged.count() == len(ODD) and not judged.where(judged.columns[-1]).count()
    assert quality.judge(odd(spark, empty=True)).count() == 0


def test_bad_hosts_go_as_a_whole(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 10 else "short", "good") for i in range(200)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {1000 + i for i in range(200) if i % 10}


def test_secrets_by_brute_force(spark):
    key = "AKIA" + "Q" * 16
    texts = [f"x password: 'abcdefgh1234' y {key}", "TOKEN==abcdefghijk0 é api-key=1", "deadbeefdeadbeef00 token=passwd:abcdefghijklmnop", "Secret = short", None, "", "API_KEY:Zx9Qp2Lm8Rt4Vw6Yb1Nc", "ſecret=abcdefghijklmnop"]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")

    def base(text):
        found = []
        for kind, pattern, ok in (
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
            ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
        ):
            found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
        return ",".join(x[2] for x in sorted(found))

    found, name = secrets.scan(df)
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", F.sha2(secrets.listed(F.col(name), True).cast("binary"), 256), secrets.listed(F.col(name), False)).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == hashlib.sha256(base(t).encode()).hexdigest(), t
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert key not in clean[0] and clean[0].startswith("x [assign]") and clean[4] is None and clean[3] == "Secret = short"
    assert secrets.redact(odd(spark)).columns == odd(spark).columns and secrets.redact(odd(spark)).count() == len(ODD)
    assert secrets.redact(odd(spark, empty=True)).count() == 0


def test_secret_counts_follow_the_kinds(spark, tmp_path):
    access, hexes, assign = "AKIA" + "Q" * 14, "deadbeef" * 2, "token=ABCDEFGHIJKL"
    texts = {1: (f"{hexes} x {hexes} x {hexes}", 0, 0, 3), 2: (f"{access} {access} {assign}", 1, 2, 0), 3: (f"{assign} {access} {hexes}", 1, 1, 1), 4: (None, 0, 0, 0), 5: ("token=short", 0, 0, 0)}
    spark.createDataFrame([(i, t[0], "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in secrets.op7_secrets(spark, str(tmp_path)).collect()}
    assert got == {i: t[1:] for i, t in texts.items()}


def test_secrets_in_long_texts_and_beside_candidates():
    rng = random.Random(8)
    letters = "ABCxyz0189+/_=- ."
    for _ in range(300):
        text = "".join(rng.choice(letters) * rng.randrange(1, 3) if rng.random() < 0.9 else "token=abcdefghij12" for _ in range(200))
        found = secrets.find(text)
        base = [(a, b) for a, k, b, _ in found if k < 3]
        want = {(m.start(), m.end()) for m in secrets.CANDIDATE.finditer(text) if all(p.search(m[0]) for p in secrets.MIXED) and all(b <= m.start() or a >= m.end() for a, b in base) and secrets.entropy(m[0]) >= secrets.MIN_ENTROPY}
        assert {(a, b) for a, k, b, _ in found if k == 3} == want
    assert len(secrets.find("token=abcdefghijkl " * 20000)) == 20000


def test_redact_with_owned_and_copied_values(spark):
    own, copied = "Zx9Qp2Lm8Rt4Vw6Yb1NcKd", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows = [(i, f"see {copied} here", f"s{i}", 1, 2, 3) for i in range(5)] + [(9, f"see {own} and {copied}", "s9", 1, 2, 3), (9, f"see {own} and {copied}", "s9", 1, 2, 3), (10, None, None, None, 2, 3)]
    # names that helper columns have or had
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, _owner int, value int").withColumns({c: F.lit(1) for c in ("live", "_live", "_text_key", "owner", "_row", "spans")})
    got = secrets.redact(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.where("text is not null").collect()) == [(i, f"see {copied} here") for i in range(5)] + [(9, f"see [owned] and {copied}")] * 2
    assert secrets.scan(df)[0].count() == len(rows)
    assert {r.text for r in secrets.redact(df, max_repositories=1).where("doc_id = 9").collect()} == {f"see {own} and {copied}"}


CLASHING = ("row", "_owner", "_of", "_own", "_u", "_key", "_id", "_host", "_host_kept", "host_kept", "kept", "copies", "n", "step", "node", "component")


def test_clashing_names(spark):
    df = odd(spark).withColumns({c: F.lit(7) for c in CLASHING})
    for out in (secrets.redact(df), mixing.emit(df), ngram_join.one_of_each(df)):
        assert out.columns == df.columns and out.count() > 0
    assert mixing.mix(df).columns[: len(df.columns)] == df.columns
    judged = quality.judge(df)
    assert judged.count() == len(ODD) and set(df.columns) <= set(judged.columns) and judged.where("row <> 7 or host_kept <> 7").count() == 0


def test_only_owners_own_values_are_added(spark):
    own, copied = "Zx9Qp2Lm8Rt4Vw6Yb1NcKd", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows = [(i, f"see {copied} here", f"s{i}") for i in range(5)] + [(9, f"see {own} and {copied}", "s9")]
    found, name = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    spans = {r.doc_id: r[1] for r in found.select("doc_id", secrets.listed(F.col(name), False).alias("s")).collect()}
    assert spans == {**{i: "" for i in range(5)}, 9: f"owned:4:{4 + len(own)}"}


def test_top_k_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25]) for _ in range(4)]) for i in range(150)] + [(200, None), (250, [float("nan")] * 4), (300, [None, 1.0, 1.0, 1.0]), (350, [1e17, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clean = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, group=2, shard=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hold = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    for q in (i for i in clean if i % 50 == 0):
        want = sorted(((hold(sum(a * b for a, b in zip(clean[q], v, strict=True))), i) for i, v in clean.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(i, s) for s, i in want]
    assert set(got) == {i for i in clean if i % 50 == 0}
    assert topk.top_k(df.where("false"), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_repeated_ids_and_unequal_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [9.0, 9.0, 9.0]), (50, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"d": F.lit(1), "shard": F.lit(2)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 2 * 65536), (0, 2, 2, 65536), (50, 1, 3, 27 * 65536)]


def test_code_lengths_by_brute_force(spark):
    rows = [("x", "abracadabra abra"), ("y", "hocus pocus fidibus"), ("y", "é ü")]
    counts = language.gram_counts(spark.createDataFrame(rows, "lang string, text string").repartition(1), 2).toPandas()
    trees = language.ContextTrees(counts, 2)

    def by_hand(lang, data):
        of = counts[counts["lang"] == lang]
        bits, data = 0.0, b"  " + data
        for i in range(2, len(data)):
            for order in (2, 1, 0, -1):
                if order < 0:
                    bits += 8
                    break
                ctx = int.from_bytes(data[i - order : i], "big")
                inside = of[(of["size"] == order + 1) & (of["gram"] // 256 == ctx)]
                total, kinds = inside["n"].sum(), len(inside)
                hit = inside[inside["gram"] % 256 == data[i]]["n"]
                if len(hit):
                    bits -= math.log2(hit.iloc[0] / (total + kinds))
                    break
                if total:
                    bits -= math.log2(kinds / (total + kinds))
        return bits

    texts = [b"abra pocus", b"z", b"hocus \xc3\xa9"]
    assert trees.code_lengths(texts) == pytest.approx(np.array([[by_hand(lang, t) for lang in trees.langs] for t in texts]))


def test_long_texts_are_scored_in_steps(spark, monkeypatch):
    rows = [("x", "abracadabra abra"), ("y", "hocus pocus fidibus")]
    trees = language.ContextTrees(language.gram_counts(spark.createDataFrame(rows, "lang string, text string"), 2).toPandas(), 2)
    texts = [b"abra pocus " * 40, b"z", b"hocus" * 30]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr(language, "CHUNK", 64)
    assert trees.code_lengths(texts) == pytest.approx(whole)


def test_numbers_are_no_letters(spark):
    df = spark.createDataFrame([(1, "½ ² 12 _ ①"), (2, "ª"), (3, "字")], "doc_id long, text string")
    trees = language.train(spark.createDataFrame([(9, "abra cadabra", "x")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.predict(df, trees).collect()} == {1: "und", 2: "x", 3: "x"}


def test_language_edges(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") > 3, "x"))
    trees = language.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, trees).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "x"), (None, "x")} <= got
    assert language.train(docs.where("false")) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


PAGE = "<html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies, lots.</div>%s<aside>More, more.</aside><section id='comments'><p>Great, just great.</p></section><footer>&copy; 2024, all rights.</footer></body>"


def test_html():
    article = "<article><h1>Head &amp; tail</h1><p>One   two,\nthree.<br>Four <b>fi</b>ve.</p><ul><li>six<li>seven</ul><form>no</form></article>"
    assert html.main_text(PAGE % article) == "Head & tail One two, three. Four five. six seven"
    assert html.main_text(PAGE % "<div id='content'><h2>Head</h2><p>One two, three four five.</p><p>Six.</p></div>") == "Head One two, three four five. Six."
    assert html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<p> </p>") == ""
    assert html.main_text("<article><p><b>open<br><p>second, too") == "open second, too"


WRAPPERS = ["<form id=aspnetForm>%s</form>", "<div class='container with-sidebar'>%s</div>", "<div class='has-menu'><section id=legal>%s</section></div>", "<section class='no-sidebar'>%s</section>", "<div role=form><dialog open>%s</dialog></div>", "<div class='post comments-open share'>%s</div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_keep_the_article(wrapper):
    inner = "<div class=sidebar>Side, side.</div><div class='ad'>Buy, buy, buy, it is the longest, of all. Buy, buy, and buy more.</div><nav><a href=x>Home</a></nav>%s<div class=share>Share, now.</div>"
    for tag in ("article", "main", "div"):
        page = wrapper % (inner % f"<{tag}><h1>Head</h1><p>One two, three four five.</p><p>Six, seven eight nine ten.</p></{tag}>")
        assert html.main_text(PAGE % page) == "Head One two, three four five. Six, seven eight nine ten."
    posts = "".join(f"<div class='post has-share'><p>Post {i}, some words.</p></div>" for i in range(4))
    assert html.main_text(PAGE % posts) == " ".join(f"Post {i}, some words." for i in range(4))
    assert html.main_text(PAGE % "<article><p>Short, it is.</p></article><div class='promo'>Long, long, long, a very long one. And more.</div>") == "Short, it is."


LONG = "Long words, and more of them. "
PARTS = "".join(f"<p>Part {i}, some words more.</p>" for i in range(8))


@pytest.mark.parametrize(
    "body",
    [
        f"<div id=content><h1>Head</h1><p>The lead, it is.</p><div class=body>{LONG * 350}</div></div>",
        f"<div id=content><h1>Head</h1><p>The lead, it is.</p><div class=body><p>{LONG * 200}</p><p>{LONG * 150}</p></div></div>",
        f"<div class=page><h1>Head</h1><p class=lead>The lead, it is.</p><article><p>{LONG * 60}</p></article></div>",
        f"<main><h1>Head</h1><p>The lead, it is.</p><article><p>{LONG * 6}</p></article><p>{LONG * 4}</p></main>",
        f"<article><h1>Head</h1><p>{LONG * 6}</p></article><article><p>{LONG * 4}</p></article>",
        *[f"<div id=content><h1>Head</h1>{PARTS}<{k}>{LONG * 400}</{k}>{PARTS}</div>" for k in ("pre", "section", "blockquote")],
        f"<h1>Head</h1>{PARTS}<table><tr><td>{LONG * 400}</td></tr></table>{PARTS}",
        f"<h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div>",
    ],
)
def test_html_keeps_all_main_text(body):
    assert html.main_text(PAGE % body) == " ".join(re.sub("<[^>]*>", " ", body).split())


def test_html_root_leaves_the_rest_out():
    assert html.main_text(PAGE % f"<div><p>We are a site, hello.</p></div><main><p>{LONG}</p><article><p>One, two.</p></article></main>") == f"{LONG}One, two."
    links = "".join(f"<a href=x>page {i} of the site</a> " for i in range(20))
    assert html.main_text(PAGE % f"<form>Search here, now.</form><div>{links}</div>").startswith("page 0 of the site")


def by_hand(nodes):
    """Path scores with a loop for each sum."""
    ratio = {}
    for path in {n.path for n in nodes}:
        own = [n for n in nodes if n.path == path]
        marks = sum(len(html.PUNCTUATION.findall(n.text)) for n in own if not n.linked)
        ratio[path] = min(sum(len(n.text.strip()) for n in own if not n.linked) / len(own), html.LONG), min(marks / len(own), html.MARKED)
    fused = []
    for i, n in enumerate(nodes):
        near = [(math.exp(-0.5 * (i - j) ** 2), ratio[nodes[j].path]) for j in range(max(0, i - 2), min(len(nodes), i + 3))]
        length, marks = (sum(w * r[k] for w, r in near) / sum(w for w, _ in near) for k in (0, 1))
        fused.append(math.sqrt(length * (1 + marks)) * n.penalty)
    held = {p: sum(len(n.text.strip()) for n in nodes if n.path == p and not n.linked) for p in ratio}
    rest = sum(len(n.text.strip()) for n in nodes if n.penalty == 1 and not n.linked)
    share = lambda n: held[n.path] / (held[n.path] + html.LONG) * (min(1, held[n.path] / rest) if n.penalty < 1 else 1)
    return [share(n) * sum(f for f, m in zip(fused, nodes, strict=True) if m.path == n.path) / sum(m.path == n.path for m in nodes) for n in nodes]


def plain_page(rng):
    """A page of <div>s without names, and its main text: paragraphs between short lines and menus."""
    sentence = lambda n: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n)) + ", and more."
    short = lambda tag: f"<div><{tag}>" + f"</{tag}><{tag}>".join(rng.choice(["Home", "Log in", "Next", "All news"]) for _ in range(rng.randrange(4, 9))) + f"</{tag}></div>"
    body = [sentence(rng.randrange(20, 60)) for _ in range(rng.randrange(4, 12))]
    page = short("span") + short("i") + "<div><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div></div>" + short("i") + short("span")
    return f"<html><body>{page}</body></html>", " ".join(body)


def test_html_paths_choose_the_text(monkeypatch):
    rng = random.Random(10)
    pages = [plain_page(rng) for _ in range(40)]
    for page, want in pages:
        nodes = [n for n in html.Page().read(page).nodes if n.size]
        assert html.path_scores(nodes).tolist() == pytest.approx(by_hand(nodes))
        lowered = {n.path for n in nodes[:5]}
        nodes = [n._replace(penalty=0.35) if n.path in lowered else n for n in nodes]
        assert html.path_scores(nodes).tolist() == pytest.approx(by_hand(nodes))
        assert html.main_text(page) == want
    # no node has a penalty here, so these are constant ratios
    monkeypatch.setattr(html, "path_scores", lambda nodes: np.ones(len(nodes)))
    assert all(html.main_text(page) != want for page, want in pages)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_html_of_the_tables(monkeypatch):
    import html as standard

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()

    def inner(page):
        text = re.sub("<br>", " ", re.search("<article>(.*)</article>", page, re.DOTALL)[1])
        text = re.sub(r'<div class="ad">.*?</div>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<form.*?</form>|<aside.*?</aside>', "", text, flags=re.DOTALL)
        return " ".join(standard.unescape(re.sub("<[^>]*>", " ", text)).split())

    found = [html.main_text(p) for p in pages]
    same = lambda a, b: a.replace(" ", "") == b.replace(" ", "")
    assert all(same(a, inner(p)) for a, p in zip(found, pages, strict=True))
    # the article's tag isn't needed for this
    assert [html.main_text(re.sub(r"(</?)article", r"\1div", p)) for p in pages] == found

    # nor are names: without them one page in eight at most is another
    bare = [re.sub(r' (class|id|role)="[^"]*"', "", p) for p in pages]
    assert sum(html.main_text(p) != f for p, f in zip(bare, found, strict=True)) <= len(pages) / 8

    # tags and names kept, most pages are others with ratios that say nothing
    rng = np.random.default_rng(10)

    def drawn(nodes):
        _, at = np.unique([n.path for n in nodes], return_inverse=True)
        return rng.uniform(0.2, 1.2, at.max() + 1)[at]

    for ratios in (lambda nodes: np.ones(len(nodes)), drawn):
        monkeypatch.setattr(html, "path_ratios", ratios)
        assert sum(html.main_text(p) != f for p, f in zip(pages, found, strict=True)) > len(pages) / 2


def test_html_names_only_lower_scores():
    # a named element is content where it holds as much as the rest, not where it holds less
    text = "<p>One two three, four five six. Seven eight, nine ten eleven twelve.</p>"
    body = f"<div>{text * 12}</div><div class=promo>%s</div>"
    read = lambda part: " ".join(re.sub("<[^>]*>", " ", part).split())
    assert html.main_text(PAGE % (body % (text * 3))) == read(text * 12)
    assert html.main_text(PAGE % (body % (text * 11).replace("One", "Uno"))).startswith(read(text * 12) + " Uno")
    # comments are prose too, so there names decide
    assert html.main_text(PAGE % (f"<div>{text * 12}</div><div class=comments>{text * 20}</div>")) == read(text * 12)


@pytest.mark.parametrize(
    ("page", "text"),
    [("<![foo[bar]]><p>a</p>", "a"), ("<p>a</p><!doctype x", "a"), ("<p>a</p><!-- x", "a"), ("<p>a &am", "a &am"), ("<p>a</p><p class='x", "a"), ("a < b", "a < b"), ("<p>a<script>x", "a"), ("<!>a", "a"), ("a<![CDATA[x]]>b", "ab"), ("<!-->a<!--->b", "ab"), ("</p>a</b>", "a")],
)
def test_html_malformed(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("part", ["<b>x, ", "<div>x, ", "<i></b>x", "<i><hr>x"])
def test_html_deep_pages_take_linear_time(part):
    start = time.process_time()
    assert html.main_text("<p>" + part * 30000).count("x") == 30000
    assert time.process_time() - start < 15


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.extract(df).collect()) == ["", "", "a"]
    assert html.extract(df.where("false")).count() == 0


def test_join_and_repeats_take_odd_rows(spark):
    assert ngram_join.jaccard_components(odd(spark)).count() == len(ODD)
    left = ngram_join.one_of_each(odd(spark))
    assert left.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 7]
    assert suffix_dedup.dedup(odd(spark)).count() == len(ODD)
    assert ngram_join.one_of_each(odd(spark, empty=True)).count() == 0 and suffix_dedup.dedup(odd(spark, empty=True)).count() == 0


def test_kept_columns_may_have_names_of_the_operators(spark):
    own = ("doc_id", "_doc", "_data", "_ranges", "n_bytes", "spans", "kept", "text", "_html", "lang_pred", "score", "_text", "token_ids")
    df = odd(spark).select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(own) if c not in ("doc_id", "text")])
    values = {c: k for k, c in enumerate(own)}

    def holds(got, *new):
        assert got.columns == [*own, *new] and got.count() == len(ODD)
        assert all(r[c] == values[c] for r in got.collect() for c in own if c not in ("doc_id", "text"))

    holds(suffix_dedup.dedup(df, keep=own), "_n_bytes", "_spans", "_kept")
    got = html.extract(df.withColumn("html", F.col("text")), keep=own)
    assert len(set(got.columns)) == len(own) + 1 and got.count() == len(ODD)
    got = language.predict(df, None, keep=own)
    assert len(set(got.columns)) == len(own) + 2 and got.count() == len(ODD)
    tokenizers = pytest.importorskip("public_tokenizers")
    got = bpe.encode(df, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep=own)
    assert got.columns == [*own, "_token_ids"] and got.count() == len(ODD)


def test_grid_of_queries_and_candidates():
    for n, asked, tasks in ((0, 0, 8), (500, 10, 8), (10**6, 10**6, 8), (10**9, 2 * 10**7, 1000), (5, 10**7, 3)):
        groups, shards = topk.grid(n, asked, tasks, topk.GROUP, topk.SHARD)
        assert groups * topk.GROUP >= asked and shards * topk.SHARD >= n and groups * shards >= tasks
    groups, shards = topk.grid(10**9, 2 * 10**7, 1000, topk.GROUP, topk.SHARD)
    assert groups <= 40 and shards <= 1000


def test_mix_without_texts_is_the_same(spark):
    df = odd(spark)
    got = sorted(((r.doc_id, r["size"], r.copies) for r in mixing.plan(df).collect()), key=str)
    whole = mixing.mix(df)
    assert got == sorted(((r.doc_id, r[whole.columns[-4]], r[whole.columns[-1]]) for r in whole.collect()), key=str)
