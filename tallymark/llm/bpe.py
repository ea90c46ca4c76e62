"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string there is one token that its BPE encoding ends with. The table of
these last tokens is filled from left to right: among the vocabulary's tokens that end at a position,
the valid one is that which the merges leave standing beside the last token of the prefix before it.
Following the table back from any position gives that prefix's encoding. Appended bytes therefore only
add entries, and after an edit only the entries near it change.

Defined results: a null or empty text has no tokens and decodes to no bytes; very long pieces cost
time in proportion to their length; ids, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, table
from .words import SPACE, pieces

#: Pieces whose encodings a Python worker remembers.
REMEMBERED = 600_000
#: Characters encoded at once.
BATCH_CHARS = 1_500_000
#: Tokens decoded at once.
JOINED = 1 << 18


class Vocabulary:
    """Tokens by rank, the pair that each was merged from, and which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.size.values(), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        #: Each string that some token ends with: its rank, or -1 where it is no token itself.
        self.tails: dict[bytes, int] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            for cut in range(len(token)):
                self.tails.setdefault(token[cut:], ranks.get(token[cut:], -1))
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and self._stay_apart(left, right):
                    self.halves[rank], self.merged[left, right] = (left, right), rank
                    break

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in these two.

        Undo merges on both sides of the seam, latest first. Where the two tokens at the seam could have been merged
        before the merge undone last, they would have been, and the seam would be gone. Of equal tokens the left one is
        merged first, so the right one is undone first.
        """
        before = float("inf")
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            sides = [(token, side) for token, side in ((left, 0), (right, 1)) if token in self.halves]
            if not sides:
                return True
            token, side = max(sides)
            if side:
                before, right = token + 0.5, self.halves[token][0]
            else:
                before, left = token, self.halves[token][1]

    def stay_apart(self, left: int, right: int) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[left, right] = self._stay_apart(left, right)
        return known


class PrefixTable:
    """The last token of each prefix of a byte string, which may be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def become(self, data: bytes) -> PrefixTable:
        """Turn into the table of `data`, keeping the entries of the prefix that both have in common."""
        common = 0
        for old, new in zip(self.data, data, strict=False):
            if old != new:
                break
            common += 1
        del self.last[common + 1 :]
        self.data = data
        self._fill(len(data))
        return self

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def _fill(self, stop: int) -> None:
        """Add the entries of the prefixes up to `stop` bytes: of the tokens that end there, the one that stays apart from the token before it.

        Only one does, so the search may go from short to long, and end where no token ends with these bytes.
        """
        data, last = self.data, self.last
        tail, apart, learn = self.vocabulary.tails.get, self.vocabulary.apart.get, self.vocabulary.stay_apart
        for end in range(len(last), stop + 1):
            for start in range(end - 1, -1, -1):
                token = tail(data[start:end])
                if token is None:
                    raise ValueError(f"no token for the bytes before {end}")
                if token >= 0:
                    if not start:
                        break
                    before = last[start]
                    fits = apart((before, token))
                    if learn(before, token) if fits is None else fits:
                        break
            last.append(token)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put `new` in place of bytes start..stop; gives how many entries were worked out anew.

        Entries before `start` stand. Behind the edit an entry depends on the bytes of the longest token and the
        entries there, so once as many entries as that token has bytes agree with the old ones, all later ones do.
        """
        tail = self.last[stop + 1 :]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1 :]
        agreed, done, shift = 0, 0, start + len(new)
        while len(self.last) <= len(self.data):
            end = len(self.last)
            self._fill(end)
            done += 1
            if end > shift:
                agreed = agreed + 1 if tail[end - shift - 1] == self.last[end] else 0
                if agreed >= self.vocabulary.longest and end - shift >= self.vocabulary.longest:
                    self.last += tail[end - shift :]
                    break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes."""
        found, at = [], len(self.data) if end is None else end
        while at:
            found.append(self.last[at])
            at -= self.vocabulary.size[self.last[at]]
        found.reverse()
        return found


class Encoder:
    """Texts to ids: pre-tokens by a pattern, each encoded by a prefix table."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        # \s and \S by their Unicode meaning, which libraries differ in
        inside = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
        self.find = regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.known: dict[str, bytes] = {}  # ids of pre-tokens
        self.after_space: dict[str, bytes] = {}  # ids of pieces that follow a space

    def _learn(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. In their order neighbours begin alike, and one table goes from each to the next."""
        table_, ranks, out = PrefixTable(self.vocabulary), self.vocabulary.ranks, {}
        for data, text in sorted((t.encode("utf-8"), t) for t in pre_tokens):
            rank = ranks.get(data)
            out[text] = array("i", (rank,) if rank is not None else table_.become(data).tokens()).tobytes()
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        for memory in (self.known, self.after_space):
            if len(memory) > REMEMBERED:
                memory.clear()
        cut = [pieces(t) if t else [""] for t in texts]
        known, after = self.known, self.after_space
        new = {p: self.find(" " + p) for parts in cut for p in parts[1:] if p not in after}
        first = [self.find(parts[0]) for parts in cut]
        once = self._learn({t for found in (*new.values(), *first) for t in found if t not in known})
        known.update((t, ids) for t, ids in once.items() if len(t) < 64)
        of = lambda t: known.get(t) or once[t]
        made = {p: b"".join(map(of, found)) for p, found in new.items()}
        after.update(made)
        out = [b"".join((*map(of, found), *map(after.__getitem__, parts[1:]))) for found, parts in zip(first, cut, strict=True)]
        for p in made:
            if len(p) >= 64:
                del after[p]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def in_batches(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts in order, some million characters at a time."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield held


_LOADED: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = Encoder(Vocabulary.load(ranks_path), pattern)
    return _LOADED[ranks_path, pattern]


def _encoding(ranks_path: str, pattern: str, at: int, ids_col: str):
    """Batches with their texts, in column `at`, as token ids instead."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern).encode_many
        for batch in slices(batches):
            ids = [x for some in in_batches(batch.column(at).to_pylist()) for x in enc(some)]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(pa.array(ends), values)], [*batch.schema.names[:at], ids_col])

    return work


def _decoding(ranks_path: str, at: int, bytes_col: str):
    """Batches with the bytes of the ids in column `at` beside their own columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_bytes(ranks_path)
        for batch in slices(batches):
            lists = batch.column(at)
            ids = lists.flatten().to_numpy()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            data, ends = tokens.join(ids)
            doc_ends = ends[offsets]
            binary = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(doc_ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, binary.cast(pa.binary())], [*batch.schema.names, bytes_col])

    return work


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "token_ids") -> DataFrame:
    """The columns `keep` and the texts' token ids (array<int>), which take another name where that clashes."""
    ids_col = fresh(docs.select(*keep), ids_col)
    schema = docs.select(*keep, F.array(F.lit(0)).alias(ids_col)).schema
    return docs.select(*keep, text_col).mapInArrow(lean(_encoding(ranks_path, pattern, len(keep), ids_col)), schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids."""
    work = _decoding(ranks_path, encoded.columns.index(ids_col), bytes_col)
    return encoded.mapInArrow(lean(work), encoded.select("*", F.lit(b"").alias(bytes_col)).schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """The columns `keep`, the texts' ids, and the bytes that the ids decode to, by one Python worker for each task."""
    there, back = _encoding(ranks_path, pattern, len(keep), ids_col), _decoding(ranks_path, len(keep), bytes_col)
    schema = docs.select(*keep, F.array(F.lit(0)).alias(ids_col), F.lit(b"").alias(bytes_col)).schema
    return docs.select(*keep, text_col).mapInArrow(lean(lambda batches: back(there(batches))), schema)


class _Blob:
    """All tokens' bytes in one array, to join many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.blob = np.frombuffer(b"".join(by_rank), dtype=np.uint8)
        self.size = np.array([len(x) for x in by_rank], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each token's bytes end (with a leading 0)."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        out = np.empty(ends[-1], dtype=np.uint8)
        for lo in range(0, len(ids), JOINED):
            some = ids[lo : lo + JOINED]
            begin, stop = ends[lo : lo + len(some)], ends[lo + len(some)]
            out[begin[0] : stop] = self.blob[np.arange(begin[0], stop) + np.repeat(self.start[some] - begin, self.size[some])]
        return out, ends


_BLOBS: dict[str, _Blob] = {}


def vocabulary_bytes(ranks_path: str) -> _Blob:
    if ranks_path not in _BLOBS:
        with open(ranks_path, "rb") as lines:
            _BLOBS[ranks_path] = _Blob({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})
    return _BLOBS[ranks_path]


def digests(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encoded and decoded documents as counts and SHA-256 digests."""
    done = round_trip(docs, ranks_path, pattern, keep=keep)
    return done.select(
        *keep,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
