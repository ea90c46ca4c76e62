"""Token-id files: flat unsigned integers with 64-bit document offsets.

Documents are sorted into ranges of ids, as many as the texts' bytes ask for. Each task encodes its range batch by batch into
open drafts (tokens, offsets, document ids, nulls), so it holds one batch whatever the range's size, and renames them at
the end: a task that runs twice leaves the same files. One row per file forms the manifest, whose prefix sums give
each file's base. Readers map the token file into memory and find a document by its offsets.

Layout of part NNNNN: `.bin` little-endian ids, 16 bits while the vocabulary allows it and 32 otherwise;
`.idx` n + 1 little-endian 64-bit offsets in tokens; `.doc` n little-endian 64-bit document ids; `.nul` n bytes, 1 for a null id.

Defined results: a null or empty text is the end id alone; null ids come first; rows that repeat an id keep
all their copies, ordered by their text's hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, new_path, table, width
from .words import SPACE, pieces

_WHITE = re.compile(f"[{SPACE}]")
REMEMBERED = 1_000_000
#: Pieces sent to the library as one text.
JOINED = 512
#: Encoded at once, in characters.
BATCH_CHARS = 4_000_000
#: Bytes of text for each set of files, about.
FILE_BYTES = 256 << 20
#: Documents read at once.
READ = 2000


class LibraryEncoder:
    """Ids by the tokenizers library. Where its pre-tokenizer is the plain byte-level one, texts are cut at
    spaces, and each different piece is sent to the library once. Special tokens in a text, such as <|endoftext|>, get
    their own ids, as the library does by default."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        # an added token that holds or takes white space goes across cuts
        across = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens") or [])
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer") and not across
        special = [re.escape(t["content"]) for t in made.get("added_tokens") or [] if t["special"]]
        self.special = re.compile("|".join(special)) if special else None
        self.known: dict[str, bytes] = {}
        # tokens that begin with a space, which is Ġ in byte-level vocabularies
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, dtype=bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        marked = [i for i, t in enumerate(texts) if self.special and self.special.search(t)]
        if not marked:
            return self._plain(texts)
        # texts that hold a special token go to the library whole
        held = set(marked)
        others = iter(self._plain([t for i, t in enumerate(texts) if i not in held]))
        whole = iter(self.tokenizer.encode_batch_fast([texts[i] for i in marked], add_special_tokens=False))
        return [np.array(next(whole).ids, dtype=np.uint32).tobytes() if i in held else next(others) for i in range(len(texts))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, which needn't be looked for in each piece."""
        self.tokenizer.encode_special_tokens = True
        try:
            return self._pieces(texts)
        finally:
            self.tokenizer.encode_special_tokens = False

    def _pieces(self, texts: list[str]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        self._learn(list({p for parts in split for p in parts[1:] if p not in known}))
        firsts = self.tokenizer.encode_batch_fast([parts[0] for parts in split], add_special_tokens=False)
        get = known.__getitem__
        return [np.array(e.ids, dtype=np.uint32).tobytes() + b"".join(map(get, parts[1:])) for e, parts in zip(firsts, split, strict=True)]

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces that follow a space. Many without white space go to the library as one text; each begins at a token that begins with a space."""
        alone = [p for p in new if _WHITE.search(p)]
        joined = [p for p in new if not _WHITE.search(p)]
        groups = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            starts = np.nonzero(self.opens[ids])[0]
            if len(starts) != len(group):
                alone += group
                continue
            data, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.known.update((p, data[a:b]) for p, a, b in zip(group, at, at[1:], strict=False))
        for piece, e in zip(alone, self.tokenizer.encode_batch_fast([" " + p for p in alone], add_special_tokens=False), strict=True):
            self.known[piece] = np.array(e.ids, dtype=np.uint32).tobytes()


_LOADED: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def _store(path: str):
    """The file system of a folder's URI and the path within it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


class _Part:
    """The files of a range while they are written: drafts until `done` gives them their names."""

    def __init__(self, path: str):
        self.store, self.name = _store(path)
        self.store.create_dir(os.path.dirname(self.name), recursive=True)
        self.draft = f"{self.name}.{uuid.uuid4().hex}"
        self.open = {kind: self.store.open_output_stream(f"{self.draft}.{kind}") for kind in ("bin", "idx", "doc", "nul")}

    def write(self, kind: str, numbers: np.ndarray, dtype: str) -> None:
        self.open[kind].write(np.ascontiguousarray(numbers, dtype=dtype).tobytes())

    def done(self) -> None:
        for kind, out in self.open.items():
            out.close()
            self.store.move(f"{self.draft}.{kind}", f"{self.name}.{kind}")


class _Numbers:
    """A file's numbers by ranges, mapped into memory where the store is local."""

    def __init__(self, path: str, dtype: str):
        store, name = _store(path)
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(name).size // self.dtype.itemsize
        self.local = np.memmap(name, dtype=dtype, mode="r") if self.size and urlparse(path).scheme in ("", "file") else None
        self.file = store.open_input_file(name) if self.local is None else None

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.local is not None:
            return self.local[at]
        lo, hi, _ = at.indices(self.size)
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), dtype=self.dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; gives the manifest (part, n_docs, n_tokens, bits, base, path) in order of ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    if files is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(width(docs.sparkSession), -(-size // FILE_BYTES))
    ranges = rows.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie", "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        enc = library_encoder(tokenizer_path)
        dtype = "<u2" if max(enc.size - 1, end_id) < 2**16 else "<u4"
        end = np.array([end_id], dtype="<u4").tobytes()
        part, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if len(batch) and part is None:
                part = _Part(path)
                part.write("idx", np.zeros(1), "<i8")
            texts = batch["text"].fillna("").tolist()
            places = np.cumsum([len(t) for t in texts]) // BATCH_CHARS
            for k in np.unique(places):
                lo, hi = np.searchsorted(places, [k, k + 1])
                coded = enc.many(texts[lo:hi])
                ends = n_tokens + np.cumsum([len(x) // 4 + 1 for x in coded])
                part.write("bin", np.frombuffer(b"".join(x + end for x in coded), dtype="<u4"), dtype)
                part.write("idx", ends, "<i8")
                n_docs, n_tokens = n_docs + len(coded), int(ends[-1])
            if len(batch):
                part.write("doc", batch["id"].fillna(0).to_numpy(), "<i8")
                part.write("nul", batch["id"].isna().to_numpy(), "u1")
        if part:
            part.done()
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n_docs": [n_docs], "n_tokens": [n_tokens], "bits": [16 if dtype == "<u2" else 32], "path": [path]})

    made = cut(ranges.mapInPandas(lean(work), "part int, n_docs long, n_tokens long, bits int, path string"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, token_bytes) of each document; start counts from the first file, token_bytes are 32-bit ids."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                tokens, index, ids, null = _Numbers(f"{row.path}.bin", f"<u{row.bits // 8}"), _Numbers(f"{row.path}.idx", "<i8"), _Numbers(f"{row.path}.doc", "<i8"), _Numbers(f"{row.path}.nul", "u1")
                for at in range(0, row.n_docs, READ):
                    ends = index[at : at + READ + 1]
                    some = tokens[ends[0] : ends[-1]]
                    yield pd.DataFrame({
                        "doc_id": pd.Series(ids[at : at + READ], dtype="Int64").mask(null[at : at + READ] == 1),
                        "start": row.base + ends[:-1], "n_tokens": np.diff(ends),
                        "token_bytes": [some[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)],
                    })

    spread = manifest.repartition(width(manifest.sparkSession), "part")
    return spread.mapInPandas(work, "doc_id long, start long, n_tokens long, token_bytes binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("token_bytes").alias("ids_crc32"))
