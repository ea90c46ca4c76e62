"""Page matrices: dense gray or binary images, in columns and in files.

A file is three little-endian 32-bit integers (rows, columns, type) and the pixels as one LZ4 frame. In tables a matrix
is a struct with its pixels as one binary value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.guard import PageError
from ..schemas import MATRIX, with_fields

GRAY = 0
_HEAD = struct.Struct("<iii")


def encode(pixels: np.ndarray) -> bytes:
    flat = np.ascontiguousarray(pixels, dtype=np.uint8)
    return _HEAD.pack(*flat.shape, GRAY) + pa.compress(flat.tobytes(), codec="lz4", asbytes=True)


def decode(data: bytes) -> np.ndarray:
    """The matrix of a file's bytes; ValueError where they aren't one."""
    if len(data) < _HEAD.size:
        raise ValueError("a matrix file has a header of 12 bytes")
    rows, cols, kind = _HEAD.unpack_from(data)
    if kind != GRAY or rows < 0 or cols < 0:
        raise ValueError(f"unknown matrix: {rows} x {cols}, type {kind}")
    try:
        pixels = pa.decompress(data[_HEAD.size :], decompressed_size=rows * cols, codec="lz4", asbytes=True) if rows * cols else b""
    except OSError as e:
        raise ValueError(str(e)) from e
    return np.frombuffer(pixels, dtype=np.uint8).reshape(rows, cols)


# The signature of PNG files, and how many samples a pixel has in each of their color types
_PNG, _SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an encoded image at most; more is an error, before they are unpacked.
MOST_PIXELS = 1 << 28


def decode_image(data: bytes) -> np.ndarray:
    """Gray levels of an encoded image: PNG with 8 or 16 bits and without interlacing, or a matrix file; ValueError for others."""
    if not data.startswith(_PNG):
        return decode(data)
    chunks: dict[bytes, bytes] = {}
    at = len(_PNG)
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += size + 12
    if len(chunks.get(b"IHDR", b"")) != 13:
        raise ValueError("a PNG file has one header")
    width, height, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if bits not in (8, 16) or color not in _SAMPLES or interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"can't read this kind of PNG: {width} x {height}, {bits} bits, color type {color}, interlacing {interlaced}")
    step = _SAMPLES[color] * bits // 8
    length = width * step
    try:
        raw = zlib.decompressobj().decompress(chunks.get(b"IDAT", b""), height * (length + 1))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) < height * (length + 1):
        raise ValueError("the image ends early")
    rows = _unfiltered(np.frombuffer(raw, dtype=np.uint8).reshape(height, length + 1), step)
    samples = rows.reshape(height, width, -1, bits // 8)[..., 0]
    if color == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), dtype=np.uint8)
        palette = palette[: len(palette) // 3 * 3].reshape(-1, 3)
        if samples.max() >= len(palette):
            raise ValueError("a color is not in the palette")
        samples = palette[samples[..., 0]]
    return gray_levels(samples) if samples.shape[2] >= 3 else np.ascontiguousarray(samples[..., 0])


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes as they were before each became its difference from neighbours, by the rule that its first byte names."""
    out = np.zeros((len(rows), rows.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.uint8)
    for y, row in enumerate(rows):
        rule, line = row[0], row[1:].copy()
        if rule == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif rule == 2:
            line += above
        elif rule in (3, 4):
            near, over = [0] * step, [0] * step + above.tolist()
            for x, value in enumerate(line.tolist()):
                left, up, corner = near[x], over[x + step], over[x]
                if rule == 3:
                    guess = (left + up) // 2
                else:  # the neighbour nearest to left + up - corner, in this order
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                near.append((value + guess) % 256)
            line = np.array(near[step:], dtype=np.uint8)
        elif rule:
            raise ValueError(f"unknown row filter {rule}")
        out[y] = above = line
    return out


def gray_levels(rgb: np.ndarray) -> np.ndarray:
    """Gray of channels red, green and blue in 8 bits, widened to 16 as the luma of scalars takes them."""
    wide = rgb[..., :3].astype(np.uint64) * np.uint64(257)
    return ((19595 * wide[..., 0] + 38470 * wide[..., 1] + 7471 * wide[..., 2] + 32768) >> np.uint64(24)).astype(np.uint8)


def to_row(pixels: np.ndarray) -> dict:
    return {"rows": pixels.shape[0], "cols": pixels.shape[1], "type": GRAY, "data": np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()}


def from_row(row) -> np.ndarray | None:
    """Pixels of a matrix column's value (dict or Row); None for null or empty ones, PageError where the bytes aren't as many as rows and columns."""
    if row is None or row["data"] is None:
        return None
    # beside a null matrix pandas holds numbers as floats
    rows, cols = (0 if n is None or n != n else int(n) for n in (row["rows"], row["cols"]))
    if not rows or not cols:
        return None
    if rows < 0 or cols < 0 or len(row["data"]) != rows * cols:
        raise PageError(f"{len(row['data'])} bytes are no {rows} x {cols} matrix")
    return np.frombuffer(row["data"], dtype=np.uint8).reshape(rows, cols)


#: So many bytes of pixels leave a Python worker at once: Spark bounds the batches that it sends there, and not those that come back.
PORTION_BYTES = 4 << 20


def _pixel_bytes(value: Any) -> int:
    if isinstance(value, dict):
        return len(value.get("data") or b"")
    return sum(map(_pixel_bytes, value)) if isinstance(value, list | tuple) else 0


def portions(values: Iterable[Any], most: int = PORTION_BYTES) -> Iterator[list[Any]]:
    """Values in lists that end with the one that brings their matrices' pixels to `most` bytes; each is asked for when its list is filled."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += _pixel_bytes(getattr(value, "value", value))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, matrix, error) of `.m4t` files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.m4t").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(path: str, content: bytes) -> tuple:
        try:
            return path, to_row(decode(content)), None
        except ValueError as e:
            return path, None, str(e)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in portions(map(read, batch["path"], batch["content"])):
                yield pd.DataFrame(rows, columns=["path", "matrix", "error"])

    return files.mapInPandas(work, f"path string, matrix {MATRIX.simpleString()}, error string")


def gray_of_images(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds `matrix` to Spark's image rows of 1, 3 or 4 channels (blue first); null for other kinds and for images of 100 pixels or less on a side."""

    def gray(row) -> dict | None:
        if row is None or row["height"] <= 100 or row["width"] <= 100 or row["nChannels"] not in (1, 3, 4):
            return None
        p = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
        if row["nChannels"] == 1:
            return to_row(p[:, :, 0])
        return to_row(gray_levels(p[:, :, 2::-1]))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["matrix"] = [gray(r) for r in batch[image]]
            yield batch

    return images.mapInPandas(work, with_fields(images.schema, matrix=MATRIX))
