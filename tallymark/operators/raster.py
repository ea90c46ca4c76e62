"""Pixel work in Arrow batches: thresholds, anchors, warps and crops.

Pages are matrix columns; numpy works on one page at a time inside tasks, so a task holds a few pages and nothing else.
Gray levels are 0..255, binary ones 0 or 255 with ink as 255. Filled circles follow the usual integer midpoint rule;
blurs and warps round to the nearest level and may differ from other libraries by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..schemas import MATRIX, with_fields
from ..sources.matrices import decode_image, from_row, portions, to_row
from ..sources.templates import preprocessing_page
from . import affine as affine_maps
from .guard import QUALITY, Outcome, PageError, TemplateError, guarded

#: The guard disk is so much of the radius, which contains the printed ring.
GUARD_INSET = 1.2
#: Anchor search: rounds, angles in each, the first round's breadth in degrees, its shrinkage, and a score that ends a round.
ROUNDS, ANGLES, BREADTH, SHRINK, GOOD = 3, 4, 10.0, 2.0, 0.95


# --- masks and fills


def half_widths(radius: int) -> list[int]:
    """How far a filled circle reaches sideways in the rows at distance 0..radius from its middle.

    The circle is the one that the integer midpoint rule draws (OpenCV's filled `circle`, 8-connected): an eighth of it is
    walked row by row, a step inwards taken whenever the running sum of the rule turns positive; mirrored at the diagonal.
    """
    reach = [-1] * (radius + 1)
    side, excess = radius, 0
    for row in range(radius + 1):
        if row > side:
            break
        reach[row], reach[side] = max(reach[row], side), max(reach[side], row)
        excess += 2 * row + 1
        if excess > 0:
            excess -= 2 * side - 1
            side -= 1
    return reach


@lru_cache(maxsize=256)
def disk(width: int, height: int, radius: int) -> np.ndarray:
    """A filled circle around the middle of a field."""
    mask = np.zeros((height, width), dtype=bool)
    if radius >= 0:
        reach = np.array(half_widths(radius))
        dy, dx = np.abs(np.arange(height) - height // 2)[:, None], np.abs(np.arange(width) - width // 2)[None, :]
        mask = (dy <= radius) & (dx <= reach[np.minimum(dy, radius)])
    return mask


# What keeps a page from being marked
EMPTY_PAGE, NO_QUESTIONS = "cannot evaluate an empty image", "mark template contains no questions"


# --- thresholds


def _kernel(size: int) -> np.ndarray:
    # Small binomial kernels, larger ones by their usual width
    small = {1: [1], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}
    if size in small:
        return np.array(small[size], dtype=np.float64)
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def _shifted(page: np.ndarray, axis: int, shifts: int, size: int) -> Iterator[np.ndarray]:
    """Views of a page that starts 0, 1, .. `shifts` - 1 later along an axis."""
    for i in range(shifts):
        yield page[i : i + size] if axis == 0 else page[:, i : i + size]


def blur(page: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with mirrored borders."""
    k, r = _kernel(size), size // 2
    out = page.astype(np.float64)
    for axis in (0, 1):
        if out.shape[axis] > 1 and r:
            wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > r else "symmetric")
            out = sum(w * part for w, part in zip(k, _shifted(wide, axis, len(k), page.shape[axis]), strict=True))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def box_mean(page: np.ndarray, size: int) -> np.ndarray:
    """Rounded mean of the square around each pixel, borders repeated."""
    r = size // 2
    sums = np.pad(np.pad(page.astype(np.int64), r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = page.shape
    total = sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]
    return np.floor(total / (size * size) + 0.5).astype(np.int64)


def close(page: np.ndarray, size: int) -> np.ndarray:
    """Morphological closing by a square."""
    if size <= 1:
        return page
    before, after = size // 2, size - 1 - size // 2
    for fill, pick in ((0, np.maximum), (255, np.minimum)):
        for axis in (0, 1):
            pad = [(before, after) if a == axis else (0, 0) for a in (0, 1)]
            wide = np.pad(page, pad, constant_values=fill)
            page = reduce(pick, _shifted(wide, axis, size, page.shape[axis]))
        before, after = after, before
    return page


def binarize(page: np.ndarray, blur_size: int, close_size: int, block: int = 0, c: float = 0.0, inverted: bool = True) -> np.ndarray:
    """Ink as 255: blur, compare with the local mean less c, close small holes."""
    if page.size == 0:
        raise PageError("cannot binarize an empty image")
    if blur_size % 2 == 0:
        raise TemplateError(f"blurSize must be odd, got {blur_size}")
    block = min(block or 91, *page.shape)
    block = max(3, block - 1 + block % 2)
    c = c or -15.0
    soft = blur(page, blur_size).astype(np.int64)
    rise = soft - box_mean(soft.astype(np.uint8), block)
    ink = rise <= -int(np.floor(c)) if inverted else rise > -int(np.ceil(c))
    return close(np.where(ink, 255, 0).astype(np.uint8), close_size)


# --- geometry


def resize(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area where the picture shrinks, else linearly."""
    h, w = page.shape
    if (w, h) == (width, height):
        return page
    if width * height < w * h:
        return np.clip(np.floor(_area(_area(page.astype(np.float64), height).T, width).T + 0.5), 0, 255).astype(np.uint8)
    ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    return _sample(page, np.clip(xs, 0, w - 1)[None, :].repeat(height, 0), np.clip(ys, 0, h - 1)[:, None].repeat(width, 1))


def _area(a: np.ndarray, size: int) -> np.ndarray:
    edges = np.arange(size + 1) * a.shape[0] / size
    sums = np.concatenate([np.zeros((1, a.shape[1])), a.cumsum(0)])
    low = np.minimum(edges.astype(int), a.shape[0] - 1)
    at = sums[low] + (edges - low)[:, None] * a[low]
    return np.diff(at, axis=0) / np.diff(edges)[:, None]


def _samples(wide: list[np.ndarray], rows: int, cols: int, xs: np.ndarray, ys: np.ndarray) -> list[np.ndarray]:
    """Values between pixels of pages of one size, each flat within a border of 0; 0 outside. Places and weights are worked out once for all of them."""
    x0, y0 = np.floor(xs).astype(int), np.floor(ys).astype(int)
    right, down = xs - x0, ys - y0
    out = [np.zeros(xs.shape) for _ in wide]
    lines = [(np.clip(y0 + (dy + 1), 0, rows + 1) * (cols + 2), np.abs(1 - dy - down)) for dy in (0, 1)]
    for dx in (0, 1):
        at_x, weight_x = np.clip(x0 + (dx + 1), 0, cols + 1), np.abs(1 - dx - right)
        for at_y, weight_y in lines:
            at, weight = at_y + at_x, weight_x * weight_y
            for total, pixels in zip(out, wide, strict=True):
                total += pixels.take(at) * weight
    return [np.clip(np.floor(total + 0.5), 0, 255).astype(np.uint8) for total in out]


def _sample(page: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    return _samples([np.pad(page, 1).ravel()], *page.shape, xs, ys)[0]


#: A warp works out so many places at once, which stay in a core's cache: about twelve numbers of 8 bytes are held for each.
PLACES = 8192


def warp_all(pages: list[np.ndarray], forward: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """Pages of one size under an affine map (2 x 3) from their points to the target's."""
    back = np.linalg.inv(np.vstack([forward, [0, 0, 1]]))
    wide = [np.pad(p, 1).ravel() for p in pages]
    out = [np.zeros((height, width), dtype=np.uint8) for _ in pages]
    step = max(1, PLACES // max(1, width))
    for top in range(0, height, step):
        x, y = np.meshgrid(np.arange(width), np.arange(top, min(height, top + step)))
        some = _samples(wide, *pages[0].shape, back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2])
        for whole, part in zip(out, some, strict=True):
            whole[top : top + step] = part
    return out


def warp(page: np.ndarray, forward: np.ndarray, width: int, height: int) -> np.ndarray:
    """The page under an affine map (2 x 3) from its points to the target's."""
    return warp_all([page], forward, width, height)[0]


def in_a_line(points: list[tuple[float, float]]) -> bool:
    """Whether no three points span an area."""
    return np.linalg.matrix_rank(np.column_stack([np.array(points, dtype=float).reshape(-1, 2), np.ones(len(points))])) < 3


def rotate(page: np.ndarray, degrees: float) -> np.ndarray:
    """About the middle, counter-clockwise, in a field of the same size."""
    t, cx, cy = np.deg2rad(degrees), page.shape[1] // 2, page.shape[0] // 2
    a, b = np.cos(t), np.sin(t)
    return warp(page, np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy]]), page.shape[1], page.shape[0])


def _fast(n: int) -> int:
    """The least length of at least n whose only primes are 2, 3 and 5: transforms of others are slow."""
    while True:
        left = n
        for prime in (2, 3, 5):
            while left % prime == 0:
                left //= prime
        if left == 1:
            return n
        n += 1


def _field_parts(field: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """What all patterns of h x w have in common in a field: its spectrum, the power at each place, and the size of the transforms.

    Transforms as large as the field are enough: what wraps around falls before the first whole place.
    """
    if field.shape[0] < h or field.shape[1] < w:
        raise PageError("an anchor is larger than its region")
    f, shape = field.astype(np.float64), (_fast(field.shape[0]), _fast(field.shape[1]))
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (f, f * f)]
    total, squares = (s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w] for s in sums)
    return np.fft.rfft2(f, shape), np.maximum(squares - total**2 / (h * w), 0), shape


def _pattern_parts(data: bytes, size: tuple[int, int], degrees: float, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    """The spectrum and the power of a turned pattern, given by its pixels as bytes."""
    p = rotate(np.frombuffer(data, dtype=np.uint8).reshape(size), degrees).astype(np.float64)
    p = p - p.mean()
    return np.fft.rfft2(p[::-1, ::-1], shape), (p**2).sum()


#: Turned patterns are the same for all pages of a template: small ones, of so many pixels of a transform, are remembered, in 64 MB at most.
SMALL = 8192
_kept_parts = lru_cache(maxsize=1000)(_pattern_parts)


def find_anchor(binary: np.ndarray, pattern: np.ndarray, roi: tuple[int, int, int, int], least: float) -> tuple[int, int]:
    """The centre of a pattern in a region (x0, y0, x1, y1): each round tries turns around the best one so far, over half the breadth.

    A turn's score is the correlation coefficient of the turned pattern at each place in the region.
    """
    x0, y0, x1, y1 = (int(np.clip(v, 0, m)) for v, m in zip(roi, (binary.shape[1], binary.shape[0]) * 2, strict=True))
    h, w = pattern.shape
    spectrum, power, shape = _field_parts(binary[y0:y1, x0:x1], h, w)
    parts = _kept_parts if shape[0] * shape[1] <= SMALL else _pattern_parts
    data = pattern.tobytes()
    rows, cols = power.shape
    best, place, middle, breadth = 0.0, (0, 0), 0.0, BREADTH
    # a region without contrast matches nothing, whatever the turn
    for _ in range(ROUNDS if power.any() else 0):
        turn = middle
        for k in range(ANGLES):
            angle = middle - breadth / 2 + k * breadth / (ANGLES - 1)
            own, strength = parts(data, (h, w), angle, shape)
            cross = np.fft.irfft2(spectrum * own, shape)[h - 1 : h - 1 + rows, w - 1 : w - 1 + cols]
            spread = np.sqrt(power * strength)
            flat = spread <= 1e-6
            scores = np.where(flat, 0, cross / np.where(flat, 1, spread))
            top = float(scores.max())
            if top > best or top > GOOD:
                y, x = np.unravel_index(scores.argmax(), scores.shape)
                turn = angle if top > best else turn
                best, place = top, (int(x), int(y))
            if top > GOOD:
                break
        middle, breadth = turn, breadth / SHRINK
    if best < least:
        raise PageError(f"an anchor matches by {best:.2f}, where {least:.2f} is needed")
    return x0 + place[0] + pattern.shape[1] // 2, y0 + place[1] + pattern.shape[0] // 2


def scaled_pattern(pattern: np.ndarray, roi: tuple[int, int, int, int], sx: float, sy: float) -> np.ndarray:
    """An anchor's pattern at the page's resolution."""
    width, height = max(1, int(pattern.shape[1] * sx + 0.5)), max(1, int(pattern.shape[0] * sy + 0.5))
    if width > roi[2] - roi[0] or height > roi[3] - roi[1]:
        raise PageError("an anchor is larger than its region")
    return resize(pattern, width, height)


def locate(gray: np.ndarray, page: dict, patterns: list[np.ndarray | None]) -> tuple[np.ndarray, list[tuple[float, float]], bool]:
    """(binary, places of the anchors, turned): the page binarized, upside down if its anchors are found only so."""
    config, width, height, anchors = page["config"], page["width"], page["height"], page["anchors"]
    if width <= 0 or height <= 0:
        raise TemplateError(f"a template of {width} x {height}")
    if len(anchors) < 3:
        raise TemplateError(f"at least 3 anchors are needed, not {len(anchors)}")
    if len(patterns) != len(anchors) or any(p is None for p in patterns):
        raise TemplateError("an anchor has no image")
    binary = binarize(gray, config["blurSize"], config["morphCloseSize"], config["adaptiveBlockSize"], config["adaptiveC"])
    sx, sy = gray.shape[1] / width, gray.shape[0] / height

    def places(page: np.ndarray) -> list[tuple[float, float]]:
        found = []
        for a, p in zip(anchors, patterns, strict=True):
            roi = tuple(int(v * s) for v, s in ((a["roi"]["min"]["x"], sx), (a["roi"]["min"]["y"], sy), (a["roi"]["max"]["x"], sx), (a["roi"]["max"]["y"], sy)))
            found.append(find_anchor(page, scaled_pattern(p, roi, sx, sy), roi, config["minAnchorConfidence"]))
        if in_a_line(found):
            raise PageError(NO_MAP)
        return found

    try:
        return binary, places(binary), False
    except PageError:
        turned = binary[::-1, ::-1]
        return turned, places(turned), True


#: What keeps a page from being straightened though its anchors are found.
NO_MAP = "the anchors give no affine map"
#: The column in which a row's template page goes to Python: as text, since pandas makes floats of a struct's numbers beside a null.
_TEXT = "_template_text"
_LOCATED = {"binary": MATRIX, "points": T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("sx", "sy", "tx", "ty")])), "turned": T.BooleanType(), "error": T.StringType(), "error_class": T.StringType()}


def _in_portions(batch: pd.DataFrame, found: Iterable[Outcome]) -> Iterator[tuple[pd.DataFrame, list[Outcome]]]:
    """A batch's rows with what its steps gave, which are worked out as they are asked for, a few MB of pixels at a time."""
    at = 0
    for some in portions(found):
        yield batch.iloc[at : at + len(some)], some
        at += len(some)


def _columns(batch: pd.DataFrame, found: list[Outcome], names: tuple[str, ...]) -> pd.DataFrame:
    """A batch with the parts of its rows' values, errors and classes behind."""
    for k, name in enumerate(names):
        batch[name] = pd.Series([None if f.error is not None else f.value[k] for f in found], index=batch.index, dtype=object)
    batch["error"], batch["error_class"] = (pd.Series([getattr(f, c) for f in found], index=batch.index, dtype=object) for c in ("error", "error_class"))
    return batch


def locate_anchors(rows: DataFrame, page: str = "gray", template_page: str = "template_page_text", patterns: str = "patterns") -> DataFrame:
    """Adds `binary`, `points` (where each anchor is and belongs), `turned`, `error` and `error_class`; template_page is JSON text, which goes, as do the patterns."""

    def step(gray, text: str | None, some) -> tuple:
        if text is None or some is None:
            raise TemplateError("template not found")
        pixels = from_row(gray)
        if pixels is None:
            raise PageError("the page is empty")
        known = json.loads(text)
        binary, places, turned = locate(pixels, known, [from_row(p) for p in some])
        points = [{"sx": float(x), "sy": float(y), "tx": float(a["center"]["x"]), "ty": float(a["center"]["y"])} for (x, y), a in zip(places, known["anchors"], strict=True)]
        return to_row(binary), points, turned

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (guarded(step, *row) for row in zip(batch[page], batch[template_page], batch[patterns], strict=True))
            for rows, some in _in_portions(batch, found):
                yield _columns(rows.drop(columns=[template_page, patterns]), some, ("binary", "points", "turned"))

    return rows.mapInPandas(work, with_fields(rows.schema, (template_page, patterns), **_LOCATED))


def warp_pages(rows: DataFrame, page: str = "gray", size: str = "size") -> DataFrame:
    """Adds `picture` and puts the straightened `binary` in place of the other, by the affine `map` of rows as locate_anchors gives them.

    size: (width, height). Rows with an error stay as they are, without a binary; the page of the others goes.
    """

    def step(gray, binary, turned, m, to) -> tuple:
        forward = np.array([[m["a"], m["b"], m["c"]], [m["d"], m["e"], m["f"]]])
        pixels = from_row(gray)
        pixels = pixels[::-1, ::-1] if turned else pixels
        width, height = int(to["width"]), int(to["height"])
        picture, ink = warp_all([pixels, from_row(binary)], forward, width, height)
        return to_row(picture), to_row(np.where(ink > 128, 255, 0).astype(np.uint8))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = zip(batch[page], batch["binary"], batch["turned"], batch["map"], batch[size], batch["error"], batch["error_class"], strict=True)
            found = (guarded(step, *row) if error is None else Outcome(None, error, kind) for *row, error, kind in held)
            for part, some in _in_portions(batch, found):
                out = _columns(part.drop(columns=["map", "points", size]), some, ("picture", "binary"))
                out[page] = pd.Series([g if f.error is not None else None for g, f in zip(part[page], some, strict=True)], index=out.index, dtype=object)
                yield out

    return rows.mapInPandas(work, with_fields(rows.schema, ("map", "points", size), picture=MATRIX))


def fit_pages(rows: DataFrame, page: str = "gray", template_page: str = "template_page", patterns: str = "patterns") -> DataFrame:
    """Adds `picture`, `binary`, `turned`, `error` and `error_class` to rows of a gray page, a template page and its anchors' patterns, which both go.

    template_page: (width, height, config, anchors), as templates.preprocessing_page makes it. Anchors are found in the pixels, the map
    in columns, and the pixels are then warped. Any row gives a row: nothing that a page or template holds ends the others. The
    page stays where it has an error.
    """
    t = F.col(template_page)
    ratio = scalars.size_ratio(F.col(page)["cols"], F.col(page)["rows"], F.nullif(t["width"], F.lit(0)), F.nullif(t["height"], F.lit(0)))
    scaled = t.withField("config", scalars.scaled_config(t["config"], ratio))
    shaped = rows.withColumns({_TEXT: F.to_json(F.when(t.isNotNull(), scaled), {"ignoreNullFields": "false"}), "size": F.struct(t["width"].alias("width"), t["height"].alias("height"))}).drop(template_page)
    found = locate_anchors(shaped, page, _TEXT, patterns)
    mapped = found.withColumn("map", affine_maps.consensus(F.col("points")))
    lost = F.col("error").isNull() & F.col("map").isNull()
    mapped = mapped.withColumns({"error": F.when(lost, NO_MAP).otherwise(F.col("error")), "error_class": F.when(lost, QUALITY).otherwise(F.col("error_class"))})
    return warp_pages(mapped, page)


def preprocess_pages(rows: DataFrame, page: str = "gray", template: str = "template", page_index: str = "page_index", patterns: str = "patterns") -> DataFrame:
    """fit_pages for rows of a whole template and the index of one of its pages; the template and the index stay."""
    known = rows.withColumn("_template_page", preprocessing_page(F.col(template), F.col(page_index)))
    kept = fit_pages(known, page, "_template_page", patterns)
    return kept.drop(page)


def anchor_patterns(rows: DataFrame, image: str = "image", config: str = "config") -> DataFrame:
    """Adds `matrix` and `error` to rows of an encoded image in base64 and the settings that it is binarized by; the image goes."""
    known = rows.withColumn(image, F.try_to_binary(F.col(image), F.lit("base64"))).withColumn(config, F.to_json(F.col(config), {"ignoreNullFields": "false"}))

    def pattern(data: bytes | None, text: str | None) -> dict:
        if not data or text is None:
            raise TemplateError("no image in base64")
        c = json.loads(text)
        return to_row(binarize(decode_image(data), c["blurSize"] or 0, c["morphCloseSize"] or 0, c["adaptiveBlockSize"] or 0, c["adaptiveC"] or 0.0))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (guarded(pattern, data, c) for data, c in zip(batch[image], batch[config], strict=True))
            for part, some in _in_portions(batch, found):
                out = part.drop(columns=[image, config])
                out["matrix"], out["error"] = pd.Series([f.value for f in some], index=out.index, dtype=object), pd.Series([f.error for f in some], index=out.index, dtype=object)
                yield out

    return known.mapInPandas(work, with_fields(rows.schema, (image, config), matrix=MATRIX, error=T.StringType()))


def crop(rows: DataFrame, page: str = "picture", bounds: str = "bounds") -> DataFrame:
    """Adds `snippet`: the part of a page within bounds, blank where that leaves the page; null without either, or where the page can't be read."""

    def cut(row, b) -> dict | None:
        pixels = from_row(row)
        if pixels is None or b is None or b["width"] <= 0 or b["height"] <= 0:
            return None
        # beside a null pandas holds numbers as floats
        x, y, width, height = (int(b[c]) for c in ("x", "y", "width", "height"))
        out = np.zeros((height, width), dtype=np.uint8)
        x0, y0, x1, y1 = max(0, x), max(0, y), min(pixels.shape[1], x + width), min(pixels.shape[0], y + height)
        if x1 > x0 and y1 > y0:
            out[y0 - y : y1 - y, x0 - x : x1 - x] = pixels[y0:y1, x0:x1]
        return to_row(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (guarded(cut, p, b) for p, b in zip(batch[page], batch[bounds], strict=True))
            for part, some in _in_portions(batch, found):
                out = part.drop(columns=page)
                out["snippet"] = pd.Series([f.value for f in some], index=out.index, dtype=object)
                yield out

    return rows.mapInPandas(work, with_fields(rows.schema, (page,), snippet=MATRIX))
