"""Fills and offsets worked out on arrays of pixels: what the job's run lengths are held against."""

from __future__ import annotations

import numpy as np

from tallymark.operators.alignment import INKED, OFF_BUBBLE
from tallymark.operators.raster import GUARD_INSET, disk


def masks(width: int, height: int, inset: float, label_inset: float) -> dict[str, np.ndarray]:
    """The score disk, the ring for alignment (without the printed letter), and the guard disk."""
    r = min(width, height) // 2
    score = disk(width, height, int(r * inset))
    hole = int(r * label_inset)
    ring = score & ~disk(width, height, hole) if hole > 0 else score
    return {"score": score, "ring": ring, "guard": disk(width, height, int(r * GUARD_INSET))}


def fill_ratio(page: np.ndarray, cx: int, cy: int, mask: np.ndarray) -> float:
    """Share of a mask's pixels that are inked; 0 where its field leaves the page."""
    h, w = mask.shape
    x, y = cx - w // 2, cy - h // 2
    area = int(mask.sum())
    if not area or x < 0 or y < 0 or x + w > page.shape[1] or y + h > page.shape[0]:
        return 0.0
    return int(np.count_nonzero(page[y : y + h, x : x + w][mask])) / area


def _surface(page: np.ndarray, cx: int, cy: int, mask: np.ndarray, radius: int) -> np.ndarray:
    """Fill ratios at all offsets (dy, dx) within a radius."""
    h, w = mask.shape
    out, area = np.zeros((2 * radius + 1, 2 * radius + 1)), int(mask.sum())
    ys, xs = cy - h // 2 + np.arange(-radius, radius + 1), cx - w // 2 + np.arange(-radius, radius + 1)
    rows, cols = np.nonzero((ys >= 0) & (ys + h <= page.shape[0]))[0], np.nonzero((xs >= 0) & (xs + w <= page.shape[1]))[0]
    if area and len(rows) and len(cols):
        field = page[ys[rows[0]] : ys[rows[-1]] + h, xs[cols[0]] : xs[cols[-1]] + w] != 0
        out[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] = np.lib.stride_tricks.sliding_window_view(field, (h, w))[:, :, mask].sum(axis=-1) / area
    return out


def align(page: np.ndarray, centres: list[tuple[int, int]], shapes: dict[str, np.ndarray], threshold: float, radius: int) -> tuple[int, int]:
    """The offset within the radius whose ring fills have the largest gap; even rows go where the guard disks hold most ink, if they are inked.

    The rule is that of alignment.best_offsets: without a valid offset the gap is 0, at the centre.
    """
    if radius <= 0 or not centres:
        return 0, 0
    rings = np.sort(np.stack([_surface(page, x, y, shapes["ring"], radius) for x, y in centres]), axis=0)
    gap = np.diff(rings, axis=0).max(axis=0) if len(centres) > 1 else np.zeros(rings.shape[1:])
    at, best = _first_best(np.where(rings[0] < OFF_BUBBLE, -1.0, gap), radius)
    if best < 0:
        at, best = (0, 0), 0.0
    if best >= threshold:
        return at
    guard = np.sum([_surface(page, x, y, shapes["guard"], radius) for x, y in centres], axis=0)
    at, best = _first_best(guard, radius)
    return at if best / len(centres) > INKED else (0, 0)


def _first_best(score: np.ndarray, radius: int) -> tuple[tuple[int, int], float]:
    best = score.max()
    if score[radius, radius] == best:
        return (0, 0), float(best)
    dy, dx = np.argwhere(score == best)[0] - radius
    return (int(dx), int(dy)), float(best)


def question_fills(page: np.ndarray, question, settings) -> tuple[list[float], list[int], list[int]]:
    """Fills of a question's options at their detected offsets, and the offsets."""
    shapes = masks(question["bubbleWidth"], question["bubbleHeight"], settings["bubbleInset"], settings["labelInset"])
    centres = [(o["x"], o["y"]) for o in question["options"]]
    size = settings["searchGroupSize"]
    grouped = 0 < size < len(centres)
    step, radius = (size, settings["groupSearchRadius"]) if grouped else (max(1, len(centres)), settings["searchRadius"])
    dxs, dys = [], []
    for at in range(0, len(centres), step):
        some = centres[at : at + step]
        dx, dy = align(page, some, shapes, settings["fillThreshold"], radius)
        dxs += [dx] * len(some)
        dys += [dy] * len(some)
    return [fill_ratio(page, x + dx, y + dy, shapes["score"]) for (x, y), dx, dy in zip(centres, dxs, dys, strict=True)], dxs, dys
