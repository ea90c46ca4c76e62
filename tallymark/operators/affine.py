"""Affine maps from pairs of points, one wrong pair or more left out, in column arithmetic.

Each triple of pairs gives one map in closed form; the pairs that it brings within a distance of their targets agree with it. The
triple with most of them wins, by their smaller error and then the first, and the map is fitted to those pairs by least
squares, which for three is exact. All of it happens inside a row's array; pairs are the anchors of a page, so a handful.

Defined results: null for fewer than three pairs, a null among them, or sources on one line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a point may lie from its target, in pixels, to agree with a map: the usual bound of such searches.
WITHIN = 3.0
#: Twice the area that three sources must span at least.
LEAST_AREA = 1e-6
POINTS = "array<struct<sx:double,sy:double,tx:double,ty:double>>"
MAP = "struct<a:double,b:double,c:double,d:double,e:double,f:double,inliers:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(a, b, c, d, e, f) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))


def of_triple(p: Column, q: Column, r: Column) -> Column:
    """The map that brings three sources to their targets: (a x + b y + c, d x + e y + f); null on a line."""
    s = F.struct((q["sx"] - p["sx"]).alias("ux"), (q["sy"] - p["sy"]).alias("uy"), (r["sx"] - p["sx"]).alias("vx"), (r["sy"] - p["sy"]).alias("vy"))

    def solved(s: Column) -> Column:
        area = s["ux"] * s["vy"] - s["uy"] * s["vx"]

        def row(axis: str) -> tuple[Column, Column]:
            u, v = q[axis] - p[axis], r[axis] - p[axis]
            return (u * s["vy"] - v * s["uy"]) / area, (v * s["ux"] - u * s["vx"]) / area

        (a, b), (d, e) = row("tx"), row("ty")
        linear = F.struct(a.alias("a"), b.alias("b"), d.alias("d"), e.alias("e"))
        whole = let(linear, lambda m: _map(m["a"], m["b"], p["tx"] - m["a"] * p["sx"] - m["b"] * p["sy"], m["d"], m["e"], p["ty"] - m["d"] * p["sx"] - m["e"] * p["sy"]))
        return F.when(F.abs(area) > LEAST_AREA, whole)

    return let(s, solved)


def error_of(m: Column, p: Column) -> Column:
    """The squared distance from a pair's mapped source to its target."""
    dx, dy = m["a"] * p["sx"] + m["b"] * p["sy"] + m["c"] - p["tx"], m["d"] * p["sx"] + m["e"] * p["sy"] + m["f"] - p["ty"]
    return dx * dx + dy * dy


def least_squares(points: Column) -> Column:
    """The map with the smallest sum of squared distances; null on a line."""
    n = F.size(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / n
    middle = F.struct(*[mean(x).alias(x) for x in ("sx", "sy", "tx", "ty")])

    def around(m: Column) -> Column:
        product = lambda x, y: F.aggregate(points, F.lit(0.0), lambda s, p: s + (p[x] - m[x]) * (p[y] - m[y]))
        sums = F.struct(*[product(x, y).alias(x + y) for x, y in (("sx", "sx"), ("sx", "sy"), ("sy", "sy"), ("sx", "tx"), ("sy", "tx"), ("sx", "ty"), ("sy", "ty"))])

        def solved(s: Column) -> Column:
            area = s["sxsx"] * s["sysy"] - s["sxsy"] * s["sxsy"]
            row = lambda t: ((s[f"sx{t}"] * s["sysy"] - s[f"sy{t}"] * s["sxsy"]) / area, (s[f"sy{t}"] * s["sxsx"] - s[f"sx{t}"] * s["sxsy"]) / area)
            (a, b), (d, e) = row("tx"), row("ty")
            linear = F.struct(a.alias("a"), b.alias("b"), d.alias("d"), e.alias("e"))
            return F.when(area > LEAST_AREA, let(linear, lambda k: _map(k["a"], k["b"], m["tx"] - k["a"] * m["sx"] - k["b"] * m["sy"], k["d"], k["e"], m["ty"] - k["d"] * m["sx"] - k["e"] * m["sy"])))

        return let(sums, solved)

    return let(middle, around)


def consensus(points: Column, within: float = WITHIN) -> Column:
    """(a, b, c, d, e, f, inliers) from an array of (sx, sy, tx, ty)."""
    places = F.sequence(F.lit(0), F.greatest(F.size(points) - 1, F.lit(0)))
    after = lambda i: F.filter(places, lambda j: j > i)
    at = lambda i: F.get(points, i)
    maps = F.flatten(F.transform(places, lambda i: F.flatten(F.transform(after(i), lambda j: F.transform(after(j), lambda k: of_triple(at(i), at(j), at(k)))))))

    def rated(m: Column, number: Column) -> Column:
        agree = F.filter(points, lambda p: error_of(m, p) <= within * within)
        return let(agree, lambda own: F.struct(F.size(own).alias("n"), (-F.aggregate(own, F.lit(0.0), lambda s, p: s + error_of(m, p))).alias("close"), (-number).alias("first"), own.alias("own")))

    best = F.array_max(F.transform(F.filter(maps, lambda m: m.isNotNull()), rated))
    fitted = let(best, lambda b: F.when(b.isNotNull(), let(least_squares(b["own"]), lambda m: F.when(m.isNotNull(), F.struct(*[m[c].alias(c) for c in "abcdef"], b["n"].alias("inliers"))))))
    whole = points.isNotNull() & (F.size(points) >= 3) & F.forall(points, lambda p: p.isNotNull() & p["sx"].isNotNull() & p["sy"].isNotNull() & p["tx"].isNotNull() & p["ty"].isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), fitted)
