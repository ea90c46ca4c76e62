"""Scalar expressions: pixels, sizes, texts for people, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def luma(r, g, b) -> Column:
    """Gray level 0..255 of channels given in 16 bits."""
    return F.shiftright(19595 * col(r).cast("long") + 38470 * col(g).cast("long") + 7471 * col(b).cast("long") + 32768, 24)


def luma_bytes(r, g, b) -> Column:
    """Gray level of channels given in 8 bits, widened by a shift alone."""
    wide = lambda c: F.shiftleft(col(c).cast("long"), 8)
    return luma(wide(r), wide(g), wide(b))


def size_ratio(width, height, to_width, to_height) -> Column:
    """Mean of the ratios of both sides."""
    return (col(width).cast("double") / col(to_width) + col(height).cast("double") / col(to_height)) / 2


def drifts(ratio) -> Column:
    """Whether a page's resolution is far from its template's."""
    return (col(ratio) < 0.67) | (col(ratio) > 1.5)


def scale_size(size, ratio, least=1) -> Column:
    return F.greatest(F.lit(least), F.floor(col(size) * col(ratio) + 0.5)).cast("int")


def scale_odd(size, ratio, least=1) -> Column:
    scaled = scale_size(size, ratio, least)
    return F.when(scaled % 2 == 0, scaled + 1).otherwise(scaled)


def scaled_config(config: Column, ratio: Column) -> Column:
    """Preprocessing settings for pages at `ratio` of the template's size: the sizes that are set, by ratio / referenceRatio.

    Without a reference they stay as they are, and so do those that are 0 or null.
    """
    reference = config["referenceRatio"]
    by = col(ratio) / F.when(reference > 0, reference)
    for name, scaled, least in (("blurSize", scale_odd, 1), ("adaptiveBlockSize", scale_odd, 3), ("morphCloseSize", scale_size, 0)):
        size = config[name]
        config = config.withField(name, F.when(by.isNotNull() & (size > 0), scaled(size, by, least)).otherwise(size))
    return config


def scale_axis(value, size, to_size) -> Column:
    """A coordinate in another page size, cut to a whole number."""
    return (col(value) * (col(size).cast("double") / col(to_size))).cast("int")


def fit(width, height, to_width, to_height, how: str) -> Column:
    """Scale that makes a template contain, cover or fill (by its mean) another size."""
    x, y = col(to_width).cast("double") / col(width), col(to_height).cast("double") / col(height)
    return {"contain": F.least(x, y), "cover": F.greatest(x, y), "fill": (x + y) / 2}[how]


def progress(done, total) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(done).cast("double") / col(total)))


def format_bytes(n, decimals: int = 1, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """Bytes below 1024 as they are, above in the largest unit that leaves at least 1; ties go to the even digit."""
    n = col(n)
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(units, 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.{decimals}f {unit}", F.bround(n / float(1024**power), decimals))).otherwise(out)
    return out


def format_uptime(seconds) -> Column:
    """DD:HH:MM:SS."""
    s = col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def key_digest(key, bits: int = 512) -> Column:
    return F.sha2(col(key).cast("binary"), bits)


def key_allowed(key, stored_digest) -> Column:
    """A key is checked by its SHA-512 where a digest is stored, and all are allowed where none is; an empty key is not."""
    stored, given = col(stored_digest), F.coalesce(col(key), F.lit(""))
    return F.when(F.coalesce(stored, F.lit("")) == "", F.lit(True)).otherwise((given != "") & (key_digest(given) == F.lower(stored)))


def is_blank(text) -> Column:
    """Nothing but white space, of Unicode's kinds too."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\s\x85\p{Z}]+", "") == ""


def query_value(text, kind: str, default=None) -> Column:
    """A query-string value: its default where absent or empty, null where it can't be read as its kind."""
    given = F.when(F.coalesce(col(text), F.lit("")) == "", F.lit(default).cast("string")).otherwise(col(text))
    if kind == "bool":
        return F.when(given.isin("1", "t", "T", "true", "TRUE", "True"), True).when(given.isin("0", "f", "F", "false", "FALSE", "False"), False)
    if kind == "uint":
        n = F.when(given.rlike(r"^\d+$"), given.try_cast("long"))
        return F.when(n >= 0, n)
    return F.when(given.rlike(r"^[+-]?\d+$"), given.try_cast("long")) if kind == "int" else given


def positive_query(text, name: str, default: int | None = None) -> Column:
    """A (value, error) of a query-string count that must be positive, such as a limit or a resolution."""
    value = query_value(text, "uint", default)
    error = F.when(value.isNull(), f"{name} is not a whole number").when(value == 0, f"{name} must be positive")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def readable(matrix: Column) -> Column:
    """Whether a matrix has as many pixels as its rows and columns say, and any."""
    size = F.length(matrix["data"])
    return F.coalesce((matrix["rows"] > 0) & (matrix["cols"] > 0) & (size == matrix["rows"].cast("long") * matrix["cols"]), F.lit(False))
