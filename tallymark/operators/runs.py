"""Fill ratios by run lengths, in DataFrame functions: no page goes to Python.

A binary page becomes rows (y, x0, x1) of ink: each pixel row is cut out of its bytes and split twice, by ink and by blank. A
bubble's masks are rows of the same form, so the ink under a mask is the overlap of two interval tables, met by (template,
page, y, bin). The masks are a template's, few beside the pages, and go to all executors while their table is small; sums per option
combine where the page was read, so pixels are never shuffled.

Where a template searches, a mask is met at each dy, and the overlap at each dx is worked out on the spot; the
candidates' fills go to `alignment.best_offsets`, the one rule for where a row sits.

Defined results: null options and questions are none; a field that leaves the page has fill 0, and so has one without area, or of a size below 0; a page that is
null, empty, or has not as many bytes as rows and columns is an error row; so is one without questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import readable
from ..sources.cuts import cut, join_small
from . import alignment, intervals
from .affine import let
from .raster import EMPTY_PAGE, GUARD_INSET, NO_QUESTIONS, half_widths

#: Pixels of a bin.
BIN = 64
KEYS = ["scan_id", "template_id", "page_index"]


def ink_runs(pages: DataFrame, keys: list[str], matrix: str = "binary", lines: DataFrame | None = None) -> DataFrame:
    """(keys, y, x0, x1): maximal runs of pixels that aren't 0, x1 after the last; readable pages only.

    lines: a cut table of the rows of pixels that are wanted, as `y` and some of the keys; the others aren't looked at.
    """
    m = F.col(matrix)
    some = pages.where(readable(m)).select(*keys, m["cols"].alias("cols"), m["data"].alias("data"), F.explode(F.sequence(F.lit(0), m["rows"] - 1)).alias("y"))
    if lines is not None:
        some = join_small(some, lines, list(lines.columns), "left_semi")
    # projections after one another, and no filter on what they work out: each text is made once
    line = F.decode(F.substring("data", F.col("y") * F.col("cols") + 1, F.col("cols")), "ISO-8859-1")
    split = some.select(*keys, "y", line.alias("line")).select(*keys, "y", "line", F.split("line", "\x00+").alias("inks"))
    first, last = F.get("inks", F.lit(0)), F.get("inks", F.size("inks") - 1)
    n = F.size("inks") - (first == "").cast("int") - (last == "").cast("int")
    found = split.select(*keys, "y", "line", n.alias("n"), F.when(first != "", first).otherwise(F.get("inks", F.lit(1))).alias("ink"))
    # most lines have one run, which is where its ink is first found
    x0 = F.instr("line", F.col("ink")) - 1
    placed = found.select(*keys, "y", x0.alias("x0"), F.length("ink").alias("width"), F.when(F.col("n") > 1, _several(F.col("line"))).alias("several"))
    each = placed.select(*keys, "y", "x0", "width", F.explode_outer("several").alias("run"))
    return each.select(*keys, "y", F.coalesce("run.x0", "x0").alias("x0"), F.coalesce("run.x1", F.col("x0") + F.col("width")).alias("x1")).where("x0 < x1")


def _several(line: Column) -> Column:
    """All runs of a line: of k there are k lengths of ink, and k + 1 of blank, the first and last of which may be 0."""
    ink = F.filter(F.transform(F.split(line, "\x00+"), F.length), lambda n: n > 0)
    blank = F.transform(F.split(line, "[^\x00]+"), F.length)
    numbered = F.transform(ink, lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<x0:int,x1:int>>").alias("runs"))

    def step(a: Column, x: Column, blank: Column) -> Column:
        first = a["at"] + F.get(blank, x["k"])
        return F.struct((first + x["n"]).alias("at"), F.concat(a["runs"], F.array(F.struct(first.alias("x0"), (first + x["n"]).alias("x1")))).alias("runs"))

    return let(blank, lambda b: F.aggregate(numbered, start, lambda a, x: step(a, x, b), lambda a: a["runs"]))


def disk_rows(radii: DataFrame) -> DataFrame:
    """(radius, dy, reach) of the filled circles of these radii (a column `radius`)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, sign * dy, reach) for r in batch["radius"] for dy, reach in enumerate(half_widths(int(r))) for sign in ((1, -1) if dy else (1,))]
            yield pd.DataFrame(rows, columns=["radius", "dy", "reach"])

    return radii.where(F.col("radius") >= 0).distinct().mapInPandas(work, "radius int, dy int, reach int")


def option_fields(questions: DataFrame) -> DataFrame:
    """(template_id, page_index, ordinal, option, grp, radius, cx, cy, w, h, r_score, r_hole, r_guard): a row per option.

    questions: as templates.questions gives them.
    """
    q, s = F.col("question"), F.col("settings")
    n = F.size(q["options"])
    base = questions.select("template_id", "page_index", "ordinal", q["bubbleWidth"].alias("w"), q["bubbleHeight"].alias("h"), s["bubbleInset"].alias("inset"), s["labelInset"].alias("label"),
        n.alias("n"), s["searchGroupSize"].alias("size"), s["searchRadius"].alias("radius"), s["groupSearchRadius"].alias("group_radius"), q["options"].alias("options"))
    offsets = alignment.row_offsets("n", "size", "radius", "group_radius")
    each = base.withColumn("r", F.floor(F.least("w", "h") / 2).cast("int")).select("*", F.explode(F.arrays_zip(F.col("options").alias("o"), offsets.alias("at"))).alias("x"))
    # a radius of whole pixels; products are cut towards 0
    within = lambda share: F.when(F.col("r") > 0, (F.col("r") * share).cast("int")).otherwise(F.lit(0))
    return each.select("template_id", "page_index", "ordinal", F.col("x.at.option").alias("option"), F.col("x.at.group").alias("grp"), F.greatest(F.lit(0), F.coalesce("x.at.radius", F.lit(0))).alias("radius"), F.col("x.o.x").alias("cx"), F.col("x.o.y").alias("cy"), "w", "h",
        within(F.col("inset")).alias("r_score"), within(F.col("label")).alias("r_hole"), within(F.lit(GUARD_INSET)).alias("r_guard"))


def mask_runs(fields: DataFrame) -> DataFrame:
    """The fields' masks as rows, with (kind, y, m0, m1): signed runs of the score disk, of the hole in it, and of the guard disk.

    Runs stay within the field of w x h around the middle. The ring of alignment is the score disk less the hole.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"r_{k}").alias("disk")) for k in ("score", "hole", "guard")]))
    wanted = fields.select("*", kinds.alias("k")).select(*fields.columns, F.col("k.kind").alias("kind"), F.col("k.disk").alias("disk"))
    # only a search asks for rings and guards; a hole of radius 0 is none, and takes no more than the score disk has
    wanted = wanted.where((F.col("kind") == "score") | (F.col("radius") > 0)).where((F.col("kind") != "hole") | (F.col("disk") > 0)).withColumn("disk", F.when(F.col("kind") == "hole", F.least("disk", "r_score")).otherwise(F.col("disk")))
    rows = wanted.join(disk_rows(wanted.select(F.col("disk").alias("radius"))).withColumnRenamed("radius", "disk"), "disk").where(F.col("reach") >= 0)
    left, top = F.col("cx") - F.floor(F.col("w") / 2), F.col("cy") - F.floor(F.col("h") / 2)
    m0, m1 = F.greatest(left, F.col("cx") - F.col("reach")), F.least(left + F.col("w"), F.col("cx") + F.col("reach") + 1)
    y = F.col("cy") + F.col("dy")
    return rows.where((y >= top) & (y < top + F.col("h"))).select(*fields.columns, "kind", y.alias("y"), m0.alias("m0"), m1.alias("m1")).where("m0 < m1")


_OPTION = ["template_id", "page_index", "ordinal", "option"]


def mask_areas(masks: DataFrame) -> DataFrame:
    """(option's keys, score, ring, guard): pixels of each mask."""
    size = F.col("m1") - F.col("m0")
    sums = masks.groupBy(*_OPTION).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, size)), F.lit(0)).alias(k) for k in ("score", "hole", "guard")])
    return sums.select(*_OPTION, "score", (F.col("score") - F.col("hole")).alias("ring"), "guard")


def page_sizes(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, rows, cols, error) of pages (keys, binary), without their pixels."""
    m = F.col("binary")
    size = F.coalesce(F.length(m["data"]), F.lit(0))
    error = F.when(~readable(m), F.when(size == 0, EMPTY_PAGE).otherwise(F.format_string("%d bytes are no %s x %s matrix", size, m["rows"].cast("string"), m["cols"].cast("string"))))
    return pages.select(*keys, m["rows"].alias("rows"), m["cols"].alias("cols"), error.alias("error"))


def surfaces(pages: DataFrame, sizes: DataFrame, fields: DataFrame) -> DataFrame:
    """(KEYS, ordinal, option, grp, radius, score, ring, guard): each option's fills at all offsets of its radius, dy by dy and dx by dx.

    pages: (KEYS, binary); sizes: as page_sizes gives them, cut. An array has (2 * radius + 1) ** 2 fills, and the middle one is the option's own place. Without a radius, ring and guard
    are not asked for, and 0.
    """
    masks = cut(mask_runs(fields), "masks")
    areas = mask_areas(masks)
    shifted = masks.withColumn("dy", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn("y", F.col("y") + F.col("dy"))
    dealt = intervals.touched(shifted, F.col("m0") - F.col("radius"), F.col("m1") + F.col("radius"), BIN)
    dealt = cut(dealt.select("template_id", "page_index", "y", "bin", "ordinal", "option", "radius", "kind", "dy", "m0", "m1"), "dealt")
    lines = cut(dealt.select("template_id", "page_index", "y").distinct(), "lines")
    runs = intervals.pieces(ink_runs(pages, KEYS, lines=lines), "x0", "x1", BIN)
    met = join_small(runs, dealt, ["template_id", "page_index", "y", "bin"], "inner")
    at = met.withColumn("dx", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    ink = intervals.overlap(F.col("x0"), F.col("x1"), F.col("m0") + F.col("dx"), F.col("m1") + F.col("dx"))
    place = (F.col("dy") + F.col("radius")) * (2 * F.col("radius") + 1) + F.col("dx") + F.col("radius")
    sums = at.withColumns({"ink": ink, "place": place}).where("ink > 0").groupBy(*KEYS, "ordinal", "option", "place").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("ink"))), F.lit(0)).alias(k) for k in ("score", "hole", "guard")])
    inked = sums.groupBy(*KEYS, "ordinal", "option").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("score", (F.col("score") - F.col("hole")).alias("ring"), "guard").alias("n")))).alias("ink"))
    # every option of every page, inked or not
    every = join_small(sizes.where(F.col("error").isNull()).select(*KEYS, "rows", "cols"), cut(fields.join(areas, _OPTION, "left").select(*_OPTION, "grp", "radius", "cx", "cy", "w", "h", *[F.coalesce(c, F.lit(0)).alias(f"area_{c}") for c in ("score", "ring", "guard")]), "options"), ["template_id", "page_index"], "inner")
    known = every.join(inked, [*KEYS, "ordinal", "option"], "left")
    side = 2 * F.col("radius") + 1
    places = F.sequence(F.lit(0), side * side - 1)

    def fill(kind: str) -> Column:
        def one(p: Column) -> Column:
            left, top = F.col("cx") - F.floor(F.col("w") / 2) + p % side - F.col("radius"), F.col("cy") - F.floor(F.col("h") / 2) + F.floor(p / side) - F.col("radius")
            inside = (left >= 0) & (top >= 0) & (left + F.col("w") <= F.col("cols")) & (top + F.col("h") <= F.col("rows")) & (F.col(f"area_{kind}") > 0)
            return F.when(inside, F.coalesce(F.try_element_at("ink", p.cast("int"))[kind], F.lit(0)).cast("double") / F.col(f"area_{kind}")).otherwise(F.lit(0.0))

        return F.transform(places, one)

    unasked = lambda kind: F.when(F.col("radius") > 0, fill(kind)).otherwise(F.array(F.lit(0.0))).alias(kind)
    return known.select(*KEYS, "ordinal", "option", "grp", "radius", fill("score").alias("score"), unasked("ring"), unasked("guard"))


def option_fills(pages: DataFrame, sizes: DataFrame, questions: DataFrame) -> DataFrame:
    """(KEYS, ordinal, fills, dxs, dys): each question's fills at its groups' offsets, options in order."""
    # a field larger than every page has no mask, and an offset beyond them all no ink
    top = sizes.where(F.col("error").isNull()).agg(F.max("cols").alias("w"), F.max("rows").alias("h")).first()
    most = max(top.w or 0, top.h or 0)
    fields = option_fields(questions).withColumn("radius", F.least(F.col("radius"), F.lit(most)))
    for r in ("r_score", "r_hole", "r_guard"):
        fields = fields.withColumn(r, F.when((F.col("w") <= (top.w or 0)) & (F.col("h") <= (top.h or 0)), F.col(r)).otherwise(F.lit(-1)))
    found = cut(surfaces(pages, sizes, fields), "surfaces")
    group = [*KEYS, "ordinal", "grp"]
    side = 2 * F.col("radius") + 1
    searched = found.where("radius > 0").withColumn("place", F.explode(F.sequence(F.lit(0), side * side - 1)))
    candidates = searched.groupBy(*group, "place", "radius").agg(F.array_sort(F.collect_list(F.struct("option", F.get("ring", F.col("place")).alias("ring"), F.get("guard", F.col("place")).alias("guard")))).alias("o"))
    candidates = candidates.select(*group, (F.col("place") % side - F.col("radius")).cast("int").alias("dx"), (F.floor(F.col("place") / side) - F.col("radius")).cast("int").alias("dy"), F.transform("o", lambda x: x["ring"]).alias("fills"), F.transform("o", lambda x: x["guard"]).alias("guards"))
    limit = questions.select("template_id", "page_index", "ordinal", F.col("settings.fillThreshold").alias("threshold"))
    candidates = candidates.join(limit, ["template_id", "page_index", "ordinal"])
    best = alignment.best_offsets(candidates, [*group, "threshold"], F.col("threshold")).drop("threshold")
    placed = found.join(best, group, "left").withColumns({"dx": F.coalesce("dx", F.lit(0)), "dy": F.coalesce("dy", F.lit(0))})
    at = (F.col("dy") + F.col("radius")) * side + F.col("dx") + F.col("radius")
    per_question = placed.groupBy(*KEYS, "ordinal").agg(F.array_sort(F.collect_list(F.struct("option", F.get("score", at).alias("fill"), "dx", "dy"))).alias("o"))
    return per_question.select(*KEYS, "ordinal", F.col("o.fill").alias("fills"), F.col("o.dx").alias("dxs"), F.col("o.dy").alias("dys"))


def measured(pages: DataFrame, questions: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(KEYS, ordinal, question, settings, fills, dxs, dys, error): a row per page and question; a page that can't be marked is one row with its error.

    pages: (KEYS, binary); questions: as templates.questions gives them, few beside the pages; sizes: page_sizes of the pages, where
    they come cheaper than from these.
    """
    questions = cut(questions.select("template_id", "page_index", "ordinal", "question", "settings"), "questions")
    sizes = cut(page_sizes(pages) if sizes is None else sizes, "page-sizes")
    fills = option_fills(pages, sizes, questions)
    rows = join_small(sizes, questions, ["template_id", "page_index"]).join(fills, [*KEYS, "ordinal"], "left")
    good = F.col("error").isNull() & F.col("ordinal").isNotNull()
    error = F.coalesce("error", F.when(F.col("ordinal").isNull(), NO_QUESTIONS)).alias("error")
    some = {"ordinal": F.col("ordinal"), "question": F.col("question"), "settings": F.col("settings"), "fills": F.coalesce("fills", F.array().cast("array<double>")), "dxs": F.coalesce("dxs", F.array().cast("array<int>")), "dys": F.coalesce("dys", F.array().cast("array<int>"))}
    answered = rows.where(good).select(*KEYS, *[c.alias(name) for name, c in some.items()], error)
    kinds = {f.name: f.dataType for f in answered.schema.fields}
    # a page's error is one row, however many questions it should have had
    bad = rows.where(~good).select(*KEYS, error).distinct()
    return answered.unionByName(bad.select(*KEYS, *[F.lit(None).cast(kinds[name]).alias(name) for name in some], "error"))
