"""Template rules as rows: every violation with its place, and each document's first.

Documents are checked in their own order: configuration, pages, questions, options. `position` sorts violations the
same way, so the smallest is the one a reader would meet first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_blank
from .affine import let


def _rule(stage: Column, bad: Column, message: Column | str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(stage.alias("position"), text.alias("message")))


def _place(*parts) -> Column:
    """Numbers of a place in the document, level by level."""
    return F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("int") for p in parts])


def _outside(c: Column) -> Column:
    return (c < 0) | (c > 1)


# The texts of messages are those that clients of the original read


def _each(items: Column, check) -> Column:
    """The violations that `check` gives for each item and its index; none where there are no items."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), check))


def _broken(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def _option_rules(o: Column, k: Column, others: Column, page: Column, question: Column, at: Column) -> Column:
    place = lambda rule: _place(2, page, question, 5, k, rule)
    where = F.concat(at, F.lit("options["), k.cast("string"), F.lit("]: "))
    earlier = F.exists(F.slice(others, 1, k), lambda x: x["label"].eqNullSafe(o["label"]))
    return _broken(
        _rule(place(0), earlier, F.concat(at, F.lit('duplicate option label "'), F.coalesce(o["label"], F.lit("")), F.lit('"'))),
        _rule(place(1), is_blank(o["label"]), F.concat(where, F.lit("label cannot be empty"))),
        _rule(place(2), o["x"] < 0, F.concat(where, F.lit("x must be non-negative"))),
        _rule(place(3), o["y"] < 0, F.concat(where, F.lit("y must be non-negative"))),
    )


def _question_rules(q: Column, question: Column, page: Column, before: Column) -> Column:
    at = F.concat(before, F.lit("questions["), question.cast("string"), F.lit("]: "))
    place = lambda rule: _place(2, page, question, rule)
    own = _broken(
        _rule(place(1), q["bubbleWidth"] <= 0, F.concat(at, F.lit("bubbleWidth must be positive"))),
        _rule(place(2), q["bubbleHeight"] <= 0, F.concat(at, F.lit("bubbleHeight must be positive"))),
        _rule(place(3), ~F.coalesce(q["type"], F.lit("")).isin("", "single", "multi"), F.concat(at, F.lit("type must be multi, single, or omitted"))),
        _rule(place(4), F.coalesce(F.size(q["options"]), F.lit(0)) < 1, F.concat(at, F.lit("question must contain at least one option"))),
    )
    return F.concat(own, _each(q["options"], lambda o, k: _option_rules(o, k, q["options"], page, question, at)))


def _page_rules(p: Column, page: Column) -> Column:
    at = F.concat(F.lit("pages["), page.cast("string"), F.lit("]: "))
    empty = _broken(_rule(_place(2, page), F.coalesce(F.size(p["questions"]), F.lit(0)) < 1, F.concat(at, F.lit("questions must contain at least one question"))))
    return F.concat(empty, _each(p["questions"], lambda q, k: _question_rules(q, k, page, at)))


def _repeated_ids(pages: Column) -> Column:
    """Questions whose id an earlier one of the document has, on any of its pages: each is beside it once they are sorted."""
    questions = lambda p, page: F.transform(F.coalesce(p["questions"], F.array()), lambda q, k: F.struct(F.coalesce(q["id"], F.lit("")).alias("qid"), page.alias("page"), k.alias("question")))
    message = lambda x: F.concat(F.lit("pages["), x["page"].cast("string"), F.lit(']: duplicate question id "'), x["qid"], F.lit('"'))
    twice = lambda some: _each(some, lambda x, k: _broken(_rule(_place(2, x["page"], x["question"], 0), (k > 0) & (F.get(some, k - 1)["qid"] == x["qid"]), message(x))))
    return let(F.array_sort(F.flatten(F.transform(F.coalesce(pages, F.array()), questions))), twice)


def marking_rules(t: Column) -> Column:
    """The broken rules of a marking template, as an array of (position, message)."""
    config = t["config"]
    checks = [(name, _outside(config[name]), "must be between 0 and 1") for name in ("fillThreshold", "selectionThreshold", "bubbleInset", "flagThreshold")]
    checks += [(name, config[name] < 0, "must be nonnegative") for name in ("searchRadius", "searchGroupSize", "groupSearchRadius")]
    rules = [_rule(_place(0, k), bad, f"config: {name} {text}") for k, (name, bad, text) in enumerate(checks)]
    rules.append(_rule(_place(1), F.coalesce(F.size(t["pages"]), F.lit(0)) < 1, "pages must contain at least one page"))
    return F.concat(_broken(*rules), _each(t["pages"], _page_rules), _repeated_ids(t["pages"]))


def _listed(templates: DataFrame, rules: Column, id_col: str) -> DataFrame:
    return templates.select(id_col, F.explode(rules).alias("r")).select(id_col, "r.position", "r.message")


def marking_violations(templates: DataFrame, id_col: str = "id", template: str = "template") -> DataFrame:
    """(id, position, message) of marking templates; a row for each broken rule. All of a document's rules are one projection."""
    return _listed(templates, marking_rules(F.col(template)), id_col)


def out_of_bounds(point: Column, width: Column, height: Column) -> Column:
    """Whether a point lies outside a page; its edge is inside."""
    return ~(point["x"].between(0, width) & point["y"].between(0, height))


def preprocessing_rules(t: Column, all_anchors: bool = False) -> Column:
    """The broken rules of a preprocessing template, as an array of (position, message).

    Only each page's first anchor is held against the page's bounds, unless `all_anchors` is set.
    """
    c = t["config"]
    block = F.coalesce(c["adaptiveBlockSize"], F.lit(0))
    checks = [
        (t["width"] <= 0, "width must be positive"),
        (t["height"] <= 0, "height must be positive"),
        (c["blurSize"] <= 0, "blurSize must be positive"),
        (c["blurSize"] % 2 == 0, "blurSize must be odd"),
        (c["morphCloseSize"] < 0, "morphCloseSize must be nonnegative"),
        ((c["minAnchorConfidence"] <= 0) | (c["minAnchorConfidence"] >= 1), "minAnchorConfidence must be in (0, 1)"),
        (F.coalesce(F.size(t["pages"]), F.lit(0)) < 1, "at least one page must be included"),
        (block == 0, "adaptiveBlockSize is required"),
        (block % 2 == 0, "adaptiveBlockSize must be odd"),
        (block <= 0, "adaptiveBlockSize must be positive"),
    ]
    whole = _broken(*[_rule(_place(0, k), bad, text) for k, (bad, text) in enumerate(checks)])

    def of_page(p: Column, page: Column) -> Column:
        few = _broken(_rule(_place(1, page, -1), F.coalesce(F.size(p["anchors"]), F.lit(0)) < 3, "each page must have at least 3 anchors"))

        def of_anchor(a: Column, anchor: Column) -> Column:
            held = a if all_anchors else F.get(p["anchors"], F.lit(0))
            return _broken(
                _rule(_place(1, page, anchor, 0), F.coalesce(a["image"], F.lit("")) == "", "images must be set for each anchor"),
                *[_rule(_place(1, page, anchor, k), out_of_bounds(x, t["width"], t["height"]), f"{name} is out of bounds") for k, (name, x) in enumerate((("center", held["center"]), ("roi.min", held["roi"]["min"]), ("roi.max", held["roi"]["max"])), 1)],
            )

        return F.concat(few, _each(p["anchors"], of_anchor))

    return F.concat(whole, _each(t["pages"], of_page))


def preprocessing_violations(templates: DataFrame, id_col: str = "id", template: str = "template", all_anchors: bool = False) -> DataFrame:
    """(id, position, message) of preprocessing templates; a row for each broken rule."""
    return _listed(templates, preprocessing_rules(F.col(template), all_anchors), id_col)


def first_and_count(templates: DataFrame, rules: Column, id_col: str = "id") -> DataFrame:
    """(id, message, violations) of the documents that break one of `rules`: the first in document order, and how many there are.

    Both are worked out in a document's own row, so that one slim row of it is shuffled. Rows are dealt by id before they
    are grouped: texts are grouped by sorting, and the rows of a whole file would be sorted where it is read.
    """
    found = let(rules, lambda r: F.struct(F.array_min(r).alias("first"), F.size(r).cast("long").alias("n")))
    rows = templates.select(id_col, found.alias("found")).repartition(id_col)
    counted = rows.groupBy(id_col).agg(F.min("found.first").alias("first"), F.sum("found.n").alias("violations"))
    return counted.where("violations > 0").select(id_col, "first.message", "violations")


def first_violations(violations: DataFrame, id_col: str = "id") -> DataFrame:
    """Each document's first violation, in document order."""
    return violations.groupBy(id_col).agg(F.min(F.struct("position", "message")).alias("first")).select(id_col, "first.message")


def job_violations(jobs: DataFrame, template: str = "template", scans: str = "scans") -> Column:
    """What is wrong with a marking job; null if nothing is."""
    return F.when(F.coalesce(F.col(template), F.lit("")) == "", "template is required").when(F.col(scans).isNull() | (F.size(scans) < 1), "scans must contain at least one id").when(F.exists(scans, lambda s: F.coalesce(s, F.lit("")) == ""), "scan ids cannot be empty")
