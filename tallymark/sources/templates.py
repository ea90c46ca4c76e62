"""Template documents: JSON text to typed rows, and to one row per page, question or option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def _names(kind: T.DataType) -> list[str]:
    if isinstance(kind, T.StructType):
        return [n for f in kind.fields for n in (f.name, *_names(f.dataType))]
    return _names(kind.elementType) if isinstance(kind, T.ArrayType) else []


def field_case(text: Column, kind: T.DataType) -> Column:
    """JSON with the field names of a type in its own spelling: names match without regard to case."""
    for name in dict.fromkeys(_names(kind)):
        text = F.regexp_replace(text, rf'(?i)(?<!\\)"{name}"(\s*:)', f'"{name}"$1')
    return text


def parse(rows: DataFrame, kind: T.StructType, json_col: str = "json", out: str = "template") -> DataFrame:
    """Adds the document, and `malformed` where the text isn't one. Unknown fields are passed over."""
    with_bad = T.StructType([*kind.fields, T.StructField("_malformed", T.StringType())])
    read = F.from_json(field_case(F.col(json_col), kind), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    rows = rows.withColumn("_read", read)
    fields = [F.col("_read")[f.name].alias(f.name) for f in kind.fields]
    bad = F.col(json_col).isNull() | F.col("_read").isNull() | F.col("_read._malformed").isNotNull()
    return rows.withColumn("malformed", bad).withColumn(out, F.when(~F.col("malformed"), F.struct(*fields))).drop("_read")


def normal_pages(template: str = "template") -> Column:
    """The pages of a marking template; the older form with questions alone is one page."""
    t = F.col(template)
    one = F.array(F.struct(t["questions"].alias("questions")))
    return F.when(F.coalesce(F.size(t["pages"]), F.lit(0)) > 0, t["pages"]).when(F.coalesce(F.size(t["questions"]), F.lit(0)) > 0, one).otherwise(F.array().cast(T.ArrayType(schemas.MARKING_PAGE)))


#: What the engine takes for settings that a template leaves out. On the wire they are 0, but for two.
ENGINE_DEFAULTS = {"fillThreshold": 0.25, "bubbleInset": 0.75, "flagThreshold": 0.5, "searchRadius": 0, "searchGroupSize": 0, "groupSearchRadius": 0, "labelInset": 0.4}


def settings(template: str = "template", strict_wire: bool = False) -> Column:
    """A template's settings without nulls; the selection threshold falls back to the fill threshold."""
    c = F.col(template)["config"]
    default = {k: 0 if strict_wire and k != "labelInset" else v for k, v in ENGINE_DEFAULTS.items()}
    fields = {k: F.coalesce(c[k], F.lit(v)) for k, v in default.items()}
    fields["selectionThreshold"] = F.coalesce(c["selectionThreshold"], fields["fillThreshold"])
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def _or_zero(c: Column, kind: T.DataType) -> Column:
    return F.coalesce(c, F.lit(0).cast(kind))


#: Places and sizes of bubbles are held to this many pixels, so that sums of them are whole numbers of 32 bits.
MOST_PIXELS = 1 << 24


def _pixels(c: Column) -> Column:
    return F.greatest(F.lit(-MOST_PIXELS), F.least(F.lit(MOST_PIXELS), _or_zero(c, T.IntegerType())))


def whole_question(q: Column) -> Column:
    """A question as on the wire: what is left out is 0, an empty text, or no options."""
    option = lambda o: F.struct(F.coalesce(o["label"], F.lit("")).alias("label"), *[_pixels(o[c]).alias(c) for c in ("x", "y")], _or_zero(o["baselineBias"], T.DoubleType()).alias("baselineBias"))
    options = F.transform(F.filter(F.coalesce(q["options"], F.array().cast(T.ArrayType(schemas.OPTION))), lambda o: o.isNotNull()), option)
    return F.struct(F.coalesce(q["id"], F.lit("")).alias("id"), *[_pixels(q[c]).alias(c) for c in ("bubbleWidth", "bubbleHeight")], F.coalesce(q["type"], F.lit("")).alias("type"), options.alias("options"))


def whole_preprocessing(t: Column) -> Column:
    """A preprocessing template as on the wire: what is left out is 0, an empty text, or none."""
    point = lambda p: F.struct(*[_or_zero(p[c], T.IntegerType()).alias(c) for c in ("x", "y")])
    roi = lambda r: F.struct(point(r["min"]).alias("min"), point(r["max"]).alias("max"))
    anchor = lambda a: F.struct(F.coalesce(a["image"], F.lit("")).alias("image"), point(a["center"]).alias("center"), roi(a["roi"]).alias("roi"))
    config = F.struct(*[_or_zero(t["config"][f.name], f.dataType).alias(f.name) for f in schemas.PREPROCESSING_CONFIG.fields])
    pages = F.coalesce(t["pages"], F.array().cast(schemas.PREPROCESSING_TEMPLATE["pages"].dataType))
    page = lambda p: F.struct(F.transform(F.coalesce(p["anchors"], F.array().cast(T.ArrayType(schemas.ANCHOR))), anchor).alias("anchors"))
    whole = F.struct(*[_or_zero(t[c], T.IntegerType()).alias(c) for c in ("width", "height")], config.alias("config"), F.transform(pages, page).alias("pages"))
    return F.when(t.isNotNull(), whole)


def preprocessing_page(t: Column, page_index: Column) -> Column:
    """One page of a preprocessing template as (width, height, config, anchors), what is left out as 0; null without such a page."""
    whole = whole_preprocessing(t)
    page = F.get(whole["pages"], page_index)
    anchors = F.transform(page["anchors"], lambda a: F.struct(a["center"].alias("center"), a["roi"].alias("roi")))
    return F.when(page.isNotNull(), F.struct(whole["width"].alias("width"), whole["height"].alias("height"), whole["config"].alias("config"), anchors.alias("anchors")))


def preprocessing_pages(templates: DataFrame) -> DataFrame:
    """(template_id, template_page, n_places, page_of_template, patterns): a row per page of templates (template_id, template, grid) as the store's grids come."""
    n = F.size("template.pages")
    each = templates.where(n > 0).select("template_id", "template", "grid", n.alias("n_places"), F.explode(F.sequence(F.lit(0), n - 1)).alias("template_page"))
    return each.select("template_id", "template_page", "n_places", preprocessing_page(F.col("template"), F.col("template_page")).alias("page_of_template"), F.get("grid", F.col("template_page")).alias("patterns"))


def whole_marking(t: Column) -> Column:
    """A marking template as on the wire, pages in the newer form: what is left out is 0, an empty text, or none, but for the selection threshold."""
    config = F.struct(*[(t["config"][f.name] if f.name in ("selectionThreshold", "labelInset") else _or_zero(t["config"][f.name], f.dataType)).alias(f.name) for f in schemas.MARKING_CONFIG.fields])
    pages = F.coalesce(t["pages"], F.array().cast(T.ArrayType(schemas.MARKING_PAGE)))
    page = lambda p: F.struct(F.transform(F.coalesce(p["questions"], F.array().cast(T.ArrayType(schemas.QUESTION))), whole_question).alias("questions"))
    return F.when(t.isNotNull(), F.struct(config.alias("config"), F.transform(pages, page).alias("pages")))


def questions(templates: DataFrame, id_col: str = "id", template: str = "template", strict_wire: bool = False) -> DataFrame:
    """(template_id, page_index, ordinal, question, settings): a row per question, its missing numbers as 0."""
    pages = templates.select(F.col(id_col).alias("template_id"), settings(template, strict_wire).alias("settings"), F.posexplode(normal_pages(template)).alias("page_index", "page"))
    rows = pages.select("template_id", "settings", "page_index", F.posexplode("page.questions").alias("ordinal", "q")).where(F.col("q").isNotNull())
    return rows.select("template_id", "settings", "page_index", "ordinal", whole_question(F.col("q")).alias("question"))


def options(templates: DataFrame, id_col: str = "id", template: str = "template") -> DataFrame:
    """(template_id, page_index, ordinal, question_id, option_index, option): a row per option."""
    q = questions(templates, id_col, template)
    return q.select("template_id", "page_index", "ordinal", F.col("question.id").alias("question_id"), F.posexplode("question.options").alias("option_index", "option"))
