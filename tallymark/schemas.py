"""Types of templates, stored rows and results."""

from pyspark.sql import types as T


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STR, INT, LONG, DBL, BOOL, BIN, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.BinaryType(), T.TimestampType()

MATRIX = _s(("rows", INT), ("cols", INT), ("type", INT), ("data", BIN))
POINT = _s(("x", INT), ("y", INT))
OPTION = _s(("label", STR), ("x", INT), ("y", INT), ("baselineBias", DBL))
QUESTION = _s(("id", STR), ("bubbleWidth", INT), ("bubbleHeight", INT), ("type", STR), ("options", T.ArrayType(OPTION)))
MARKING_CONFIG = _s(
    ("fillThreshold", DBL), ("selectionThreshold", DBL), ("bubbleInset", DBL), ("flagThreshold", DBL),
    ("searchRadius", INT), ("searchGroupSize", INT), ("groupSearchRadius", INT), ("labelInset", DBL),
)
MARKING_PAGE = _s(("questions", T.ArrayType(QUESTION)))
#: `questions` is the older form: one page without a list of pages.
MARKING_TEMPLATE = _s(("config", MARKING_CONFIG), ("pages", T.ArrayType(MARKING_PAGE)), ("questions", T.ArrayType(QUESTION)))
ANCHOR = _s(("image", STR), ("center", POINT), ("roi", _s(("min", POINT), ("max", POINT))))
PREPROCESSING_CONFIG = _s(("blurSize", INT), ("morphCloseSize", INT), ("minAnchorConfidence", DBL), ("adaptiveBlockSize", INT), ("adaptiveC", DBL), ("referenceRatio", DBL))
PREPROCESSING_TEMPLATE = _s(("width", INT), ("height", INT), ("config", PREPROCESSING_CONFIG), ("pages", T.ArrayType(_s(("anchors", T.ArrayType(ANCHOR))))))
MARKING_JOB = _s(("template", STR), ("scans", T.ArrayType(STR)))

TABLES = {
    "marking_templates": _s(("id", STR), ("json", STR)),
    "preprocessing_templates": _s(("id", STR), ("json", STR)),
    "anchors": _s(("id", STR), ("template_id", STR), ("page_index", INT), ("anchor_index", INT), ("matrix", MATRIX)),
    "scans": _s(("id", STR), ("preprocessing_template_id", STR), ("created_at_unix_ms", LONG)),
    "scan_pages": _s(("id", STR), ("picture_key", STR), ("page_index", INT), ("scan_id", STR), ("binary", MATRIX), ("picture", MATRIX)),
}

MARK = _s(("questionId", STR), ("flagged", BOOL), ("selected", T.ArrayType(STR)), ("confidence", DBL))


def with_fields(schema: T.StructType, drop: tuple[str, ...] = (), **fields: T.DataType) -> T.StructType:
    """A schema without some columns and with others behind, all of which may be null."""
    kept = [T.StructField(f.name, f.dataType) for f in schema.fields if f.name not in drop]
    return T.StructType([*kept, *[T.StructField(name, kind) for name, kind in fields.items()]])
