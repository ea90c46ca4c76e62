"""The library's operators on the driver's tables, by name, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import alignment, geometry, marking, pages, raster, results, validation
from ..sources import matrices, store, templates
from ..sources.cuts import cut
from ..streaming import jobs
from . import marking_job, scanning, snippets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- marking: a question is a row of embeddings, its options' fills are the components' sizes


def sheet(spark: SparkSession, sf_dir: str, k: int, kind: str = "single", scale: float = 3.0) -> DataFrame:
    """Questions of k options; the first letter of their ids tells the Q kind from others."""
    fills = F.transform(F.slice("embedding", 1, k), lambda x: F.abs(x.cast("double")) * scale)
    kinds = F.when(F.col("vec_id") % 2 == 0, "multi").otherwise("single") if kind == "both" else F.lit(kind)
    ids = F.concat(F.when(F.col("vec_id") % 3 == 0, "L").otherwise("Q"), F.col("vec_id").cast("string"))
    labels = F.array(*[F.lit(f"o{i}") for i in range(k)])
    return t(spark, sf_dir, "embeddings").select("vec_id", ids.alias("question_id"), kinds.alias("type"), labels.alias("labels"), fills.alias("fills"), (F.col("label").cast("double") / 100).alias("shift"))


def sheet_sql(k: int, kind: str = "single", scale: float = 3.0, bias: bool = False) -> str:
    kinds = "CASE WHEN vec_id % 2 = 0 THEN 'multi' ELSE 'single' END" if kind == "both" else f"'{kind}'"
    shift = " - CAST(label AS DOUBLE) / 100 * (i % 3)" if bias else ""
    return f"""src AS (
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'L' ELSE 'Q' END || vec_id AS qid, {kinds} AS kind,
         list_transform(range(0, {k}), lambda i: 'o' || i) AS labels,
         list_transform(range(0, {k}), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE)) * {scale}{shift}) AS f FROM embeddings
)"""


def mark_sql(source: str, out: str, threshold: float = 0.1, flag: float = 0.5) -> str:
    return f"""WITH {source},
s1 AS (SELECT *, list_sort(f) AS s, len(f) AS n FROM src),
s2 AS (SELECT *, CASE WHEN kind = 'multi' THEN 1 ELSE greatest(1, n - least(4, n) + 1) END AS lo FROM s1),
s3 AS (SELECT *, list_transform(range(lo, n), lambda i: s[i + 1] - s[i]) AS gaps FROM s2),
s4 AS (SELECT *, greatest(0.0, coalesce(list_max(gaps), 0.0)) AS gap FROM s3),
s5 AS (SELECT *, CASE WHEN gap > 0 THEN s[lo + list_position(gaps, gap) - 1] ELSE s[n] END AS split FROM s4),
s6 AS (SELECT *, list_filter(f, lambda x: x <= split) AS low FROM s5),
s7 AS (SELECT *, list_reduce(low, lambda a, x: a + x) / len(low) AS mean FROM s6),
s8 AS (SELECT *, mean > 0.75 AS all_filled, CASE WHEN mean > 0.75 THEN 0.0 ELSE mean END AS baseline FROM s7),
s9 AS (SELECT *, list_transform(f, lambda x: x - baseline) AS adj FROM s8),
s10 AS (SELECT *, list_transform(adj, lambda a: (NOT all_filled AND gap >= {threshold} AND a > split - baseline) OR (all_filled AND a >= 0.5)) AS chosen FROM s9),
s11 AS (SELECT *, list_filter(range(1, n + 1), lambda i: chosen[i]) AS yes, list_filter(range(1, n + 1), lambda i: NOT chosen[i]) AS no FROM s10),
s12 AS (
  SELECT *, len(yes) AS n_selected, array_to_string(list_transform(yes, lambda i: labels[i]), ',') AS selected,
         greatest(0.0, list_max(adj)) AS high, greatest(0.0, coalesce(list_max(list_transform(no, lambda i: adj[i])), 0.0)) AS other,
         list_min(list_transform(yes, lambda i: adj[i])) AS least FROM s11
), s13 AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN n_selected = 0 THEN 1 - high WHEN all_filled THEN least ELSE (least - other) / (s[n] - baseline) END)) AS confidence FROM s12),
s14 AS (SELECT *, confidence < {flag} OR (n_selected = 0 AND starts_with(qid, 'Q')) OR (kind <> 'multi' AND n_selected > 1) AS flag FROM s13)
SELECT vec_id, {out} FROM s14"""


def marked(df: DataFrame, **options) -> DataFrame:
    return marking.mark(df, selection_threshold=0.1, flag_threshold=0.5, **options).withColumn("n_selected", F.size("selected").cast("long")).withColumn("selected", F.array_join("selected", ","))


_ANSWER = "selected, n_selected, confidence, flag"


@query(mark_sql(sheet_sql(5, "both"), _ANSWER))
def mark_answers(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 5, "both")).select("vec_id", "selected", "n_selected", "confidence", "flag")


@query(mark_sql(sheet_sql(5), "gap, split, selected"))
def mark_single_gap(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 5)).select("vec_id", "gap", "split", "selected")


@query(mark_sql(sheet_sql(26), _ANSWER))
def mark_wide_row(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 26)).select("vec_id", "selected", "n_selected", "confidence", "flag")


@query(mark_sql(sheet_sql(8, "multi"), "gap, split, selected, n_selected"))
def mark_multi_gap(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 8, "multi")).select("vec_id", "gap", "split", "selected", "n_selected")


@query(mark_sql(sheet_sql(5, "both", bias=True), "baseline, selected, confidence"))
def mark_bias(spark, sf_dir):
    df = sheet(spark, sf_dir, 5, "both").withColumn("bias", F.transform("labels", lambda _, i: F.col("shift") * (i % 3)))
    return marked(df, bias="bias").select("vec_id", "baseline", "selected", "confidence")


@query(mark_sql(sheet_sql(4, "both"), "baseline, confidence"))
def mark_confidence(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 4, "both")).select("vec_id", "baseline", "confidence")


@query(mark_sql(sheet_sql(3, "both"), "n_selected, flag"))
def mark_flag(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 3, "both")).select("vec_id", "n_selected", "flag")


@query(mark_sql(sheet_sql(5, "both", 30.0), "all_filled, selected, confidence, flag"))
def mark_all_filled(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 5, "both", 30.0)).select("vec_id", "all_filled", "selected", "confidence", "flag")


@query(mark_sql(sheet_sql(1, "both", 8.0), "gap, all_filled, n_selected, confidence, flag"))
def mark_single_option(spark, sf_dir):
    return marked(sheet(spark, sf_dir, 1, "both", 8.0)).select("vec_id", "gap", "all_filled", "n_selected", "confidence", "flag")


@query("""
WITH s AS (SELECT user_id, value AS v, lag(value) OVER w AS b, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
r AS (SELECT *, coalesce(v - b, 0.0) AS g, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(v - b, 0.0) DESC, k) AS rn, max(v) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, g AS gap, CASE WHEN g > 0 THEN coalesce(b, v) ELSE top END AS split, n FROM r WHERE rn = 1""")
def mark_events_gap(spark, sf_dir):
    return marking.gaps_by_window(t(spark, sf_dir, "events"), "user_id", "value", "event_id")


# --- alignment and geometry


@query("""
WITH c AS (SELECT vec_id // 25 AS q, CAST(vec_id % 5 - 2 AS INT) AS dx, CAST(vec_id // 5 % 5 - 2 AS INT) AS dy, list_sort(list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE)) * 3)) AS f, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE)) * 3) AS o FROM embeddings),
v AS (SELECT q, dx, dy, greatest(f[2] - f[1], f[3] - f[2], f[4] - f[3], 0.0) AS gap FROM c WHERE f[1] >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gap DESC, (dx = 0 AND dy = 0) DESC, dy, dx) AS rn FROM v),
g AS (SELECT q, dx, dy, list_reduce(o, lambda a, x: a + x) AS ink FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ink DESC, (dx = 0 AND dy = 0) DESC, dy, dx) AS rn FROM g)
SELECT s.q, CASE WHEN r.gap >= 0.85 THEN r.dx WHEN s.ink / 4 > 0.5 THEN s.dx ELSE 0 END AS dx, CASE WHEN r.gap >= 0.85 THEN r.dy WHEN s.ink / 4 > 0.5 THEN s.dy ELSE 0 END AS dy
FROM s LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (q) WHERE s.rn = 1""")
def align_argmax(spark, sf_dir):
    fills = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")) * 3)
    at = t(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("q"), (F.col("vec_id") % 5 - 2).cast("int").alias("dx"), (F.floor(F.col("vec_id") / 5) % 5 - 2).cast("int").alias("dy"), fills.alias("fills"), fills.alias("guards"))
    return alignment.best_offsets(at, ["q"], 0.85)


@query("""
WITH p AS (SELECT p_partkey, 1 + p_size % 26 AS n, p_size % 7 AS g FROM part)
SELECT p_partkey, i AS option, CAST(CASE WHEN g > 0 AND g < n THEN i // g ELSE 0 END AS INT) AS grp, CASE WHEN g > 0 AND g < n THEN 2 ELSE 8 END AS radius
FROM (SELECT *, unnest(range(0, n)) AS i FROM p)""")
def group_offsets(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") % 26).alias("n"), (F.col("p_size") % 7).alias("g"), F.lit(8).alias("r"), F.lit(2).alias("gr"))
    rows = p.select("p_partkey", F.explode(alignment.row_offsets("n", "g", "r", "gr")).alias("o"))
    return rows.select("p_partkey", F.col("o.option").cast("long").alias("option"), F.col("o.group").alias("grp"), "o.radius")


def bubbles(spark, sf_dir) -> DataFrame:
    """Questions of parts: five bubbles in a row."""
    one = lambda i: F.struct(F.lit("ABCDE"[i]).alias("label"), (F.col("p_size") * 3 + 40 * i + (F.col("p_partkey") % 7).cast("int")).alias("x"), (F.col("p_size") * 5 + (F.col("p_partkey") % (i + 2)).cast("int")).alias("y"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array(*[one(i) for i in range(5)]).alias("options"), (15 + F.col("p_size") % 12).alias("w"), (17 + F.col("p_size") % 9).alias("h"), F.array(*[((F.col("p_partkey") % (i + 3)).cast("int") - 1) for i in range(5)]).alias("dxs"), F.array(*[((F.col("p_partkey") % (i + 2)).cast("int") - 1) for i in range(5)]).alias("dys"))


BUBBLES_SQL = """
b AS (
  SELECT p_partkey, i, 15 + p_size % 12 AS w, 17 + p_size % 9 AS h, substr('ABCDE', i + 1, 1) AS label,
         p_size * 3 + 40 * i + p_partkey % 7 AS x, p_size * 5 + p_partkey % (i + 2) AS y, p_partkey % (i + 3) - 1 AS dx, p_partkey % (i + 2) - 1 AS dy
  FROM part, (SELECT unnest(range(0, 5)) AS i)
)"""


@query(f"""WITH {BUBBLES_SQL}
SELECT p_partkey, label, label IN ('B', 'D') AS selected, CAST(x + dx - w // 2 AS INT) AS x, CAST(y + dy - h // 2 AS INT) AS y, CAST(w AS INT) AS width, CAST(h AS INT) AS height FROM b""")
def option_boxes(spark, sf_dir):
    rows = bubbles(spark, sf_dir).withColumn("chosen", F.array(F.lit("B"), F.lit("D")))
    return rows.select("p_partkey", F.explode(geometry.option_boxes("options", "w", "h", "chosen", "dxs", "dys")).alias("b")).select("p_partkey", "b.*")


@query(f"""WITH {BUBBLES_SQL}
SELECT p_partkey, CAST(min(x + dx - w // 2) AS INT) AS x, CAST(min(y + dy - h // 2) AS INT) AS y,
       CAST(max(x + dx + w // 2) - min(x + dx - w // 2) AS INT) AS width, CAST(max(y + dy + h // 2) - min(y + dy - h // 2) AS INT) AS height FROM b GROUP BY p_partkey""")
def question_bounds(spark, sf_dir):
    return bubbles(spark, sf_dir).select("p_partkey", geometry.question_bounds("options", "w", "h", "dxs", "dys").alias("b")).select("p_partkey", "b.*")


@query(f"""WITH {BUBBLES_SQL}
SELECT p_partkey, CAST(min(x - w // 2) - 10 AS INT) AS x, CAST(min(y - h // 2) - 10 AS INT) AS y,
       CAST(greatest(0, max(x + w // 2)) + 10 - (min(x - w // 2) - 10) AS INT) AS width, CAST(greatest(0, max(y + h // 2)) + 10 - (min(y - h // 2) - 10) AS INT) AS height FROM b GROUP BY p_partkey""")
def snippet_bounds(spark, sf_dir):
    return bubbles(spark, sf_dir).select("p_partkey", geometry.snippet_bounds("options", "w", "h").alias("b")).select("p_partkey", "b.*")


# --- pages, store, batches


@query("""
WITH d AS (SELECT page_id AS doc, page_id % 40 AS n, 1 + page_id % 4 AS size FROM pages),
b AS (SELECT *, n // size AS blocks FROM d)
SELECT doc, block, block * size + 1 AS first_page, (block + 1) * size AS last_page, NULL::VARCHAR AS error FROM (SELECT *, unnest(range(0, blocks)) AS block FROM b WHERE n % size = 0)
UNION ALL SELECT doc, NULL, NULL, NULL, 'pages don''t divide into blocks' FROM b WHERE n % size <> 0""")
def page_blocks(spark, sf_dir):
    docs = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), (F.col("page_id") % 40).alias("n"), (1 + F.col("page_id") % 4).alias("size"))
    out = pages.page_blocks(docs, "n", "size", F.lit(3))
    return out.select("doc", "block", F.col("from").alias("first_page"), F.col("thru").alias("last_page"), "error")


@query("""
WITH d AS (SELECT doc_id AS doc, 2 * (n_chars % 60) AS n FROM documents), b AS (SELECT *, n // 2 AS blocks, least(n // 2, 7) AS subsets FROM d WHERE n > 0),
x AS (SELECT *, unnest(range(0, blocks)) AS block FROM b),
y AS (SELECT *, blocks // subsets AS lo, blocks % subsets AS extra FROM x),
z AS (SELECT doc, block, CASE WHEN block < extra * (lo + 1) THEN block // (lo + 1) ELSE extra + (block - extra * (lo + 1)) // lo END AS subset FROM y)
SELECT doc, subset, min(block) * 2 + 1 AS first_page, (max(block) + 1) * 2 AS last_page, count(*) AS blocks FROM z GROUP BY doc, subset""")
def block_subsets(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (2 * (F.col("n_chars") % 60)).alias("n"))
    return pages.page_blocks(docs, "n", F.lit(2), F.lit(7)).groupBy("doc", "subset").agg(F.min("from").alias("first_page"), F.max("thru").alias("last_page"), F.count("*").alias("blocks"))


@query("""
SELECT turn, conv_id, CASE WHEN turn > conv_id % 5 THEN 'the span ends before it starts' WHEN turn < 1 OR conv_id % 5 > 3 THEN 'the span is out of bounds' END AS error FROM conversations""")
def span_errors(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("turn", "conv_id", pages.span_error("turn", F.col("conv_id") % 5, F.lit(3)).alias("error"))


@query("""
WITH p AS (SELECT l_suppkey AS doc, 1 + l_orderkey % 400 AS page FROM lineitem),
s AS (SELECT p_partkey % 100 AS doc, p_partkey AS span, p_size * 9 - 20 AS a, p_size * 9 - 20 + p_partkey % 60 - 5 AS b FROM part),
e AS (SELECT s.*, CASE WHEN a > b THEN 'the span ends before it starts' WHEN a < 1 OR b > coalesce(n_pages, 0) THEN 'the span is out of bounds' END AS error FROM s LEFT JOIN (SELECT doc, max(page) AS n_pages FROM p GROUP BY doc) USING (doc))
SELECT doc, span, a AS first_page, b AS last_page, NULL::VARCHAR AS error, count(*) AS n, CAST(sum(page) AS BIGINT) AS pages FROM e JOIN p USING (doc) WHERE error IS NULL AND page BETWEEN a AND b GROUP BY doc, span, a, b
UNION ALL SELECT doc, span, a, b, error, 1, NULL FROM e WHERE error IS NOT NULL""")
def span_pages(spark, sf_dir):
    held = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (1 + F.col("l_orderkey") % 400).alias("page"))
    start = F.col("p_size").cast("long") * 9 - 20
    spans = t(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("doc"), F.col("p_partkey").alias("span"), start.alias("from"), (start + F.col("p_partkey") % 60 - 5).alias("thru"))
    met = pages.span_pages(spans, held, held.groupBy("doc").agg(F.max("page").alias("n_pages")))
    return met.groupBy("doc", "span", F.col("from").alias("first_page"), F.col("thru").alias("last_page"), "error").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


@query("SELECT conv_id AS template_id, list(role ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def anchors_ordered(spark, sf_dir):
    got = store.lists_in_order(t(spark, sf_dir, "conversations"), "conv_id", ("turn", "role"), "role")
    return got.select(F.col("conv_id").alias("template_id"), F.col("items").alias("roles"), "n")


@query("""
WITH c AS (SELECT conv_id, turn % 3 AS page, string_agg(role || turn, ',' ORDER BY turn, role) AS items, count(*) AS n FROM conversations GROUP BY conv_id, turn % 3)
SELECT conv_id AS template_id, string_agg(items, ';' ORDER BY page) AS grid, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_anchors FROM c GROUP BY conv_id""")
def anchor_grids(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("page"), F.struct("turn", "role").alias("at"), F.concat("role", F.col("turn").cast("string")).alias("item"))
    got = store.grids(rows, "conv_id", "page", "at", "item")
    flat = F.array_join(F.transform("grid", lambda p: F.array_join(p, ",")), ";")
    return got.select(F.col("conv_id").alias("template_id"), flat.alias("grid"), F.size("grid").cast("long").alias("n_pages"), F.size(F.flatten("grid")).cast("long").alias("n_anchors"))


@query("SELECT conv_id, min(turn) AS turn, arg_min(role, (turn, role)) AS role FROM conversations GROUP BY conv_id")
def one_page(spark, sf_dir):
    return store.first_rows(t(spark, sf_dir, "conversations"), "conv_id", ("turn", "role"))


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def template_lookup(spark, sf_dir):
    return store.lookup(t(spark, sf_dir, "nation"), 7, "n_nationkey")


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS created_at_unix_ms FROM events)
SELECT * FROM e WHERE created_at_unix_ms < (SELECT min(created_at_unix_ms) + (max(created_at_unix_ms) - min(created_at_unix_ms)) // 3 FROM e)""")
def scans_before(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at_unix_ms"))
    lo, hi = F.min("created_at_unix_ms"), F.max("created_at_unix_ms")
    limit = e.select((lo + F.floor((hi - lo) / 3)).alias("at"))
    return store.before(e, limit.scalar())


@query("""
WITH old AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM old)""")
def delete_before(spark, sf_dir):
    old = store.before(t(spark, sf_dir, "orders"), F.lit("1995-06-01").cast("timestamp_ntz"), "o_orderdate").select("o_orderkey")
    return store.without(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), old, "l_orderkey")


@query("SELECT (SELECT count(*) FROM conversations) AS anchors, (SELECT count(*) FROM events) AS scans")
def count_store(spark, sf_dir):
    return store.counts(anchors=t(spark, sf_dir, "conversations"), scans=t(spark, sf_dir, "events"))


@query("SELECT source AS part, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def store_bytes(spark, sf_dir):
    return store.usage_of(t(spark, sf_dir, "documents"), F.col("source"), F.octet_length("text"))


@query("""
WITH f AS (SELECT lang AS part, source AS kind, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT part, kind, grouping(part, kind) AS g, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes FROM f GROUP BY GROUPING SETS ((part, kind), (part), ())),
e AS (SELECT max(value) AS peak, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS BIGINT) AS uptime FROM events)
SELECT CASE g WHEN 0 THEN 'kind' WHEN 1 THEN 'part' ELSE 'total' END AS level, part, kind, files, bytes,
CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', bytes / 1073741824.0::DOUBLE) END AS size,
CASE WHEN g = 3 THEN peak END AS peak, CASE WHEN g = 3 THEN uptime END AS uptime FROM g, e""")
def utilization(spark, sf_dir):
    files = t(spark, sf_dir, "documents").select(F.col("lang").alias("part"), F.col("source").alias("kind"), F.octet_length("text").cast("long").alias("bytes"))
    return store.utilization(files, t(spark, sf_dir, "events").select("ts", "value"))


BATCH_SQL = """
WITH r AS (SELECT o_custkey AS job, o_orderkey AS scan_id FROM orders),
p AS (SELECT l_orderkey AS scan_id, count(*) AS n_pages FROM lineitem GROUP BY l_orderkey),
o AS (SELECT job, r.scan_id, coalesce(n_pages, 0) AS n_pages, CASE WHEN n_pages IS NULL THEN 'scan not found' WHEN n_pages <> 4 THEN 'scan has ' || n_pages || ' pages, the template 4' END AS error FROM r LEFT JOIN p USING (scan_id))
"""


def batch(spark, sf_dir) -> DataFrame:
    r = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("scan_id"), F.lit(1).alias("template_id"))
    p = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("page_index"))
    one = spark.range(1, 2).select(F.col("id").cast("int").alias("template_id"), F.lit(4).cast("long").alias("n_pages"))
    return results.requested_scans(r, p.select("scan_id"), p, one)


@query(BATCH_SQL + "SELECT job, scan_id, n_pages, error FROM o")
def mark_batch_errors(spark, sf_dir):
    return batch(spark, sf_dir).select("job", "scan_id", "n_pages", "error")


@query(BATCH_SQL + """SELECT job, CAST(coalesce(sum(n_pages) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS pages_marked, count(*) FILTER (WHERE error IS NULL) AS n_scans, count(error) AS n_errors,
count(*) FILTER (WHERE error IS NULL) = 0 AS failed, min(scan_id) FILTER (WHERE error IS NULL) AS first_scan FROM o GROUP BY job""")
def mark_result_rollup(spark, sf_dir):
    out = results.marking_results(batch(spark, sf_dir))
    return out.select("job", "pages_marked", F.size("scans").cast("long").alias("n_scans"), F.size("errors").cast("long").alias("n_errors"), "failed", F.get("scans", F.lit(0))["scan_id"].alias("first_scan"))


ASSIGN_SQL = """
WITH s AS (SELECT vec_id // 4 AS exam, vec_id % 4 AS page, j AS template_page, abs(embedding[j + 1]) > 0.1 AS ok FROM embeddings, (SELECT unnest(range(0, 4)) AS j)),
f AS (SELECT exam, page, arg_min(template_page, (template_page - page + 4) % 4) FILTER (WHERE ok) AS template_page FROM s GROUP BY exam, page),
c AS (SELECT *, CASE WHEN template_page IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY exam, template_page) END AS n FROM f)
"""


@query(ASSIGN_SQL + """SELECT exam, page, template_page, CASE WHEN min(page) FILTER (WHERE template_page IS NULL) OVER e IS NOT NULL THEN 'unrecognizable page ' || min(page) FILTER (WHERE template_page IS NULL) OVER e
WHEN max(n) OVER e > 1 THEN 'duplicate pages in an exam' END AS error FROM c WINDOW e AS (PARTITION BY exam)""")
def page_assignment(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    scores = e.select(F.floor(F.col("vec_id") / 4).alias("exam"), (F.col("vec_id") % 4).alias("page"), F.posexplode(F.slice("embedding", 1, 4)).alias("j", "x"))
    return pages.assign_pages(scores.select("exam", "page", F.col("j").cast("long").alias("template_page"), F.lit(4).cast("long").alias("n_pages"), (F.abs("x") > F.lit(0.1)).alias("ok")))


def tasks(spark) -> int:
    """Parts that a few keys are dealt to before pages are drawn from them."""
    return 4 * spark.sparkContext.defaultParallelism


def part_keys(spark, sf_dir) -> DataFrame:
    """(p_partkey, p_size), dealt to all cores: a file of parts is small, and what is made of each is not."""
    return t(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(tasks(spark), "p_partkey")


# --- pixels: a drawn sheet for each part, one bubble of four filled, or none, or no page at all


def drawn_pages(spark, sf_dir) -> DataFrame:
    """(scan_id, page_index, binary): parts' sheets; of every seven one is blank, of every ten one is missing its pixels."""

    def sheet_with(mark: int | None) -> dict:
        page = np.zeros((40, 160), dtype=np.uint8)
        if mark is not None:
            x = 20 + 40 * mark
            page[5:35, x - 15 : x + 15][raster.disk(30, 30, 11)] = 255
        return matrices.to_row(page)

    def work(batches):
        sheets = {mark: sheet_with(mark) for mark in (None, 0, 1, 2, 3)}
        drawn = lambda key, size: (key, 0, None if key % 10 == 0 else sheets[size % 4 if key % 7 else None])
        for batch in batches:
            for rows in matrices.portions(map(drawn, batch["scan_id"], batch["p_size"])):
                yield pd.DataFrame(rows, columns=["scan_id", "page_index", "binary"])

    parts = part_keys(spark, sf_dir).select(F.col("p_partkey").alias("scan_id"), "p_size")
    return parts.mapInPandas(work, f"scan_id long, page_index int, binary {schemas.MATRIX.simpleString()}")


#: A drawn exam has a page of three marks and one of four, the anchors of its template.
EXAM_SIDE, EXAM_CORNERS = 160, (((30, 30), (130, 30), (30, 130)), ((30, 30), (130, 30), (130, 130), (80, 80)))


def exam_page(index: int) -> np.ndarray:
    """A gray page of the drawn exam, with another mark in each corner."""
    gray = np.full((EXAM_SIDE, EXAM_SIDE), 230, dtype=np.uint8)
    for k, (x, y) in enumerate(EXAM_CORNERS[index]):
        gray[y - 10 : y + 10, x - 10 : x + 10] = 10
        gray[y - 3 : y + 3 + 3 * k, x - 3 : x + 3] = 230
    return gray


def exam_template(spark) -> DataFrame:
    """(template_id, template, grid) of the drawn exam."""
    config = {"blurSize": 3, "morphCloseSize": 3, "minAnchorConfidence": 0.8, "adaptiveBlockSize": 61, "adaptiveC": 5.0}
    corner = lambda x, y: {"image": "", "center": {"x": x, "y": y}, "roi": {"min": {"x": x - 30, "y": y - 30}, "max": {"x": x + 30, "y": y + 30}}}
    doc = {"width": EXAM_SIDE, "height": EXAM_SIDE, "config": config, "pages": [{"anchors": [corner(x, y) for x, y in some]} for some in EXAM_CORNERS]}
    grid = []
    for i, some in enumerate(EXAM_CORNERS):
        ink = raster.binarize(exam_page(i), 3, 3, 61, 5.0)
        grid.append([matrices.to_row(ink[y - 15 : y + 15, x - 15 : x + 15]) for x, y in some])
    kind = f"template_id string, template {schemas.PREPROCESSING_TEMPLATE.simpleString()}, grid array<array<{schemas.MATRIX.simpleString()}>>"
    return spark.createDataFrame([("exam", doc, grid)], kind)


def drawn_exams(spark, sf_dir) -> DataFrame:
    """(doc, template_id, page, gray): suppliers' documents of two pages, some of them swapped, turned, twice the same, blank, without pixels, or three."""

    def work(batches):
        front, back = exam_page(0), exam_page(1)
        a, b, turned, blank = (matrices.to_row(g) for g in (front, back, front[::-1, ::-1], np.full_like(front, 200)))
        ways = [[a, b], [b, a], [turned, b], [a, a], [a, blank], [None, b], [a, b, a]]
        for batch in batches:
            rows = ((key, "exam", i, g) for key in batch["doc"] for i, g in enumerate(ways[key % len(ways)]))
            for some in matrices.portions(rows):
                yield pd.DataFrame(some, columns=["doc", "template_id", "page", "gray"])

    keys = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc")).repartition(tasks(spark), "doc")
    return keys.mapInPandas(work, f"doc long, template_id string, page int, gray {schemas.MATRIX.simpleString()}")


@query("""
WITH d AS (SELECT s_suppkey AS doc, s_suppkey % 7 AS way, unnest(range(0, CASE WHEN s_suppkey % 7 = 6 THEN 3 ELSE 2 END)) AS page FROM supplier)
SELECT doc, page // 2 AS exam, CAST(page % 2 AS INT) AS place,
CAST(CASE WHEN way = 1 THEN 1 - page WHEN way = 3 THEN 0 WHEN (way = 4 AND page = 1) OR (way = 5 AND page = 0) THEN NULL ELSE page % 2 END AS INT) AS template_page,
CASE way WHEN 3 THEN 'duplicate pages in an exam' WHEN 4 THEN 'unrecognizable page 1' WHEN 5 THEN 'unrecognizable page 0' WHEN 6 THEN '3 pages don''t divide into exams of 2' END AS error,
CASE way WHEN 3 THEN 'order' WHEN 4 THEN 'quality' WHEN 5 THEN 'quality' WHEN 6 THEN 'count' END AS error_class FROM d""")
def scanned_exams(spark, sf_dir):
    return scanning.exam_outcomes(scanning.straighten(drawn_exams(spark, sf_dir), exam_template(spark)))


def sheet_template(spark) -> DataFrame:
    doc = '{"config":{"fillThreshold":0.25},"pages":[{"questions":[{"id":"Q1","bubbleWidth":30,"bubbleHeight":30,"options":[%s]}]}]}' % ",".join(f'{{"label":"{c}","x":{20 + 40 * i},"y":20}}' for i, c in enumerate("ABCD"))
    one = spark.range(1, 2).select(F.lit("sheet").alias("id"), F.lit(doc).alias("json"))
    return templates.parse(one, schemas.MARKING_TEMPLATE).select("id", "template")


@query("""
SELECT p_partkey AS scan_id, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 THEN substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) END AS selected,
CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 7 = 0 END AS flagged, CASE WHEN p_partkey % 10 <> 0 THEN 1.0::DOUBLE END AS confidence,
CASE WHEN p_partkey % 10 = 0 THEN 'page 0: cannot evaluate an empty image' END AS error FROM part""")
def mark_drawn_sheets(spark, sf_dir):
    # stored pages: the job reads them three times, and what asks for ids alone reads no pixels
    pages_ = cut(drawn_pages(spark, sf_dir), "drawn-pages")
    scans = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    requests = scans.select(F.floor(F.col("id") / 40).alias("job"), F.col("id").alias("position"), F.col("id").alias("scan_id"), F.lit("sheet").alias("template_id"))
    _, result = marking_job.run_job(requests, scans, pages_, sheet_template(spark))
    good = result.select(F.explode("scans").alias("s")).select("s.scan_id", F.explode("s.marks").alias("m"))
    good = good.select("scan_id", F.get("m.selected", F.lit(0)).alias("selected"), F.col("m.flagged").alias("flagged"), F.col("m.confidence").alias("confidence"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    bad = result.select(F.explode("errors").alias("e")).select("e.scan_id", none.cast("string").alias("selected"), none.cast("boolean").alias("flagged"), none.cast("double").alias("confidence"), "e.error")
    return good.unionByName(bad)


# --- snippets


@query(f"""WITH {BUBBLES_SQL},
q AS (
  SELECT p_partkey // 40 AS template_id, 'Q' || p_partkey % 25 AS question_id, p_size % 3 AS page_index, p_partkey,
         min(x) - w // 2 - 10 AS x, min(y) - h // 2 - 10 AS y, greatest(0, max(x) + w // 2) + 10 AS x1, greatest(0, max(y) + h // 2) + 10 AS y1
  FROM b JOIN part USING (p_partkey) GROUP BY p_partkey, p_size, w, h
),
o AS (SELECT *, row_number() OVER (PARTITION BY template_id, question_id ORDER BY page_index DESC, p_partkey) AS k FROM q),
p AS (SELECT DISTINCT o_orderkey AS scan_id, unnest(range(0, o_orderkey % 4)) AS page_index FROM orders),
r AS (SELECT l_linenumber AS request, l_orderkey AS scan_id, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey // 40 END AS template_id, 'Q' || l_suppkey % 30 AS question_id FROM lineitem)
SELECT r.request, r.scan_id, r.template_id, r.question_id, CAST(o.page_index AS INT) AS page_index, p.scan_id * 10 + p.page_index AS page_id,
CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x1 - x AS INT) AS width, CAST(y1 - y AS INT) AS height,
CASE WHEN r.template_id NOT IN (SELECT template_id FROM q) THEN 'template not found' WHEN o.k IS NULL THEN 'question not found' WHEN p.scan_id IS NULL THEN 'page not found' END AS error
FROM r LEFT JOIN o ON o.k = 1 AND o.template_id = r.template_id AND o.question_id = r.question_id LEFT JOIN p ON p.scan_id = r.scan_id AND p.page_index = o.page_index""")
def requested_snippets(spark, sf_dir):
    """Templates of 40 parts each, a part's bubbles a question on one of three pages; line items ask for them of orders' scans."""
    options = F.transform("options", lambda o: F.struct(o["label"].alias("label"), o["x"].alias("x"), o["y"].alias("y"), F.lit(0.0).alias("baselineBias")))
    question = F.struct(F.concat(F.lit("Q"), F.col("p_partkey") % 25).alias("id"), F.col("w").alias("bubbleWidth"), F.col("h").alias("bubbleHeight"), F.lit("").alias("type"), options.alias("options"))
    rows = bubbles(spark, sf_dir).join(t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    held = rows.groupBy(F.floor(F.col("p_partkey") / 40).alias("id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", (F.col("p_size") % 3).alias("page"), question.alias("question")))).alias("qs"))
    on_page = lambda p: F.transform(F.filter("qs", lambda q: q["page"] == p), lambda q: q["question"])
    template = F.struct(F.lit(None).cast(schemas.MARKING_CONFIG).alias("config"), F.array(*[F.struct(on_page(p).alias("questions")) for p in range(3)]).alias("pages"), F.lit(None).cast(schemas.MARKING_TEMPLATE["questions"].dataType).alias("questions"))
    stored = t(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("scan_id"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 4 - 1).cast("int"))).alias("page_index"))
    stored = stored.withColumn("id", F.col("scan_id") * 10 + F.col("page_index"))
    asked = t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("request"), F.col("l_orderkey").alias("scan_id"), F.when(F.col("l_linenumber") == 7, F.lit(-1)).otherwise(F.floor(F.col("l_partkey") / 40)).alias("template_id"), F.concat(F.lit("Q"), F.col("l_suppkey") % 30).alias("question_id"))
    return snippets.requested_snippets(asked, stored, held.select("id", template.alias("template")))


# --- templates


@query("""
WITH p AS (SELECT p_partkey AS id, p_size AS s FROM part),
v AS (
  SELECT id, 1 AS k, 'config: fillThreshold must be between 0 and 1' AS message FROM p WHERE s / 40.0 > 1
  UNION ALL SELECT id, 2, 'config: searchRadius must be nonnegative' FROM p WHERE s % 5 - 1 < 0
  UNION ALL SELECT id, 3, 'pages[0]: questions[0]: bubbleWidth must be positive' FROM p WHERE s % 6 - 1 <= 0
  UNION ALL SELECT id, 4, 'pages[0]: questions[0]: type must be multi, single, or omitted' FROM p WHERE s % 3 = 0
  UNION ALL SELECT id, 5, 'pages[0]: questions[0]: options[0]: x must be non-negative' FROM p WHERE s - 7 < 0
  UNION ALL SELECT id, 6, 'pages[0]: questions[0]: duplicate option label "A"' FROM p WHERE s % 4 = 0
  UNION ALL SELECT id, 7, 'pages[0]: duplicate question id "Q1"' FROM p WHERE s % 7 = 0
)
SELECT id, arg_min(message, k) AS message, count(*) AS violations FROM v GROUP BY id""")
def template_violations(spark, sf_dir):
    s = F.col("p_size")
    opt = lambda label, x: F.struct(label.alias("label"), x.cast("int").alias("x"), F.lit(1).alias("y"), F.lit(0.0).alias("baselineBias"))
    question = lambda i, width, kind, options: F.struct(i.alias("id"), width.cast("int").alias("bubbleWidth"), F.lit(9).alias("bubbleHeight"), kind.alias("type"), options.alias("options"))
    first = question(F.lit("Q1"), s % 6 - 1, F.when(s % 3 == 0, "many").otherwise("multi"), F.array(opt(F.lit("A"), s - 7), opt(F.when(s % 4 == 0, "A").otherwise("B"), F.lit(3))))
    second = question(F.when(s % 7 == 0, "Q1").otherwise("Q2"), F.lit(8), F.lit(""), F.array(opt(F.lit("A"), F.lit(0))))
    config = F.struct((s / 40.0).alias("fillThreshold"), F.lit(0.1).alias("selectionThreshold"), F.lit(0.7).alias("bubbleInset"), F.lit(0.5).alias("flagThreshold"), (s % 5 - 1).alias("searchRadius"), F.lit(0).alias("searchGroupSize"), F.lit(0).alias("groupSearchRadius"))
    docs = part_keys(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.struct(config.alias("config"), F.array(F.struct(F.array(first, second).alias("questions"))).alias("pages")).alias("template"))
    return validation.first_and_count(docs, validation.marking_rules(F.col("template")))


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey AS k, p_size AS s FROM part),
c AS (SELECT id, (s - 3) / 40.0::DOUBLE AS fill, CASE WHEN k % 3 <> 0 THEN (s - 10) / 30.0::DOUBLE END AS chosen, (k % 13 - 1) / 10.0::DOUBLE AS inset, (k % 17 - 2) / 12.0::DOUBLE AS flag, s % 5 - 1 AS r, k % 7 - 2 AS g, k % 11 - 3 AS gr FROM p)
SELECT id, 0 AS place, 'config: fillThreshold must be between 0 and 1' AS message FROM c WHERE fill < 0 OR fill > 1
UNION ALL SELECT id, 1, 'config: selectionThreshold must be between 0 and 1' FROM c WHERE chosen < 0 OR chosen > 1
UNION ALL SELECT id, 2, 'config: bubbleInset must be between 0 and 1' FROM c WHERE inset < 0 OR inset > 1
UNION ALL SELECT id, 3, 'config: flagThreshold must be between 0 and 1' FROM c WHERE flag < 0 OR flag > 1
UNION ALL SELECT id, 4, 'config: searchRadius must be nonnegative' FROM c WHERE r < 0
UNION ALL SELECT id, 5, 'config: searchGroupSize must be nonnegative' FROM c WHERE g < 0
UNION ALL SELECT id, 6, 'config: groupSearchRadius must be nonnegative' FROM c WHERE gr < 0""")
def config_violations(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    config = F.struct(((s - 3) / F.lit(40.0)).alias("fillThreshold"), F.when(k % 3 != 0, (s - 10) / F.lit(30.0)).alias("selectionThreshold"), ((k % 13 - 1) / F.lit(10.0)).alias("bubbleInset"), ((k % 17 - 2) / F.lit(12.0)).alias("flagThreshold"),
        (s % 5 - 1).alias("searchRadius"), (k % 7 - 2).cast("int").alias("searchGroupSize"), (k % 11 - 3).cast("int").alias("groupSearchRadius"))
    option = F.struct(F.lit("A").alias("label"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0.0).alias("baselineBias"))
    one = F.struct(F.lit("Q1").alias("id"), F.lit(9).alias("bubbleWidth"), F.lit(9).alias("bubbleHeight"), F.lit("").alias("type"), F.array(option).alias("options"))
    docs = part_keys(spark, sf_dir).select(k.alias("id"), F.struct(config.alias("config"), F.array(F.struct(F.array(one).alias("questions"))).alias("pages")).alias("template"))
    return validation.marking_violations(docs).select("id", F.get("position", F.lit(1)).alias("place"), "message")


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey AS k, p_size AS s, p_size - 2 AS w, p_size % 4 * 9 AS h FROM part),
a AS (SELECT *, 0 AS page, unnest(range(0, 3)) AS j FROM p UNION ALL SELECT *, 1, unnest(range(0, CAST(k % 5 AS BIGINT))) FROM p),
v AS (
  SELECT id, 0 AS place, 'width must be positive' AS message FROM p WHERE w <= 0
  UNION ALL SELECT id, 1, 'height must be positive' FROM p WHERE h <= 0
  UNION ALL SELECT id, 2, 'blurSize must be positive' FROM p WHERE k % 6 <= 0
  UNION ALL SELECT id, 3, 'blurSize must be odd' FROM p WHERE k % 6 % 2 = 0
  UNION ALL SELECT id, 4, 'morphCloseSize must be nonnegative' FROM p WHERE k % 5 - 1 < 0
  UNION ALL SELECT id, 5, 'minAnchorConfidence must be in (0, 1)' FROM p WHERE k % 11 IN (0, 10)
  UNION ALL SELECT id, 7, 'adaptiveBlockSize is required' FROM p WHERE k % 7 = 0
  UNION ALL SELECT id, 8, 'adaptiveBlockSize must be odd' FROM p WHERE k % 7 * 3 % 2 = 0
  UNION ALL SELECT id, 9, 'adaptiveBlockSize must be positive' FROM p WHERE k % 7 = 0
  UNION ALL SELECT id, 149, 'each page must have at least 3 anchors' FROM p WHERE k % 5 < 3
  UNION ALL SELECT id, 100 + page * 50 + j * 10, 'images must be set for each anchor' FROM a WHERE (k + j) % 9 = 0
  UNION ALL SELECT id, 101 + page * 50 + j * 10, 'center is out of bounds' FROM a WHERE NOT (s % 30 BETWEEN 0 AND w AND k % 25 BETWEEN 0 AND h)
  UNION ALL SELECT id, 102 + page * 50 + j * 10, 'roi.min is out of bounds' FROM a WHERE NOT (0 BETWEEN 0 AND w AND s % 7 - 1 BETWEEN 0 AND h)
  UNION ALL SELECT id, 103 + page * 50 + j * 10, 'roi.max is out of bounds' FROM a WHERE NOT (s - 4 BETWEEN 0 AND w AND 6 BETWEEN 0 AND h)
)
SELECT id, arg_min(message, place) AS message, count(*) AS violations FROM v GROUP BY id""")
def scan_template_violations(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    anchor = lambda j: F.struct(F.when((k + j) % 9 == 0, "").otherwise("x").alias("image"), point(s % 30 + j, k % 25).alias("center"), F.struct(point(j, s % 7 - 1).alias("min"), point(s + j - 4, F.lit(6)).alias("max")).alias("roi"))
    some = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < n), anchor)
    config = F.struct((k % 6).cast("int").alias("blurSize"), (k % 5 - 1).cast("int").alias("morphCloseSize"), (k % 11 / F.lit(10.0)).alias("minAnchorConfidence"), (k % 7 * 3).cast("int").alias("adaptiveBlockSize"))
    template = F.struct((s - 2).alias("width"), (s % 4 * 9).alias("height"), config.alias("config"), F.array(F.struct(some(F.lit(3)).alias("anchors")), F.struct(some(k % 5).alias("anchors"))).alias("pages"))
    docs = part_keys(spark, sf_dir).select(k.alias("id"), template.alias("template"))
    return validation.first_and_count(docs, validation.preprocessing_rules(F.col("template")))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.K') AS BIGINT), 7) AS limited FROM events")
def json_config(spark, sf_dir):
    kind = schemas._s(("k", schemas.LONG))
    read = templates.parse(t(spark, sf_dir, "events").select("event_id", "props"), kind, "props", "p")
    return read.select("event_id", "p.k", S.query_value(F.get_json_object("props", "$.K"), "int", 7).alias("limited"))


# --- jobs and telemetry


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 14")
def last_n(spark, sf_dir):
    return jobs.last_items(t(spark, sf_dir, "events"), 14, "ts", "event_id").select("event_id", "ts", "value")


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events) WHERE from_end <= 3")
def last_n_per_user(spark, sf_dir):
    return jobs.last_items_per(t(spark, sf_dir, "events"), 3, "user_id", "ts", "event_id").select("user_id", "event_id", F.col("from_end").cast("long").alias("from_end"))


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events WHERE event_type IS NOT NULL")
def peak_running(spark, sf_dir):
    return jobs.running_peak(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value").where(F.col("event_type").isNotNull()).select("event_id", "user_id", "peak")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, max(value) AS peak, count(*) AS n FROM events GROUP BY 1")
def peaks_hourly(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.peaks_by_window(e, "ts", "value", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "peak", "n")


JOBS_SQL = """
WITH e AS (SELECT user_id AS job, ts, event_id, value AS v, CASE event_id % 11 WHEN 0 THEN 'start' WHEN 1 THEN 'finish' WHEN 2 THEN 'note' ELSE 'progress' END AS kind FROM events),
f AS (SELECT job, min((ts, event_id)) FILTER (WHERE kind = 'finish') AS fin FROM e GROUP BY job),
l AS (SELECT e.*, fin FROM e JOIN f USING (job) WHERE fin IS NULL OR (ts, event_id) <= fin)
"""


def job_events(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 11
    kind = F.when(k == 0, "start").when(k == 1, "finish").when(k == 2, "note").otherwise("progress")
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", "value", kind.alias("kind"))


@query(JOBS_SQL + """SELECT job, min(ts) FILTER (WHERE kind = 'start') AS started, max(ts) FILTER (WHERE kind = 'finish') AS finished,
max(CASE WHEN kind = 'finish' THEN v > 0 END) AS success,
CASE WHEN count(*) FILTER (WHERE kind = 'finish') > 0 THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce(arg_max(v, (ts, event_id)) FILTER (WHERE kind = 'progress'), 0.0))) END AS progress, count(*) AS n_events FROM l GROUP BY job""")
def job_last_state(spark, sf_dir):
    return jobs.job_states(job_events(spark, sf_dir), tie="event_id")


@query(JOBS_SQL + "SELECT job, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM e WHERE kind = 'start') WHERE n > 1")
def job_conflicts(spark, sf_dir):
    return jobs.start_conflicts(job_events(spark, sf_dir), tie="event_id").select("job", "event_id")


@query("SELECT event_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS")
def evict_ttl(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "ts")
    now = e.select(F.max("ts").alias("now")).scalar()
    return jobs.expired(e, now, 86400, "ts")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events")
def jobs_list(spark, sf_dir):
    return jobs.ranked(t(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "rank")


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts, event_id")
def jobs_in_order(spark, sf_dir):
    return jobs.in_order(t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "ts", "event_id")


# --- scalars


@query("""
WITH p AS (SELECT p_partkey, p_size AS s, 0.5 + p_partkey % 30 / 10.0 AS r FROM part), q AS (SELECT *, greatest(1, floor(s * r + 0.5)) AS scaled FROM p)
SELECT p_partkey, CAST(scaled AS INT) AS scaled, CAST(CASE WHEN scaled % 2 = 0 THEN scaled + 1 ELSE scaled END AS INT) AS odd FROM q""")
def scale_odd(spark, sf_dir):
    r = F.lit(0.5) + F.col("p_partkey") % 30 / 10.0
    return t(spark, sf_dir, "part").select("p_partkey", S.scale_size("p_size", r).alias("scaled"), S.scale_odd("p_size", r).alias("odd"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 6 AS blur, p_size % 4 AS close, p_size % 9 * 11 AS block, (p_partkey % 3) * 0.7 AS reference, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (0.5 + p_partkey % 30 / 10.0) / ((p_partkey % 3) * 0.7) END AS r FROM part),
q AS (SELECT *, greatest(1, floor(blur * r + 0.5)) AS b, greatest(3, floor(block * r + 0.5)) AS k, greatest(0, floor(close * r + 0.5)) AS c FROM p)
SELECT p_partkey, CAST(CASE WHEN r IS NULL OR blur = 0 THEN blur WHEN b % 2 = 0 THEN b + 1 ELSE b END AS INT) AS blur, CAST(CASE WHEN r IS NULL OR close = 0 THEN close ELSE c END AS INT) AS close,
CAST(CASE WHEN r IS NULL OR block = 0 THEN block WHEN k % 2 = 0 THEN k + 1 ELSE k END AS INT) AS block FROM q""")
def scaled_configs(spark, sf_dir):
    size = F.col("p_size").cast("int")
    config = F.struct((size % 6).alias("blurSize"), (size % 4).alias("morphCloseSize"), (size % 9 * 11).alias("adaptiveBlockSize"), ((F.col("p_partkey") % 3) * F.lit(0.7)).alias("referenceRatio"))
    scaled = S.scaled_config(F.col("config"), F.lit(0.5) + F.col("p_partkey") % 30 / 10.0)
    rows = t(spark, sf_dir, "part").select("p_partkey", config.alias("config")).select("p_partkey", scaled.alias("c"))
    return rows.select("p_partkey", F.col("c.blurSize").alias("blur"), F.col("c.morphCloseSize").alias("close"), F.col("c.adaptiveBlockSize").alias("block"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN role ELSE CAST((conv_id + turn) % 5 AS VARCHAR) END AS v FROM conversations),
d AS (SELECT *, CASE WHEN v = '' THEN 300 ELSE try_cast(v AS BIGINT) END AS n FROM c)
SELECT conv_id, turn, CASE WHEN n > 0 THEN n END AS value, CASE WHEN n IS NULL THEN 'dpi is not a whole number' WHEN n = 0 THEN 'dpi must be positive' END AS error FROM d""")
def positive_values(spark, sf_dir):
    k = F.col("turn") % 4
    text = F.when(k == 0, "").when(k == 1, F.col("role")).otherwise(((F.col("conv_id") + F.col("turn")) % 5).cast("string"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", S.positive_query(text, "dpi", 300).alias("q")).select("conv_id", "turn", "q.*")


@query("""
SELECT p_partkey, CAST(trunc(p_size * (1275::DOUBLE / 1200)) AS INT) AS x, CAST(trunc(p_size * 7 * (1654::DOUBLE / 1700)) AS INT) AS y,
(1275::DOUBLE / 1200 + (1600 + p_size)::DOUBLE / 1700) / 2 AS ratio, (1275::DOUBLE / 1200 + (1600 + p_size)::DOUBLE / 1700) / 2 > 1.5 AS drifts FROM part""")
def scale_roi(spark, sf_dir):
    ratio = S.size_ratio(F.lit(1275), 1600 + F.col("p_size"), F.lit(1200), F.lit(1700))
    return t(spark, sf_dir, "part").select("p_partkey", S.scale_axis("p_size", F.lit(1275), F.lit(1200)).alias("x"), S.scale_axis(F.col("p_size") * 7, F.lit(1654), F.lit(1700)).alias("y"), ratio.alias("ratio"), S.drifts(ratio).alias("drifts"))


@query("""
WITH p AS (SELECT l_orderkey, l_partkey * 37 % 256 AS r, l_suppkey * 101 % 256 AS g, l_linenumber * 53 % 256 AS b FROM lineitem)
SELECT l_orderkey, (19595 * r * 257 + 38470 * g * 257 + 7471 * b * 257 + 32768) >> 24 AS luma, (19595 * r * 256 + 38470 * g * 256 + 7471 * b * 256 + 32768) >> 24 AS luma_bytes FROM p""")
def luma(spark, sf_dir):
    p = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 37 % 256).alias("r"), (F.col("l_suppkey") * 101 % 256).alias("g"), (F.col("l_linenumber") * 53 % 256).alias("b"))
    return p.select("l_orderkey", S.luma(F.col("r") * 257, F.col("g") * 257, F.col("b") * 257).alias("luma"), S.luma_bytes("r", "g", "b").alias("luma_bytes"))


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size,
printf('%02d:%02d:%02d:%02d', n // 86400, n // 3600 % 24, n // 60 % 60, n % 60) AS uptime FROM (SELECT doc_id, n_chars * (1 + doc_id % 3 * 70001) AS n FROM documents)""")
def format_bytes(spark, sf_dir):
    n = F.col("n_chars") * (1 + F.col("doc_id") % 3 * 70001)
    return t(spark, sf_dir, "documents").select("doc_id", S.format_bytes(n).alias("size"), S.format_uptime(n).alias("uptime"))


@query("SELECT doc_id, greatest(0.0, least(1.0, n_chars::DOUBLE / (1 + doc_id % 4000))) AS progress FROM documents")
def progress(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", S.progress("n_chars", 1 + F.col("doc_id") % 4000).alias("progress"))


@query("SELECT n_nationkey, sha256(n_name) AS digest FROM nation")
def key_digest(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", S.key_digest("n_name", 256).alias("digest"))
