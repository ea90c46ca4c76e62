"""Quality rules on documents and on their hosts, in DataFrame functions alone.

Each document is measured and meets or fails the base rules. Failures are summed per host; a beta prior fitted
to all hosts by moments shrinks the hosts' failure rates; a host whose shrunken rate is above `max_rate` fails
as a whole. Host verdicts are joined back to the documents.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; without hosts or
with equal rates the prior is as strong as it may get; repeated rows count each; columns of the input stay, and
new ones take other names where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Above this shrunken rate of failing documents a host is rejected.
MAX_RATE = 0.5
#: Bounds of the prior's weight, in documents.
STRENGTH = (1.0, 1e6)
#: Bits of a packed window that hold its position.
POSITION_BITS = 24


def _same(array: str, index: Column, value: Column, part) -> Column:
    return F.coalesce(part(F.get(F.col(array), index)) == part(value), F.lit(False))


def measures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the columns' names.

    Windows of three words are compared by 64-bit hashes. They are sorted as one long each, the hash's upper bits
    before the position, which leaves the few windows that may repeat; those are sorted again with their whole hash.
    """
    name = {c: fresh(docs, c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_at", "_whole")}
    text, words, lines, hashes, windows, packed, at, whole = (name[c] for c in ("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_at", "_whole"))
    n = name["n_words"]
    mask, none = (1 << POSITION_BITS) - 1, F.array().cast("array<long>")
    df = docs.withColumn(text, F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES)))
    df = df.withColumns({
        words: F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+")),
        lines: F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        name["word_chars"]: F.length(F.translate(text, SPACES, "")).cast("long"),
        name["n_symbols"]: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    df = df.withColumns({
        n: F.size(words).cast("long"),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
        name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    df = df.withColumn(windows, F.when(F.col(n) < 3, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(F.col(hashes), i), F.get(F.col(hashes), i + 1), F.get(F.col(hashes), i + 2)))))
    df = df.withColumn(packed, F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))))
    upper = lambda x: F.shiftright(x, POSITION_BITS)
    maybe = F.transform(F.filter(packed, lambda x, i: _same(packed, i - 1, x, upper) | _same(packed, i + 1, x, upper)), lambda x: x.bitwiseAND(F.lit(mask)))
    df = df.withColumn(at, F.when(F.col(n) <= mask, maybe).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 3, F.lit(0)))))
    df = df.withColumn(whole, F.sort_array(F.transform(at, lambda i: F.struct(F.get(F.col(windows), i.cast("int")).alias("h"), i.alias("i")))))
    of = lambda x: x["h"]
    twice = F.sort_array(F.transform(F.filter(whole, lambda x, i: _same(whole, i - 1, x, of) | _same(whole, i + 1, x, of)), lambda x: x["i"]))
    covered = F.aggregate(twice, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn(name["n_repeat_words"], covered).drop(text, words, lines, hashes, windows, packed, at, whole)
    return df, name


def failed(name: dict[str, str]) -> Column:
    return (F.col(name["n_words"]) < 50) | (100 * F.col(name["n_repeat_words"]) > 50 * F.col(name["n_words"]))


def host_verdicts(scored: DataFrame, host: Column, failing: Column, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, fails, rate, host_kept): one row per host."""
    hosts = scored.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(failing.cast("long")).alias("fails"))
    hosts = cut(hosts, "hosts")
    n, x = F.sum("n"), F.sum("fails")
    total = hosts.agg((x / n).alias("m"), (F.sum(F.col("fails") * F.col("fails") / F.col("n")) / n - F.pow(x / n, F.lit(2))).alias("spread"), (F.count("*") / n).alias("noise"))
    m, unit = F.col("m"), F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("spread") - unit * F.col("noise"), F.lit(0.0))
    weight = F.when(between > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), unit / between - 1))).otherwise(F.lit(STRENGTH[1]))
    prior = total.select(F.coalesce(m, F.lit(0.0)).alias("m"), weight.alias("weight"))
    rate = (F.col("fails") + prior.select(F.col("m") * F.col("weight")).scalar()) / (F.col("n") + prior.select("weight").scalar())
    return cut(hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_rate), "verdicts")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The documents (or their columns `keep`) with measures, base_failed, host_rate and kept."""
    scored, name = measures(docs, text_col)
    failing, rate, kept = fresh(docs, "base_failed"), fresh(docs, "host_rate"), fresh(docs, "kept")
    shown = list(dict.fromkeys([*(keep or docs.columns), host_col])) + [name[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    scored = cut(scored.select(*shown, failed(name).alias(failing)), "scored")
    found = host_verdicts(scored, F.col(host_col), F.col(failing), max_rate)
    # the verdicts' files tell their size: Spark broadcasts them while they are small, and shuffles beyond
    host, host_kept = fresh(scored, "_host"), fresh(scored, "_host_kept")
    verdicts = found.select(F.col("host").alias(host), F.round("rate", 6).alias(rate), F.col("host_kept").alias(host_kept))
    joined = scored.join(verdicts, F.col(host_col).eqNullSafe(F.col(host)), "left")
    return joined.withColumn(kept, ~F.col(failing) & F.col(host_kept)).drop(host, host_kept)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), keep=("doc_id",)).drop("source")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), x AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM m),
y AS (SELECT rid, i, a, lead(a) OVER r AS b, lead(a, 2) OVER r AS c FROM x WINDOW r AS (PARTITION BY rid ORDER BY i)),
z AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM y WHERE c IS NOT NULL),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM z, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
s AS (
  SELECT doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN p USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS fails FROM f GROUP BY source),
g AS (SELECT sum(fails) / sum(n) AS m, sum(fails * fails / n) / sum(n) - (sum(fails) / sum(n)) ** 2 AS spread, count(*) / sum(n) AS noise FROM h),
q AS (SELECT m, CASE WHEN spread - m * (1 - m) * noise > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / (spread - m * (1 - m) * noise) - 1)) ELSE 1e6 END AS weight FROM g),
v AS (SELECT source, (fails + m * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
