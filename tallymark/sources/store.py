"""A store of templates, anchors, scans and pages: Parquet tables with appends, look-ups and cascading deletes.

Every table has numbered versions, small text files that list the folders of its rows. A write or delete makes the next
version; readers take the last one and see all of a change or nothing. Appends add a folder to the list instead of copying. Deletes rewrite what is left by anti-join, succeed for ids that aren't there, and give counts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_bytes, readable
from ..operators.raster import anchor_patterns
from ..operators.validation import first_and_count, marking_rules, preprocessing_rules
from ..schemas import MARKING_TEMPLATE, PREPROCESSING_TEMPLATE, TABLES
from .cuts import cut, drop
from .templates import parse, whole_marking, whole_preprocessing

MALFORMED = "the document is malformed"


# --- what the store does with rows, for any frames


def lookup(rows: DataFrame, key, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key)


def before(rows: DataFrame, limit, column: str = "created_at_unix_ms") -> DataFrame:
    return rows.where(F.col(column) < limit)


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` isn't among keys (one column); ids that aren't there change nothing."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(on)).distinct(), on, "left_anti").select(*rows.columns)


def first_rows(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Each key's first row, as the key and the columns `order` that it is first by."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in order])


def lists_in_order(rows: DataFrame, key: str, order: tuple[str, ...], item: str) -> DataFrame:
    """(key, items, n): each key's values of the column `item`, one of `order`, in that order. A template's anchors are few."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_all"), F.count("*").alias("n"))
    return got.select(key, F.transform("_all", lambda x: x[item]).alias("items"), "n")


def grids(rows: DataFrame, key: str, page: str, order: str, item: str) -> DataFrame:
    """(key, grid): each key's items by page and, within a page, in order. A template's anchors are few."""
    per_page = rows.groupBy(key, page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(item).alias("item")))).alias("_items"))
    got = per_page.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col("_items").alias("items")))).alias("_pages"))
    return got.select(key, F.transform("_pages", lambda p: F.transform(p["items"], lambda x: x["item"])).alias("grid"))


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    (name, rows), *rest = tables.items()
    return rows.agg(F.count("*").alias(name)).select(name, *[t.agg(F.count("*").alias("n")).scalar().alias(other) for other, t in rest])


def usage_of(rows: DataFrame, part, size) -> DataFrame:
    """(part, files, bytes) of the rows that have a size."""
    sized = rows.select(part.alias("part"), size.cast("long").alias("n")).where(F.col("n").isNotNull())
    return sized.groupBy("part").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


def utilization(files: DataFrame, samples: DataFrame, n: int = 1) -> DataFrame:
    """(level, part, kind, files, bytes, size, peak, uptime): parts and kinds, each part, and everything, of one pass by grouping sets.

    files: (part, kind, bytes), those without bytes left out; samples: (ts, value). The total has the samples' highest value and the
    whole seconds that they span beside it; it is there without any file too.
    """
    sums = files.where(F.col("bytes").isNotNull()).groupingSets([["part", "kind"], ["part"], []], "part", "kind").agg(F.grouping_id("part", "kind").alias("_g"), F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    level = F.when(F.col("_g") == 0, "kind").when(F.col("_g") == 1, "part").otherwise("total")
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    seen = samples.agg(F.max("value").alias("peak"), F.floor(span / 1_000_000).cast("long").alias("uptime")).withColumn("level", F.lit("total"))
    rows = sums.select(level.alias("level"), "part", "kind", "files", "bytes", format_bytes("bytes").alias("size"))
    return rows.join(seen, "level", "left")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, table: str) -> list[str]:
        fs, folder = self._file(f"{self.root}/{table}/_versions")
        return sorted(str(f.getPath()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _parts(self, table: str) -> list[str]:
        versions = self._versions(table)
        return [] if not versions else json.loads("\n".join(r[0] for r in self.spark.read.text(versions[-1]).collect()))

    def _point(self, table: str, parts: list[str]) -> None:
        """Make the next version; a second writer of the same version fails."""
        fs, path = self._file(f"{self.root}/{table}/_versions/v{len(self._versions(table)):08d}.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()

    def read(self, table: str) -> DataFrame:
        parts = self._parts(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def append(self, table: str, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        kinds = TABLES[table]
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]).write.parquet(f"{self.root}/{table}/{name}")
        self._point(table, [*self._parts(table), name])

    def delete(self, table: str, keys: DataFrame, on: str = "id") -> int:
        """Remove the rows whose `on` is among keys (one column of that name); gives how many were there."""
        rows = self.read(table)
        wanted = keys.select(F.col(keys.columns[0]).alias(on)).distinct()
        gone = rows.join(wanted, on, "left_semi").count()
        if gone:
            name = uuid.uuid4().hex
            without(rows, wanted, on).write.parquet(f"{self.root}/{table}/{name}")
            self._point(table, [name])
        return gone

    # --- saving

    def save_marking_templates(self, templates: DataFrame, template: str = "template") -> DataFrame:
        """Store documents under new ids; gives (id, json)."""
        rows = templates.select(F.expr("uuid()").alias("id"), F.to_json(template).alias("json"))
        return self._saved("marking_templates", rows)

    def save_preprocessing_templates(self, templates: DataFrame, anchors: DataFrame) -> None:
        """Store (id, json) without anchor images, and anchors (template_id, page_index, anchor_index, matrix)."""
        self.append("anchors", anchors.withColumn("id", F.expr("uuid()")))
        self.append("preprocessing_templates", templates.withColumn("json", F.regexp_replace("json", r'"image"\s*:\s*"[^"]*"', '"image":""')))

    def save_marking_documents(self, documents: DataFrame) -> DataFrame:
        """Check whole template documents (id, json) and store the good ones under their ids; gives (id, error) of each, the first violation in document order."""
        read = parse(documents.select("id", "json"), MARKING_TEMPLATE).withColumn("template", whole_marking(F.col("template")))
        broken = first_and_count(read.where(~F.col("malformed")).select("id", "template"), marking_rules(F.col("template"))).drop("violations")
        message = F.when(F.col("malformed"), MALFORMED).otherwise(F.col("message"))
        verdicts = cut(read.join(broken, "id", "left").select("id", "json", message.alias("error")), "verdicts")
        self.append("marking_templates", verdicts.where(F.col("error").isNull()).select("id", "json"))
        return verdicts.select("id", "error")

    def save_preprocessing_documents(self, documents: DataFrame) -> DataFrame:
        """Check and store whole template documents (id, json): anchor images are decoded and binarized once, and leave the text.

        Gives (id, error) of each. A document that is malformed, breaks a rule, or has an image that can't be read is not
        stored; the others are. A rule's error is the first in document order, and comes before those of images. Images
        of documents that break a rule aren't decoded. Pixels and verdicts are cut tables, which hold for this call.
        """
        read = parse(documents.select("id", "json"), PREPROCESSING_TEMPLATE).withColumn("template", whole_preprocessing(F.col("template")))
        broken = first_and_count(read.where(~F.col("malformed")).select("id", "template"), preprocessing_rules(F.col("template"))).drop("violations")
        checked = read.join(broken, "id", "left")
        sound = checked.where(~F.col("malformed") & F.col("message").isNull())
        pages = sound.select("id", F.col("template.config").alias("config"), F.posexplode("template.pages").alias("page_index", "page"))
        anchors = pages.select(F.col("id").alias("template_id"), "config", "page_index", F.posexplode("page.anchors").alias("anchor_index", "anchor"))
        decoded = cut(anchor_patterns(anchors.select("template_id", "page_index", "anchor_index", "config", F.col("anchor.image").alias("image"))), "decoded")
        bad = decoded.where(F.col("error").isNotNull()).groupBy("template_id").agg(F.min(F.struct("page_index", "anchor_index", "error")).alias("first"))
        message = F.when(F.col("malformed"), MALFORMED).otherwise(F.coalesce("message", F.when(F.col("first").isNotNull(), F.format_string("page %d, anchor %d: %s", "first.page_index", "first.anchor_index", "first.error"))))
        verdicts = cut(checked.join(bad, F.col("id") == F.col("template_id"), "left").select("id", "json", message.alias("error")), "verdicts")
        good = verdicts.where(F.col("error").isNull())
        self.save_preprocessing_templates(good.select("id", "json"), decoded.join(good.select(F.col("id").alias("template_id")), "template_id", "left_semi").select("template_id", "page_index", "anchor_index", "matrix"))
        drop(decoded)
        return verdicts.select("id", "error")

    def save_scans(self, scans: DataFrame, pages: DataFrame) -> None:
        """Store pages first, so that a scan is never there without them."""
        self.append("scan_pages", pages)
        self.append("scans", scans)

    def _saved(self, table: str, rows: DataFrame) -> DataFrame:
        before = set(self._parts(table))
        self.append(table, rows)
        new = [p for p in self._parts(table) if p not in before]
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{p}" for p in new])

    # --- look-ups

    def by_id(self, table: str, key: str) -> DataFrame:
        return lookup(self.read(table), key)

    def scan_pages(self, scan_id: str) -> DataFrame:
        return lookup(self.read("scan_pages"), scan_id, "scan_id").orderBy("page_index", "id")

    def one_page(self, scan_id: str, page_index: int) -> DataFrame:
        found = lookup(lookup(self.read("scan_pages"), scan_id, "scan_id"), page_index, "page_index")
        return first_rows(found, "scan_id", ("id", *[c for c in found.columns if c not in ("id", "scan_id")])).select(*found.columns)

    def template_anchors(self, template_id: str) -> DataFrame:
        return lookup(self.read("anchors"), template_id, "template_id").orderBy("page_index", "anchor_index")

    def scans_before(self, unix_ms: int) -> DataFrame:
        return before(self.read("scans"), unix_ms)

    def incomplete_templates(self, wanted: DataFrame) -> DataFrame:
        """Ids of templates with another number of readable anchors than they should have; wanted: (template_id, n)."""
        there = self.read("anchors").where(readable(F.col("matrix"))).groupBy("template_id").agg(F.count("*").alias("have"))
        return wanted.join(there, "template_id", "left").where(F.coalesce("have", F.lit(0)) != F.col("n")).select("template_id")

    def template_grids(self) -> DataFrame:
        """(template_id, template, grid) of the preprocessing templates whose anchors are all there and readable, matrices by page and anchor."""
        read = parse(self.read("preprocessing_templates"), PREPROCESSING_TEMPLATE).where(~F.col("malformed")).select(F.col("id").alias("template_id"), "template")
        anchors = self.read("anchors").where(readable(F.col("matrix")))
        met = read.join(grids(anchors, "template_id", "page_index", "anchor_index", "matrix"), "template_id")
        return met.where(F.transform("grid", F.size) == F.transform("template.pages", lambda p: F.size(p["anchors"])))

    def load_template(self, template_id: str) -> DataFrame:
        """One template with its grid; one whose anchors are incomplete or unreadable is removed, and there are no rows."""
        found = self.template_grids().where(F.col("template_id") == template_id)
        if found.isEmpty() and not self.by_id("preprocessing_templates", template_id).isEmpty():
            self.delete_templates(self.spark.range(1).select(F.lit(template_id).alias("id")))
        return found

    def load_scan(self, scan_id: str) -> DataFrame:
        """The pages of a scan in order; a scan with a page that can't be read is removed, and there are no rows."""
        pages = self.scan_pages(scan_id)
        if not pages.where(~readable(F.col("binary"))).isEmpty():
            self.delete_scans(self.spark.range(1).select(F.lit(scan_id).alias("id")))
            return self.scan_pages(scan_id)
        return pages

    def utilization(self, samples: DataFrame) -> DataFrame:
        """What each part of the store takes, and all of it, beside the samples' peak."""
        pages = self.read("scan_pages")
        rows = [("matrices", "pages", pages, "binary.data"), ("matrices", "anchors", self.read("anchors"), "matrix.data"), ("pictures", "pages", pages, "picture.data"), ("database", "marking_templates", self.read("marking_templates"), "json"), ("database", "preprocessing_templates", self.read("preprocessing_templates"), "json")]
        files = [df.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.octet_length(size).cast("long").alias("bytes")) for part, kind, df, size in rows]
        return utilization(reduce(DataFrame.unionAll, files), samples)

    def usage(self) -> DataFrame:
        """(part, files, bytes) of matrices and pictures."""
        pages = self.read("scan_pages")
        sizes = [("matrices", pages.select(F.length("binary.data").alias("n"))), ("matrices", self.read("anchors").select(F.length("matrix.data").alias("n"))), ("pictures", pages.select(F.length("picture.data").alias("n")))]
        rows = [df.select(F.lit(part).alias("part"), "n") for part, df in sizes]
        return usage_of(rows[0].unionAll(rows[1]).unionAll(rows[2]), F.col("part"), F.col("n"))

    # --- cascades: two tables, the dependent rows first. A stop in between leaves a template or scan without them, which the
    # same call, or heal, then removes

    def delete_templates(self, ids: DataFrame) -> int:
        """Preprocessing templates and their anchors."""
        self.delete("anchors", ids, "template_id")
        return self.delete("preprocessing_templates", ids)

    def delete_scans(self, ids: DataFrame) -> int:
        self.delete("scan_pages", ids, "scan_id")
        return self.delete("scans", ids)

    def delete_scans_before(self, unix_ms: int) -> int:
        return self.delete_scans(self.scans_before(unix_ms).select("id"))

    def unreadable_scans(self) -> DataFrame:
        """Ids of scans that have a page without a readable binary matrix."""
        return self.read("scan_pages").where(~readable(F.col("binary"))).select(F.col("scan_id").alias("id")).distinct()

    def heal_scans(self) -> int:
        """Remove scans that can't be read."""
        return self.delete_scans(self.unreadable_scans())

    def heal(self, wanted: DataFrame) -> int:
        """Remove templates whose anchors are incomplete."""
        return self.delete_templates(self.incomplete_templates(wanted).select(F.col("template_id").alias("id")))
