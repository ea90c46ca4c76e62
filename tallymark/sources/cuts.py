"""Cut points of core jobs: tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join goes to all executors up to this many bytes in memory: the driver holds it several times while it is sent.
BROADCAST_BYTES = 16 << 20
#: A side of more rows than this has keys enough to be spread by them alone.
MANY_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a folder of its own, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(rows: DataFrame, name: str) -> DataFrame:
    """Rows written and read back: lineage ends here, and what a lost executor held is in files."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.cut_path = path
    return out


def columns_of(rows: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a cut table, which are read from its files alone."""
    out = rows.select(*columns)
    out.cut_path = rows.cut_path
    return out


def drop(rows: DataFrame) -> None:
    """Remove a cut table."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.cut_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table_bytes(rows: DataFrame) -> int:
    """Bytes of a cut table's files."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.cut_path)
    return int(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def _size(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_size(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _size(F.map_keys(value), T.ArrayType(kind.keyType)) + _size(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.lit(16) + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _size(x, kind.elementType)), F.lit(0))
    return F.lit(8)


def memory_of(rows: DataFrame) -> tuple[int, int]:
    """(rows, bytes in memory) of a cut table. Its files tell little: a column of one value takes none there."""
    n, size = rows.agg(F.count("*"), F.sum(_size(F.struct("*"), rows.schema).cast("long"))).first()
    return n, size or 0


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join whose large side has few different keys: `small`, a cut table, goes to all executors while it takes little memory.

    Beyond `limit` each of its rows is repeated for `salts` shares, and the large side's rows of a key are dealt to
    them by a hash of all their other columns that can be hashed, so that no key lies in one task. Beyond MANY_ROWS nothing is
    repeated: the rows meet by their keys, and the large side, which isn't sorted for it, is split where a key has many.
    """
    # files larger than the limit are larger in memory
    rows, size = (small.count(), table_bytes(small)) if table_bytes(small) > limit else memory_of(small)
    if size <= limit:
        return large.join(F.broadcast(small), on, how)
    if rows > MANY_ROWS:
        return large.join(small.hint("shuffle_hash"), on, how)
    hashed = [c for c, kind in large.dtypes if not kind.startswith("map") and "binary" not in kind]
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    shares = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(shares, [*on, "_salt"], how).drop("_salt")
