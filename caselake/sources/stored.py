"""Keyed tables that batches are merged into: only touched buckets are read and written, and a failed merge changes nothing.

A stored table is a folder. `rows` holds Parquet files bucketed by the hash of the key, one sub-folder (piece) for each
bucket and writing; `versions` holds one JSON row for each version: the pieces that belong to it. A merge

1. writes the batch once, so that it is the same wherever it is read, and asks which buckets it touches;
2. joins it with the live pieces of these buckets. They are read through a bucketed table, so the stored side is neither
   shuffled nor read beyond the touched buckets; only the batch is;
3. writes the result as new pieces under a new name, and then, last, the version that names them.

Until the version stands there readers see the one before; pieces of a merge that failed belong to no version and `vacuum`
deletes them. Older versions stay readable until then. One writer at a time: a second one that writes the same version
number fails, as its folder is there already.

Defined results: keys are unique (of repeated rows in a batch use `dedupe_records` first); rows with a null key never
match, as in `upsert`; columns of a batch that the table lacks are ignored, those that it lacks itself are an error; an
empty batch makes a new version with the same rows; an empty table can be stored; the column name PIECE is reserved.
A bucket is one task and one file (a few after `replace`), so choose `buckets` so that one fits a task (some 200 MB of files); children of
one parent share a bucket and stream through its task, they are never held together.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.cases import replace_children, upsert
from .shared import written

PIECE = "stored_piece"
VERSION = "key string, buckets int, schema string, pieces array<string>, batch long, version long"


def latest(spark: SparkSession, path: str, version: int | None = None) -> Row:
    """The row of a version, of the newest one if none is named."""
    rows = spark.read.schema(VERSION).json(f"{path}/versions")
    row = rows.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"{path} holds no such version")
    return row


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, hash partitioned by the key for joins that ask for that."""
    at = latest(spark, path, version)
    return _pieces(spark, path, at, at.pieces)


def create(df: DataFrame, path: str, key: str, buckets: int = 200) -> None:
    """Store df as version 0."""
    if PIECE in df.columns:
        raise ValueError(f"{PIECE} is a reserved column name")
    at = Row(key=key, buckets=buckets, schema=df.schema.json(), pieces=[], batch=-1, version=-1)
    _commit(df.repartition(buckets, key), path, at, range(buckets), -1)


def merge(new: DataFrame, path: str, kept: tuple[str, ...] = ("created_at",), batch: int | None = None) -> None:
    """`upsert` the rows of new as the next version.

    With a batch number, as a stream gives it, a batch that is in the table already isn't merged again.
    """
    spark = new.sparkSession
    at = latest(spark, path)
    if batch is not None and batch <= at.batch:
        return
    given = written(new.select(*_names(at)), "stored-batch")
    touched = _touched(given, at)
    _commit(upsert(_pieces(spark, path, at, _live(at, touched)), given, at.key, kept), path, at, touched, at.batch if batch is None else batch)


def replace(new: DataFrame, touched: DataFrame, path: str) -> None:
    """`replace_children`: without the stored rows of the keys in touched and with the new ones, as the next version."""
    spark = new.sparkSession
    at = latest(spark, path)
    given = written(new.select(*_names(at)), "stored-children")
    keys = written(touched.select(at.key).distinct(), "stored-parents")
    numbers = sorted({*_touched(given, at), *_touched(keys, at)})
    kept = replace_children(_pieces(spark, path, at, _live(at, numbers)), given, keys, at.key)
    _commit(kept, path, at, numbers, at.batch)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete what the newest `keep` versions don't name, and older versions; returns the deleted pieces. Not while a merge runs."""
    versions = spark.read.schema(VERSION).json(f"{path}/versions").orderBy(F.desc("version")).limit(keep).collect()
    live = {p for v in versions for p in v.pieces}
    oldest = min(v.version for v in versions)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = folder("rows").getFileSystem(conf)
    names = lambda name: [s.getPath().getName() for s in files.listStatus(folder(name))]
    for name in names("versions"):
        if name.startswith("version=") and int(name.split("=")[1]) < oldest:
            files.delete(folder(f"versions/{name}"), True)
    gone = sorted(p for name in names("rows") if name.startswith(f"{PIECE}=") and (p := name.split("=", 1)[1]) not in live)
    for p in gone:
        files.delete(folder(f"rows/{PIECE}={p}"), True)
    return gone


def _names(at: Row) -> list[str]:
    return StructType.fromJson(json.loads(at.schema)).names


def _bucket(at: Row):
    """The number of a row's bucket, as Spark itself computes it for bucketed files."""
    return F.pmod(F.hash(at.key), F.lit(at.buckets))


def _touched(rows: DataFrame, at: Row) -> list[int]:
    """Numbers of the buckets that hold keys of rows: no more than there are buckets."""
    return sorted(r.b for r in rows.select(_bucket(at).alias("b")).distinct().collect())


def _live(at: Row, numbers: list[int]) -> list[str]:
    chosen = set(numbers)
    return [p for p in at.pieces if int(p.rsplit("-", 1)[1]) in chosen]


def _table(spark: SparkSession, path: str, at: Row) -> str:
    """The session's name for the folder of rows as a bucketed table."""
    name = "stored_" + hashlib.sha256(f"{path} {at.key} {at.buckets} {at.schema}".encode()).hexdigest()[:24]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(at.schema)))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PIECE} string) USING parquet PARTITIONED BY ({PIECE}) CLUSTERED BY (`{at.key}`) SORTED BY (`{at.key}`) INTO {at.buckets} BUCKETS LOCATION '{path}/rows'")
    return name


def _pieces(spark: SparkSession, path: str, at: Row, pieces: list[str]) -> DataFrame:
    name = _table(spark, path, at)
    if spark.conf.get("spark.sql.catalogImplementation") == "hive":  # which lists a table's folders only when it is told to
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    return spark.table(name).where(F.col(PIECE).isin(pieces)).drop(PIECE)


def _commit(rows: DataFrame, path: str, at: Row, numbers, batch: int) -> None:
    """Write rows as new pieces of the buckets `numbers`, and then the version that has them in the place of the old ones."""
    spark = rows.sparkSession
    stamp = uuid.uuid4().hex
    placed = rows.withColumn(PIECE, F.concat(F.lit(f"{stamp}-"), _bucket(at).cast("string")))
    placed.write.mode("append").insertInto(_table(spark, path, at))
    replaced = set(_live(at, list(numbers)))
    pieces = [p for p in at.pieces if p not in replaced] + [f"{stamp}-{b}" for b in numbers]
    _publish(spark, path, Row(key=at.key, buckets=at.buckets, schema=at.schema, pieces=pieces, batch=batch, version=at.version + 1))


def _publish(spark: SparkSession, path: str, row: Row) -> None:
    """Write a version. Its one file is moved into its place when it is whole, so nobody reads half of it."""
    fields = VERSION.removesuffix(", version long")
    df = spark.createDataFrame([row[:-1]], fields).coalesce(1)
    df.write.mode("error").json(f"{path}/versions/version={row.version}")
