"""Stored tables: the shared folder, global numbering, atomic publishing, recompression, sizes, range and strict reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder; in one local process only, below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prismgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write and read back: cuts the lineage, and a lost executor costs this step only."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Mailbox:
    """Rows that rounds leave for later rounds, in one folder by a key: each row is written and read once."""

    def __init__(self, spark: SparkSession, schema: str, key: str, name: str):
        self.spark, self.schema, self.key, self.path = spark, schema, key, scratch(spark, name)
        spark.createDataFrame([], schema).write.partitionBy(key).parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy(self.key).parquet(self.path)

    def get(self, value: int | None = None) -> DataFrame:
        every = self.spark.read.schema(self.schema).parquet(self.path)
        return every if value is None else every.where(F.col(self.key) == value)


def numbered(df: DataFrame, key: str | list, name: str) -> DataFrame:
    """Number of each row in the order of a key, from 0: rows are ranged, and partitions know the counts before them."""
    keys = key if isinstance(key, list) else [key]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(counts), "_part").withColumn(name, (within + F.col("_before")).cast("long")).drop("_part", "_before")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time written) of the files below a folder, by Spark's own file systems."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def publish(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """A table appears whole or not at all: written beside its place, then renamed; the one before goes last."""
    spark = df.sparkSession
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(f"{side}.new")
    fs, p = _fs(spark, path)
    new, old = _fs(spark, f"{side}.new")[1], _fs(spark, f"{side}.old")[1]
    if fs.exists(p):
        fs.rename(p, old)
    if not fs.rename(new, p):
        raise OSError(f"could not publish {path}")
    if fs.exists(old):
        fs.delete(old, True)


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and the sum of their hashes, whatever their order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def recompress(spark: SparkSession, source: str, target: str, codec: str = "zstd", level: int = 6, split_bytes: bool = True) -> tuple[int, int]:
    """Rewrite a table with another codec, byte planes of numbers apart, check the copy, publish it. Bytes before and after."""
    df = spark.read.parquet(source)
    copy = f"{target.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", str(level))
    if split_bytes:
        writer = writer.option("parquet.enable.bytestreamsplit", "true").option("parquet.enable.dictionary", "true")
    writer.parquet(copy)
    if checksum(spark.read.parquet(copy)) != checksum(df):
        raise OSError(f"the copy of {source} differs")
    fs, p = _fs(spark, target)
    fs.delete(p, True)
    fs.rename(_fs(spark, copy)[1], p)
    return tuple(sum(b for f, b, _ in files(spark, x) if f.endswith(".parquet")) for x in (source, target))


def sections(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(section, files, stored_bytes) of stored tables, in the order given."""
    rows = []
    for name, path in tables.items():
        found = [b for f, b, _ in files(spark, path) if f.endswith(".parquet")]
        rows.append((name, len(found), sum(found)))
    return spark.createDataFrame(rows, "section string, files long, stored_bytes long")


def read_range(df: DataFrame, number: str, first: int, count: int) -> DataFrame:
    """Rows first .. first + count - 1 of a table stored in the order of their number: statistics skip all other row groups."""
    return df.where(F.col(number).between(first, first + count - 1))


def read_tables(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """strict: a damaged file is an error; else its rows are left out."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("ignoreCorruptFiles", str(not strict).lower()).parquet(path)
