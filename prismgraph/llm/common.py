"""What the operators of this subpackage share: tables, the shared folder and positions in a global order."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text operators: space and the five controls from tab to carriage return.
SPACES = "[ \\t\\n\\u000B\\f\\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see.

    Only where that is unset (tests in one process) a folder of this machine is taken, and only then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prismgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives any executor."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run):
    """A function of Arrow batches, as one whose task gives its memory back to the machine when it ends.

    Python workers live on for the next task; without this they keep what the largest batch of any stage took.
    """

    def of(batches):
        yield from run(batches)
        give_back()

    return of


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh(name: str, taken: list[str]) -> str:
    """name, or with underscores before it what no column is called yet (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def offsets(totals: DataFrame, key: str, amount: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of the amounts of all smaller keys. totals: one small row per partition of a larger table."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0).cast("long")))
