"""A hierarchy of roads derived from the events table: chains of 64 edges under binary trees of shortcuts, depth 6.

65 events make a chain; those that are left (up to 64) make none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.sources.tables import numbered

HEIGHT = 6


def nodes_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = numbered(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id", "p")
    chains = events.count() // 65
    v = F.floor(F.col("value") * 10).cast("long")
    chain, i = F.floor(F.col("p") / 65).cast("long"), F.col("p") % 65
    nodes = events.where(F.col("p") < 65 * chains).select(
        F.col("p").alias("node"),
        ((chain * 7919) % 5000 * 100000 - 250000000 + i * 60000).alias("x"),
        ((chain * 104729) % 7000 * 70000 - 245000000 + (v % 41 - 20) * 3000).alias("y"),
    )
    offset = lambda h: 128 - (128 >> h)
    shape = [(h, k, 1 << h, offset(h), offset(h - 1) if h else None) for h in range(HEIGHT + 1) for k in range(64 >> h)]
    one = spark.createDataFrame(shape, "h int, k long, w long, offset long, below long")
    e = spark.range(chains).withColumnRenamed("id", "chain").crossJoin(F.broadcast(one))  # 127 fixed rows for each chain
    c, k = F.col("chain"), F.col("k")
    late = (F.col("h") > 0) & ((c * 31 + F.col("h") * 17 + k * 13) % 100 < 15)
    edges = e.select(
        (c * 127 + F.col("offset") + k).alias("edge"),
        (c * 65 + k * F.col("w")).alias("source"),
        (c * 65 + (k + 1) * F.col("w")).alias("target"),
        F.when(F.col("h") > 0, (c * 65 + k * F.col("w") + F.shiftright("w", 1))).alias("split"),
        (c * 127 + F.col("below") + 2 * k).alias("child_a"),
        (c * 127 + F.col("below") + 2 * k + 1).alias("child_b"),
        (1 + (c + k) % 5).cast("int").alias("type"),
        F.when(F.col("h") == HEIGHT, 8).when(late, F.col("h") + 1).otherwise(F.col("h")).alias("birth"),
        F.col("h").alias("death"),
    )
    return nodes, edges
