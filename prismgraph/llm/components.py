"""Connected components of an edge table by alternating stars; labels are the smallest node reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, store

#: Pieces that the rows of a node with many neighbours are dealt in.
PIECES = 64


def _signature(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _joined(rows: DataFrame, found: DataFrame, key: str, most: int | None) -> DataFrame:
    """rows left join found on a key. Keys of more than `most` rows (none: no key has so many) are few enough to be known
    everywhere; their rows are dealt in PIECES, for which what was found is repeated."""
    if most is None:
        return rows.join(found, key, "left")
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias("_k"), F.lit(True).alias("_hot")))
    piece = F.when(F.col("_hot"), F.pmod(F.xxhash64("u", "v"), F.lit(PIECES))).otherwise(F.lit(0).cast("long"))
    left = rows.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_p", piece).drop("_k", "_hot")
    pieces = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = found.join(hot, F.col(key) == F.col("_k"), "left").withColumn("_p", F.explode(pieces)).drop("_k", "_hot")
    return left.join(right, [key, "_p"], "left").drop("_p")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v) -> (node, label) for every node of an edge. Minima are combined before the shuffle; each round is
    written to the shared folder, so a lost executor costs one round."""
    edges = store(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    before = None
    while (now := _signature(edges)) != before:
        before = now
        most = max(1000, now[0] // (4 * parts(edges.sparkSession)))  # so at most four keys a partition are above it
        ends = edges.select(F.explode(F.array("u", "v")).alias("k")).groupBy("k").count()
        if (ends.agg(F.max("count")).first()[0] or 0) <= most:
            most = None
        # every larger neighbour of a node goes to the node's smallest; a node without smaller ones keeps them
        least = edges.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("m"))
        large = _joined(edges, least, "u", most).select(F.coalesce("m", "u").alias("u"), "v").distinct()
        # every node's smaller neighbours, and itself, go to the smallest of them
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = _joined(large, lower, "v", most).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        edges = store(small.where("u <> v").distinct(), name)
    nodes = edges.groupBy("v").agg(F.min("u").alias("label")).select(F.col("v").alias("node"), "label")
    return nodes.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
