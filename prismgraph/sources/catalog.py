"""Data sets in a folder: which graphs, ranges and stored tables belong together, and whether tables are still fresh."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.sources.tables import _fs, files

#: Endings of stored data sets, range files and packed sources, and the folder that is passed over.
STORED, RANGES, PACKED, HIDDEN = ".prism", ".ranges", ".bz2", ".prismgraph"


def catalog(listing: DataFrame) -> DataFrame:
    """(name, graph, ranges, tables) of a listing (path): graphs that have ranges, and stored tables without sources, by name."""
    p = F.col("path")
    seen = listing.select("path").where(~p.rlike(rf"(^|/){HIDDEN.replace('.', '[.]')}/"))
    stored_ = seen.where(p.endswith(STORED))
    ranges = seen.where(p.endswith(RANGES)).select(F.regexp_replace("path", r"\.ranges$", "").alias("path"), F.col("path").alias("ranges"))
    graphs = seen.where(~p.endswith(STORED) & ~p.endswith(RANGES) & ~p.endswith(PACKED)).join(ranges, "path")
    home = F.when(p.endswith(".sch"), F.regexp_replace("path", r"\.sch$", STORED)).otherwise(F.concat("path", F.lit(STORED)))
    built = graphs.select(p.alias("name"), p.alias("graph"), "ranges", home.alias("tables"))
    alone = stored_.join(built.select(F.col("tables").alias("path")), "path", "left_anti")
    none = F.lit(None).cast("string")
    return built.unionByName(alone.select(p.alias("name"), none.alias("graph"), none.alias("ranges"), p.alias("tables"))).orderBy("name")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path) below the folder: names from its file system; a stored data set is a folder itself and counts as one path."""
    base = _fs(spark, folder)
    root = base[0].makeQualified(base[1]).toString().rstrip("/") + "/"
    names = {f.removeprefix(root) for f, _, _ in files(spark, folder)}
    whole = {n[: n.index(STORED + "/") + len(STORED)] if STORED + "/" in n else n for n in names}
    return spark.createDataFrame([(n,) for n in sorted(whole)], "path string")


def identity(spark: SparkSession, *sources: str) -> list[list[int]]:
    """Bytes and time of each source."""
    return [[x[1], x[2]] for s in sources for x in files(spark, s)]


def remember(spark: SparkSession, tables: str, *sources: str) -> None:
    fs, p = _fs(spark, f"{tables}/_source.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(identity(spark, *sources)), "utf-8"))
    out.close()


def matches(spark: SparkSession, tables: str, *sources: str) -> bool:
    """Whether tables were built from these sources as they are now; damaged notes count as no."""
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, f"{tables}/_source.json")
    if not fs.exists(p):
        return False
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode()) == identity(spark, *sources)
    except (ValueError, Py4JJavaError):  # no JSON, or a wrong checksum
        return False
    finally:
        stream.close()
