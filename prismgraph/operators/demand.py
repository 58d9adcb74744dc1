"""Demand paging as relations: what is missing, in which order it is read and taken, and in which calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a gap that is read over, of a read, and pages preloaded in a frame.
GAP, READ, PRELOAD = 128 << 10, 4 << 20, 4096


def missing(required: DataFrame, resident: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Required pages that are neither resident nor known to be damaged."""
    return required.join(resident.select("page_id"), "page_id", "left_anti").join(corrupt.select("page_id"), "page_id", "left_anti")


def still_wanted(finished: DataFrame, demand: DataFrame) -> DataFrame:
    """Finished pages that the newest demand still asks for."""
    return finished.join(demand.select("page_id"), "page_id", "left_semi")


def wanted(required: DataFrame, ring: DataFrame, slots: int) -> DataFrame:
    """(page_id, required): the view's pages, and those of the ring around it where both fill at most half of the pool."""
    both = required.select("page_id", F.lit(True).alias("required")).unionByName(ring.join(required.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(False).alias("required")))
    n = required.agg(F.count("*").alias("a")).crossJoin(ring.agg(F.count("*").alias("b")))  # one row
    room = n.select((F.col("a") + F.col("b") <= slots // 2).alias("room"))
    return both.crossJoin(F.broadcast(room)).where("required or room").select("page_id", "required")


def take_order(pages: DataFrame) -> DataFrame:
    """Adds turn: required pages first, then in the order in which they were asked for."""
    return pages.withColumn("turn", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("required"), "seq")) - 1)


def preload(pages: DataFrame, resident: DataFrame, corrupt: DataFrame, slots: int, total: int) -> DataFrame:
    """The next pages to preload: the first that are not there yet, a window's worth, only if the pool can hold all pages."""
    if slots < total:
        return pages.limit(0).select("page_id")
    return missing(pages.select("page_id"), resident, corrupt).orderBy("page_id").limit(PRELOAD)


def read_calls(pages: DataFrame, gap: int = GAP, most: int = READ) -> DataFrame:
    """(call, first, end, pages) per run of demanded pages (run, page_id, offset, bytes): in the order of their place, pages
    are read in one call while the gap between them and the whole read are small enough.

    Gaps cut the pages into stretches; within a stretch calls are cut by their size, one after the other.
    """
    w = Window.partitionBy("run").orderBy("offset")
    far = F.col("offset") > F.lag(F.col("offset") + F.col("bytes")).over(w) + gap
    s = pages.withColumn("stretch", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(w))
    each = s.groupBy("run", "stretch").agg(F.array_sort(F.collect_list(F.struct("offset", "bytes"))).alias("p"))
    kind = "array<struct<first:bigint,end:bigint,pages:bigint>>"

    def step(a, x):
        last, end = F.element_at(a, -1), x["offset"] + x["bytes"]
        fits = end - last["first"] <= most
        grown = F.struct(last["first"].alias("first"), F.greatest(last["end"], end).alias("end"), (last["pages"] + 1).alias("pages"))
        return F.when(fits, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.array_append(a, F.struct(x["offset"].alias("first"), end.alias("end"), F.lit(1).cast("long").alias("pages")))).cast(kind)

    head = F.element_at("p", 1)
    start = F.array(F.struct(head["offset"].alias("first"), (head["offset"] + head["bytes"]).alias("end"), F.lit(1).cast("long").alias("pages"))).cast(kind)
    calls = each.select("run", F.explode(F.aggregate(F.slice("p", 2, F.size("p")), start, step)).alias("c")).select("run", "c.*")
    return calls.withColumn("call", F.row_number().over(Window.partitionBy("run").orderBy("first")) - 1)


def samples(measured: DataFrame, frames: DataFrame) -> DataFrame:
    """Measured times with what their frame did: frames remember the last 8 sequence numbers, so an older one has no record."""
    newest = frames.groupBy("run", (F.col("sequence") % 8).alias("slot")).agg(F.max("sequence").alias("sequence"))
    kept = frames.join(newest.select("run", "sequence"), ["run", "sequence"])
    return measured.join(kept, ["run", "sequence"])
