"""Reports: layout, levels, fill, summaries, timing statistics, suite pivot, sweep and build; and their CSV files."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismgraph.functions.codes import share
from prismgraph.operators.layout import page_words
from prismgraph.schema import PAGE_RECORDS, SCALE


def box_km(metres_per_unit: float) -> Column:
    """The longer side of a page's box."""
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return side / SCALE * metres_per_unit / 1000


def nearest_above(p: float, values: str) -> Column:
    """The report's percentile: element floor(p (n - 1) + 0.5) of the sorted values, from a list of a group's values."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1) + 0.5) + 1).cast("int"))


def layers(pages: DataFrame, vertex_counts: DataFrame, metres_per_unit: float) -> DataFrame:
    """Per quality layer and zoom octave: pages, records, vertices, bytes, and the 50th, 95th and 100th percentile of the boxes.

    Percentiles are read off counts of equal values, ranked by sums over the values of a group.
    """
    p = pages.join(vertex_counts, "page_id").withColumn("km", F.round(box_km(metres_per_unit), 6))
    keys = ["layer", "octave"]
    out = p.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.sum(F.when(F.col("min_level") > F.col("max_level"), 1).otherwise(0)).alias("walk_only_pages"), F.sum("record_count").alias("records"),
        F.sum("vertex_count").alias("vertices"), F.sum(page_words(F.col("record_count"), F.col("vertex_count")) * 4).alias("bytes"), F.max("km").alias("box_km_max"),
    )
    marks = {"box_km_p50": 0.5, "box_km_p95": 0.95}
    return out.join(ranked(p, keys, "km", marks, 0.5), keys).withColumn("fill_percent", F.round(share(F.col("records") / F.col("pages"), F.lit(float(PAGE_RECORDS))), 6))


def levels(pages: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Pages that each level can select, in the directory and in that of traversals: +1 and -1 at the ends of each interval,
    summed up over the levels."""

    def ends(d: DataFrame, name: str) -> DataFrame:
        some = d.where("min_level <= max_level").select(F.explode(F.array(F.struct(F.col("min_level").alias("level"), F.lit(1).alias("d")), F.struct((F.col("max_level") + 1).alias("level"), F.lit(-1).alias("d")))).alias("e"))
        return some.groupBy("e.level").agg(F.sum("e.d").alias(name))  # one row per level

    steps, names = ends(pages, "pages"), ["pages"]
    if visits is not None:
        steps, names = steps.join(ends(visits, "traversal_pages"), "level", "full"), [*names, "traversal_pages"]
    return steps.select("level", *[F.sum(F.coalesce(n, F.lit(0))).over(Window.orderBy("level")).alias(n) for n in names])


def page_fill(pages: DataFrame) -> DataFrame:
    """Eight buckets of fill, empty ones included."""
    spark = pages.sparkSession
    found = pages.groupBy(F.floor(F.col("record_count") * 8 / (PAGE_RECORDS + 1)).cast("long").alias("bucket")).count()
    return spark.range(8).withColumnRenamed("id", "bucket").join(found, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("pages"))


def layout_summary(pages: DataFrame, vertex_counts: DataFrame, metres_per_unit: float) -> DataFrame:
    """One row: pages, records, records a page (mean, 50th and 5th percentile, least), vertices a record, boxes, bytes."""
    p = pages.join(vertex_counts, "page_id").withColumns({"km": F.round(box_km(metres_per_unit), 6), "all": F.lit(1)})
    out = p.groupBy("all").agg(
        F.count("*").alias("pages"), F.sum("record_count").alias("records"), F.round(F.avg("record_count"), 6).alias("mean"), F.min("record_count").alias("least"),
        F.round(F.sum("vertex_count") / F.sum("record_count"), 6).alias("vertices_per_record"), F.max("km").alias("box_km_max"), F.sum(page_words(F.col("record_count"), F.col("vertex_count")) * 4).alias("bytes"),
    )
    out = out.join(ranked(p, ["all"], "record_count", {"p50": 0.5, "p5": 0.05}, 0.5), "all")
    return out.join(ranked(p, ["all"], "km", {"box_km_p50": 0.5, "box_km_p95": 0.95}, 0.5), "all").drop("all")


def ranked(values: DataFrame, keys: list[str], value: str, marks: dict[str, float], half: float) -> DataFrame:
    """The report's (half = 0.5) and the sweep's (half = 0) percentile: element floor(p (n - 1) + half) of the order.

    Equal values are counted before the shuffle. The values of a key then lie in ranges: a range knows from the sums of
    those before it which ranks it holds, so a key with most rows is no task of its own.
    """
    from prismgraph.sources.tables import stored

    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("s"))
    by = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("s").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(by).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    placed = ranged.withColumn("upto", within).join(sums, [*keys, "_part"]).withColumns({"upto": F.col("upto") + F.col("base")})
    at = lambda p: F.floor(F.lit(p) * (F.col("total") - 1) + half)
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in marks.items()])


def timing(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, extremes, nearest-rank 95th and 99th percentile and deviation of each key."""
    nearest = {"p95": 0.95, "p99": 0.99}
    out = values.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.stddev_pop(value), 6).alias("stddev"))
    # element ceil(p n) - 1 of the order is floor(p (n - 1) + half) for no fixed half, so ranks are given as such
    marks = {name: (lambda n, p=p: F.greatest(F.lit(1), F.least(n, F.ceil(F.round(F.lit(p) * n, 9)))) - 1) for name, p in nearest.items()}
    marks |= {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    found = at_ranks(values, keys, value, marks)
    return out.join(found, keys).withColumn("median", F.round((F.col("_low") + F.col("_high")) / 2, 6)).drop("_low", "_high")


def at_ranks(values: DataFrame, keys: list[str], value: str, marks: dict) -> DataFrame:
    """The values at ranks that follow from each key's count."""
    from prismgraph.sources.tables import stored

    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("s"))
    by = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("s").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(by).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    placed = ranged.withColumn("upto", within).join(sums, [*keys, "_part"]).withColumn("upto", F.col("upto") + F.col("base"))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > rank(F.col("total")), F.col(value))).alias(name) for name, rank in marks.items()])


def suite_pivot(values: DataFrame, down: str, across: str, names: list[str], value: str, apart: tuple[str, ...] = ()) -> DataFrame:
    """Expansions down, filters across; one table for each value of the columns apart (culling, measure)."""
    return values.groupBy(*apart, down).pivot(across, names).agg(F.round(F.avg(value), 6))


def sweep(frames: DataFrame) -> DataFrame:
    """Per phase: frames, mean, 95th percentile and largest time, incomplete share, bytes, segments, first complete time."""
    out = frames.groupBy("phase").agg(
        F.count("*").alias("frames"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"), F.max("segments").alias("max_segments"), F.sum("bytes").alias("bytes"),
        F.round(100.0 * F.avg(F.when(F.col("complete"), 0).otherwise(1)), 6).alias("incomplete_pct"), F.min(F.when(F.col("complete"), F.col("at"))).alias("first_complete"),
    )
    return out.join(ranked(frames, ["phase"], "ms", {"p95_ms": 0.95}, 0.0), "phase")


def build(stages: DataFrame, edges: int) -> DataFrame:
    """Share and rate of each stage of a build."""
    return stages.select("stage", "seconds", F.round(share(F.col("seconds"), F.sum("seconds").over(Window.partitionBy())), 6).alias("percent"), F.when(F.col("seconds") > 0, F.round(F.try_divide(F.lit(float(edges)), F.col("seconds")), 3)).alias("edges_per_s"))  # a row per stage


class StageMeter:
    """Seconds of each stage, and the largest memory seen of the driver's Python process."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []
        self.began = time.monotonic()
        self.peak_mib = 0.0

    def done(self, stage: str) -> None:
        import resource

        now = time.monotonic()
        self.rows.append((stage, round(now - self.began, 3)))
        self.began, self.peak_mib = now, max(self.peak_mib, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, seconds double")


def timestamp(in_names: bool = False, at: datetime | None = None) -> str:
    """UTC, to the second; with dashes alone for names of files."""
    return (at or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S" if in_names else "%Y-%m-%d %H:%M:%S")


def field(value) -> str:
    """A CSV field: quoted where it holds a comma, a quote or a line end, which becomes a space."""
    text = "" if value is None else str(value)
    return f'"{text.replace(chr(34), chr(34) * 2).replace(chr(10), " ")}"' if any(c in text for c in ',"\n') else text


def write_csv(spark: SparkSession, path: str, names: list[str], rows: Iterable, append: bool = False) -> None:
    """A report's file; a history grows by rows behind its header, the new file taking the old one's place whole."""
    from prismgraph.sources.tables import _fs

    fs, p = _fs(spark, path)
    lines = [",".join(map(field, names))]
    if append and fs.exists(p):
        stream = fs.open(p)
        lines = bytes(stream.readAllBytes()).decode().splitlines()
        stream.close()
    lines += [",".join(map(field, r)) for r in rows]
    side = _fs(spark, f"{path}.new")[1]
    out = fs.create(side, True)
    out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    out.close()
    fs.delete(p, False)
    fs.rename(side, p)


def write_layout(g, folder: str) -> None:
    """layout_layers, layout_levels, layout_page_fill, layout_sections and layout_summary: a few rows each."""
    spark = g.spark
    counts = g.vertex_counts
    tables = {
        "layout_layers": layers(g.pages, counts, g.metres).orderBy("layer", "octave"),
        "layout_levels": levels(g.pages, g.visits).orderBy("level"),
        "layout_page_fill": page_fill(g.pages).orderBy("bucket"),
        "layout_summary": layout_summary(g.pages, counts, g.metres),
        "layout_sections": g.sections(),
    }
    for name, df in tables.items():
        write_csv(spark, f"{folder}/{name}.csv", df.columns, df.collect())


def write_build(spark: SparkSession, folder: str, meter: StageMeter, facts: dict) -> None:
    """preprocess_stages, and a line of preprocess_history for each build."""
    stages = build(meter.table(spark), facts.get("edges", 0)).collect()
    write_csv(spark, f"{folder}/preprocess_stages.csv", ["stage", "seconds", "percent", "edges_per_s"], stages)
    total = round(sum(s for _, s in meter.rows), 3)
    names = ["time_utc", "seconds", "peak_ram_mib", *facts, *[f"s_{s}" for s, _ in meter.rows]]
    write_csv(spark, f"{folder}/preprocess_history.csv", names, [[timestamp(), total, round(meter.peak_mib), *facts.values(), *[s for _, s in meter.rows]]], append=True)


def append_benchmark(spark: SparkSession, folder: str, context: dict, timings: DataFrame) -> None:
    """A line of benchmark.csv for each metric that has samples."""
    stats = ["n", "mean", "median", "p95", "p99", "min", "max", "stddev"]
    rows = [[timestamp(), *context.values(), r.metric, *[r[s] for s in stats]] for r in timings.where("n > 0").orderBy("metric").collect()]  # a row per metric
    write_csv(spark, f"{folder}/benchmark.csv", ["time_utc", *context, "metric", "samples", *[f"{s}_ms" for s in stats[1:]]], rows, append=True)
