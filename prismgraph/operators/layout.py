"""Pages: placement, order, numbering, zone maps, bands, groups, visit maps and references to children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgraph.functions.codes import band_code, bound, decode, interleaved, level_band, record_key
from prismgraph.functions.view import CATCH_ALL, Curve, placed
from prismgraph.schema import BANDS, CODES_PER_TOLERANCE_STEP, GROUP_PAGES, LARGEST_CODE, NO_ERROR_LIMIT, PAGE_RECORDS
from prismgraph.sources.tables import stored


def highest() -> Column:
    return F.greatest(F.coalesce("root_hi", F.lit(0)), F.coalesce("child_hi", F.lit(0)))


def bounds(nodes: DataFrame) -> tuple[int, int, int, int]:
    return tuple(nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())


def place(records: DataFrame, edges: DataFrame, curve: Curve, metres: float, box: tuple[int, int, int, int]) -> DataFrame:
    """Adds coordinates, highest level, layer, octave and key. Of a record's two intervals, the one that is needed in the
    finer quality, then at the farther zoom, places it. Records that are never drawn go to the last layer."""
    c = F.col
    r = records.join(edges.select("edge", "source", "target", "style", "err", "source_x", "source_y", "target_x", "target_y"), "edge")
    err = c("err").cast("double")
    root = F.struct(*[x.alias(n) for x, n in zip(placed(curve, metres, c("root_lo"), c("root_hi"), err, F.lit(float("inf"))), ("layer", "octave"), strict=True)])
    child = F.struct(*[x.alias(n) for x, n in zip(placed(curve, metres, c("child_lo"), c("child_hi"), err, decode(c("parent_code"))), ("layer", "octave"), strict=True)])
    none = F.struct(F.lit(CATCH_ALL).alias("layer"), F.lit(0).alias("octave"))
    has_root, has_child = c("root_lo").isNotNull(), c("child_lo").isNotNull()
    best = F.when(has_root & has_child, F.least(root, child)).when(has_root, root).when(has_child, child).otherwise(none)
    r = r.withColumn("at", best).withColumns({"highest": highest(), "layer": c("at.layer"), "octave": c("at.octave")}).drop("at")
    return r.withColumn("key", record_key(c("layer"), c("octave"), interleaved((c("source_x") + c("target_x")) / 2, (c("source_y") + c("target_y")) / 2, box)))


ORDER = ["key", "edge", "root_lo", "root_hi", "child_lo", "child_hi", "code", "parent_code", "representative"]


def sort_cells(placed_records: DataFrame) -> DataFrame:
    """(cell, records): records by the 20 highest bits of their key, which an external sort would deal out by."""
    return placed_records.groupBy(F.shiftright("key", 20).alias("cell")).agg(F.count("*").alias("records"))


def number_pages(placed_records: DataFrame) -> DataFrame:
    """Adds page_id, pos and record: at most PAGE_RECORDS records of one (layer, octave) bucket, buckets never mix.

    A bucket may hold most records, so it is cut into ranges of the order first; a row's number in its bucket is its
    number in the range plus the ranges before it.
    """
    ranged = stored(placed_records.repartitionByRange(*ORDER).withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_part", "layer", "octave").orderBy(*ORDER)
    counts = ranged.groupBy("layer", "octave", "_part").count()
    before = Window.partitionBy("layer", "octave").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    totals = counts.groupBy("layer", "octave").agg(F.sum("count").alias("n")).withColumn("pages", F.ceil(F.col("n") / PAGE_RECORDS))
    earlier = Window.orderBy("layer", "octave").rowsBetween(Window.unboundedPreceding, -1)  # at most 160 buckets
    first = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    totals = totals.select("layer", "octave", first("pages").alias("_page"), first("n").alias("_record"))
    n = F.row_number().over(w) - 1 + F.col("_before")
    out = ranged.join(F.broadcast(counts.drop("count")), ["layer", "octave", "_part"]).join(F.broadcast(totals), ["layer", "octave"]).withColumn("_n", n)
    return out.withColumns({"page_id": (F.col("_page") + F.floor(F.col("_n") / PAGE_RECORDS)).cast("long"), "pos": (F.col("_n") % PAGE_RECORDS).cast("int"), "record": (F.col("_record") + F.col("_n")).cast("long")}).drop("_part", "_before", "_page", "_record", "_n")


def birth_order(paged: DataFrame) -> DataFrame:
    """Adds birth, the record's place in its page by highest level, then position, both descending."""
    return paged.withColumn("birth", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("highest"), F.desc("pos"))) - 1)


def box(grow: Column | int = 0) -> list[Column]:
    return [
        (F.min(F.least("source_x", "target_x")) - grow).alias("min_x"),
        (F.min(F.least("source_y", "target_y")) - grow).alias("min_y"),
        (F.max(F.greatest("source_x", "target_x")) + grow).alias("max_x"),
        (F.max(F.greatest("source_y", "target_y")) + grow).alias("max_y"),
    ]


def directory(paged: DataFrame) -> DataFrame:
    """Zone map of each page. A page whose records are only walked through has the empty range of levels 65535..0."""
    low = F.least(F.coalesce("root_lo", F.lit(NO_ERROR_LIMIT)), F.coalesce("child_lo", F.lit(NO_ERROR_LIMIT)))
    return paged.groupBy("page_id", "layer", "octave").agg(
        F.count("*").alias("record_count"),
        F.min("record").alias("first_record"),
        F.min(low).cast("int").alias("min_level"),
        F.max("highest").alias("max_level"),
        F.min("code").alias("min_error"),
        F.max(F.when(F.col("root_lo").isNotNull(), NO_ERROR_LIMIT).otherwise(F.col("parent_code"))).alias("max_parent"),
        *box(),
    )


def intervals(paged: DataFrame) -> DataFrame:
    """(page_id, code, lo, hi, p): the level intervals of records, with the parent's code (no limit for roots)."""
    c = F.col
    both = F.array(F.struct(c("root_lo").alias("lo"), c("root_hi").alias("hi"), F.lit(NO_ERROR_LIMIT).alias("p")), F.struct(c("child_lo").alias("lo"), c("child_hi").alias("hi"), c("parent_code").alias("p")))
    return paged.select("page_id", "code", F.explode(both).alias("s")).where("s.lo is not null").select("page_id", "code", "s.*")


def bands(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, band, min_error, max_parent) in band codes: per band of the page's levels, over the bands each interval touches."""
    c = F.col
    band = lambda v: level_band(v, c("min_level"), c("max_level"))
    j = spans.join(pages.select("page_id", "min_level", "max_level"), "page_id").select("page_id", "code", "p", F.explode(F.sequence(band(c("lo")), band(c("hi")))).alias("band"))
    return j.groupBy("page_id", "band").agg(F.min(band_code(c("code"))).alias("min_error"), F.max(band_code(c("p"))).alias("max_parent"))


def with_bands(pages: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds band_min and band_max, arrays by band; a band without records lets nothing through."""
    each = lambda f, name, none: F.array(*[F.coalesce(f(F.when(F.col("band") == b, F.col(name))), F.lit(none)) for b in range(BANDS)])
    arrays = found.groupBy(key).agg(each(F.min, "min_error", 255).alias("band_min"), each(F.max, "max_parent", 0).alias("band_max"))
    empty = lambda none: F.array(*[F.lit(none)] * BANDS)
    return pages.join(arrays, key, "left").withColumns({"band_min": F.coalesce("band_min", empty(255)), "band_max": F.coalesce("band_max", empty(0))})


def visits(paged: DataFrame, ctx: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zone map for traversals, and its bands: levels and parents of every context of a page's representative edges, the
    page's box grown by the largest of their errors, and how many of them have children."""
    c = F.col
    reps = paged.where("representative").join(edges.where("child_a is not null").select("edge", F.lit(1).alias("shortcut")), "edge", "left")
    own = reps.where("root_lo is not null").select("page_id", c("root_lo").alias("lo"), c("root_hi").alias("hi"), F.lit(NO_ERROR_LIMIT).alias("p"))
    reach = own.unionByName(reps.select("page_id", "edge").join(ctx, "edge").select("page_id", "lo", "hi", c("parent_code").alias("p"))).withColumn("code", F.lit(0))
    levels = reach.groupBy("page_id").agg(F.min("lo").alias("min_level"), F.max("hi").alias("max_level"), F.max("p").alias("max_parent"))
    grow = reps.groupBy("page_id").agg(F.count("*").alias("visits"), F.count("shortcut").alias("shortcuts"), bound(F.max("code")).alias("grow"))
    v = paged.groupBy("page_id").agg(F.count("*").alias("record_count"), *box()).join(grow, "page_id", "left").join(levels, "page_id", "left")
    none = F.coalesce("grow", F.lit(0))
    v = v.select(
        "page_id", F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("shortcuts", F.lit(0)).alias("shortcuts"),
        F.coalesce("min_level", F.lit(NO_ERROR_LIMIT)).alias("min_level"), F.coalesce("max_level", F.lit(0)).alias("max_level"), F.lit(0).alias("min_error"), F.coalesce("max_parent", F.lit(0)).alias("max_parent"),
        (c("min_x") - none).alias("min_x"), (c("min_y") - none).alias("min_y"), (c("max_x") + none).alias("max_x"), (c("max_y") + none).alias("max_y"),
    )
    return v, bands(reach, v)


def children(paged: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, pos, edge, rank, child_a, child_b): for each representative of a shortcut, its number among those of the
    page, and where the representatives of its children are (page * 256 + position; null if there is none)."""
    at = paged.where("representative").select("edge", "page_id", "pos", (F.col("page_id") * PAGE_RECORDS + F.col("pos")).alias("ref"))
    ref = lambda x: at.select(F.col("edge").alias(x), F.col("ref").alias(f"{x}_ref"))
    some = at.drop("ref").join(edges.where("child_a is not null").select("edge", "child_a", "child_b"), "edge")
    some = some.join(ref("child_a"), "child_a", "left").join(ref("child_b"), "child_b", "left")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return some.select("page_id", "pos", "edge", rank.alias("rank"), F.col("child_a_ref").alias("child_a"), F.col("child_b_ref").alias("child_b"))


def child_blocks(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, words, first_word): size of each page's block of children (a mask of 8 words, two words a shortcut) and
    where it begins: an exclusive sum over ranges of pages."""
    from prismgraph.sources.tables import numbered

    size = pages.select("page_id").join(refs.groupBy("page_id").count(), "page_id", "left").select("page_id", (8 + 2 * F.coalesce("count", F.lit(0))).alias("words"))
    part = numbered(size, "page_id", "_n").withColumn("_part", F.floor(F.col("_n") / 4096))
    w = Window.partitionBy("_part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("_part").agg(F.sum("words").alias("s"))  # a row for 4096 pages
    sums = sums.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return part.join(sums, "_part").select("page_id", "words", (F.col("base") + F.coalesce(F.sum("words").over(w), F.lit(0))).alias("first_word"))


def vertex_counts(paged: DataFrame) -> DataFrame:
    return paged.select("page_id", F.explode(F.array("source", "target")).alias("node")).groupBy("page_id").agg(F.count_distinct("node").alias("vertex_count"))


def vertices(paged: DataFrame) -> DataFrame:
    """(page_id, node, vertex): the page's nodes numbered in the order of their first use."""
    used = paged.select("page_id", F.posexplode(F.array("source", "target")).alias("end", "node"), "pos")
    first = used.groupBy("page_id", "node").agg(F.min(F.col("pos") * 2 + F.col("end")).alias("first"))
    return first.select("page_id", "node", (F.row_number().over(Window.partitionBy("page_id").orderBy("first")) - 1).alias("vertex"))


def page_words(records: Column, vertex_count: Column) -> Column:
    """Words of a page: header, four a record, two a vertex, a byte of style a record; a multiple of four."""
    return (F.ceil((4 + records * 4 + vertex_count * 2 + F.ceil(records / 4)) / 4) * 4).cast("long")


def groups(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.floor(F.col("page_id") / GROUP_PAGES).cast("long").alias("group_id")).agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("page_count"), F.min("min_level").alias("min_level"), F.max("max_level").alias("max_level"), F.min("min_error").alias("min_error"), F.max("max_parent").alias("max_parent"),
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
    )


def group_bands(page_groups: DataFrame, pages: DataFrame, page_bands: DataFrame) -> DataFrame:
    """(group_id, band, min_error, max_parent): level by level, each page's band into the group's band of that level."""
    c = F.col
    each = pages.where("min_level <= max_level").select("page_id", F.floor(c("page_id") / GROUP_PAGES).cast("long").alias("group_id"), F.explode(F.sequence("min_level", "max_level")).alias("level"), level_band(c("level"), c("min_level"), c("max_level")).alias("band"))
    g = page_groups.select("group_id", c("min_level").alias("lo"), c("max_level").alias("hi"))
    to = each.join(page_bands, ["page_id", "band"]).join(g, "group_id").withColumn("to", level_band(c("level"), c("lo"), c("hi")))
    return to.groupBy("group_id", c("to").alias("band")).agg(F.min("min_error").alias("min_error"), F.max("max_parent").alias("max_parent"))


def may_draw(at: tuple, level, t) -> Column:
    """Whether a page may draw: never false for one that does. Box, level and threshold are values or columns. Needs the bands."""
    x0, y0, x1, y1 = (v if isinstance(v, Column) else F.lit(v) for v in at)
    level, t = (v if isinstance(v, Column) else F.lit(v) for v in (level, t))
    c = F.col
    near = (c("max_x") >= x0) & (c("min_x") <= x1) & (c("max_y") >= y0) & (c("min_y") <= y1)
    fits = near & level.between(c("min_level"), c("max_level")) & (c("min_error") <= t) & (t < c("max_parent"))
    band = F.when(fits, level_band(level, c("min_level"), c("max_level")))
    return fits & band_code(t).between(F.get("band_min", band), F.get("band_max", band))


def plan_pages(page_groups: DataFrame, pages: DataFrame, at, level: int, t: int) -> DataFrame:
    """Groups first, then the pages of those that may draw."""
    some = page_groups.where(may_draw(at, level, t)).select("group_id")
    return pages.withColumn("group_id", F.floor(F.col("page_id") / GROUP_PAGES).cast("long")).join(some, "group_id", "left_semi").where(may_draw(at, level, t))


def plan_views_pages(views: DataFrame, page_groups: DataFrame, pages: DataFrame) -> DataFrame:
    """(view, page_id) of many views (view, box_*, view_level, t): groups by a range join, then an equi-join with the groups'
    pages. Views are a small table; Spark broadcasts them below its threshold and loops over their blocks above it."""
    c = F.col
    at = tuple(c(f"box_{x}") for x in ("min_x", "min_y", "max_x", "max_y"))
    met = page_groups.join(views, may_draw(at, c("view_level"), c("t"))).select("group_id", *views.columns)
    each = pages.withColumn("group_id", F.floor(c("page_id") / GROUP_PAGES).cast("long")).join(met, "group_id")
    return each.where(may_draw(at, c("view_level"), c("t"))).select("view", "page_id")


def search(low: int, high: int, fits) -> int:
    """The value that doubling, then halving the step finds in (low, high]: the least that fits, where fits has no gaps."""
    last, step = high, 1
    while low + step < high:
        if fits(low + step):
            last = low + step
            break
        low, step = low + step, step * 2
    while last - low > 1:
        middle = low + (last - low) // 2
        low, last = (low, middle) if fits(middle) else (middle, last)
    return last


def fit_view(pages: DataFrame, views: list[tuple[tuple, int, int]], limit: int, coarsest: int) -> tuple[int, int, int]:
    """(steps, level, threshold) with which a view's pages fit a pool.

    views: the query (box, level, threshold) as planned, then from 1, 2, .. steps farther away. Where the farthest still
    needs too many pages, the level is raised with the threshold of the nearest view that reaches that level. Counts are
    those of one scan of the zone maps for all steps; the search over them doubles and halves, as counts need not fall.
    """
    far = views[-1]
    every = [(i, *x) for i, x in enumerate(views)]
    counts = pages.agg(*[F.sum(may_draw(at, level, t).cast("long")).alias(f"n{i}") for i, at, level, t in every]).first()
    fits = lambda i: (counts[f"n{i}"] or 0) <= limit
    if fits(0):
        return 0, *views[0][1:]
    steps = search(0, len(views) - 1, fits)
    if fits(steps):
        return steps, *views[steps][1:]
    low = 0
    while steps - low > 1:
        middle = low + (steps - low) // 2
        low, steps = (low, middle) if views[middle][1] == far[1] else (middle, steps)
    at, level, t = views[steps]
    if level < coarsest:
        raised = pages.agg(*[F.sum(may_draw(at, x, t).cast("long")).alias(f"n{x}") for x in range(level + 1, coarsest + 1)]).first()
        level = search(level, coarsest, lambda x: (raised[f"n{x}"] or 0) <= limit)
    return steps, level, t


def coarser(t: int, steps: int) -> int:
    return min(LARGEST_CODE, t + CODES_PER_TOLERANCE_STEP * steps)
