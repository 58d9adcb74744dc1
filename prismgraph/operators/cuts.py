"""Filters and expansions: which records a view draws, by interchangeable strategies that must agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgraph.functions.codes import bound, first_step, in_range
from prismgraph.schema import LARGEST_CODE, TOLERANCE_STEPS
from prismgraph.sources.tables import numbered, stored

Box = tuple[int, int, int, int]
#: Fixed values of the grid: its finest level at most, and edges a cell.
FINEST, EDGES_PER_CELL = 11, 32


def alive(level: int) -> Column:
    return (F.col("birth") >= 0) & (F.col("death") >= 0) & (F.col("death") <= F.col("birth")) & F.lit(level).between(F.col("death"), F.col("birth"))


def in_levels(level: int) -> Column:
    return in_range(level, F.col("root_lo"), F.col("root_hi")) | in_range(level, F.col("child_lo"), F.col("child_hi"))


def drawn(level: int, t: int) -> Column:
    """The dual-interval rule."""
    return (F.col("code") <= t) & (in_range(level, F.col("root_lo"), F.col("root_hi")) | (in_range(level, F.col("child_lo"), F.col("child_hi")) & (F.lit(t) < F.col("parent_code"))))


# Filters: the records of a level.
def full_scan(records: DataFrame, level: int) -> DataFrame:
    return records.where(in_levels(level))


def birth_ordered(records: DataFrame, level: int) -> DataFrame:
    """The records whose highest level reaches the level, a prefix of each page in birth order, then the full test. The
    first condition is a plain comparison, so statistics of row groups skip those that lie below the level."""
    return records.where(F.col("highest") >= level).where(in_levels(level))


def culling(records: DataFrame, pages: DataFrame, may: Column, level: int) -> DataFrame:
    """Zone maps first: pages that may draw, semi-joined; Spark broadcasts them below its threshold."""
    return records.join(pages.where(may).select("page_id"), "page_id", "left_semi").where(in_levels(level))


def two_pass(records: DataFrame, level: int) -> DataFrame:
    """Counts per page, exclusive sums over pages, then each hit's place: output in page order with positions.

    Sums over pages go by ranges of pages first, so no task holds all of them.
    """
    hits = records.where(in_levels(level))
    counts = numbered(hits.groupBy("page_id").count(), "page_id", "_n").withColumn("_part", F.floor(F.col("_n") / 4096))
    within = Window.partitionBy("_part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part").agg(F.sum("count").alias("s"))  # a row for 4096 pages
    parts = parts.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = counts.join(parts, "_part").select("page_id", (F.col("base") + F.coalesce(F.sum("count").over(within), F.lit(0))).alias("first"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return hits.withColumn("rank", rank).join(first, "page_id").withColumn("place", (F.col("first") + F.col("rank")).cast("long")).drop("rank", "first")


FILTERS = ("full_scan", "birth_ordered", "culling", "two_pass")


def candidates(g, name: str, level: int, t: int, at: Box) -> DataFrame:
    """The records of a level by a named filter. All give the same; culling leaves out pages that the view cannot touch."""
    from prismgraph.operators.layout import may_draw

    return {
        "full_scan": lambda: full_scan(g.paged, level),
        "birth_ordered": lambda: birth_ordered(g.paged, level),
        "culling": lambda: culling(g.paged, g.banded, may_draw(at, level, t), level),
        "two_pass": lambda: two_pass(g.paged, level).drop("place"),
    }[name]()


# The loose grid: each edge in one cell, of the finest level whose cells are as large as its grown box.
@dataclass(frozen=True)
class Grid:
    x: int
    y: int
    shift: int
    finest: int


def grid_of(edges: DataFrame) -> Grid:
    r = edges.agg(F.min(F.least("source_x", "target_x")).alias("x0"), F.max(F.greatest("source_x", "target_x")).alias("x1"), F.min(F.least("source_y", "target_y")).alias("y0"), F.max(F.greatest("source_y", "target_y")).alias("y1"), F.count("*").alias("n")).first()
    shift = (max(r.x1 - r.x0, r.y1 - r.y0)).bit_length() if r.n else 0
    finest = 0
    while finest < min(FINEST, shift) and 4 ** (finest + 1) * EDGES_PER_CELL <= r.n:
        finest += 1
    return Grid(r.x0 or 0, r.y0 or 0, shift, finest)


def grown(e: DataFrame) -> DataFrame:
    """Adds the chord's box grown by the error's bound: nothing below an edge lies outside of it."""
    b = bound(F.col("code"))
    return e.withColumns({"min_x": F.least("source_x", "target_x") - b, "min_y": F.least("source_y", "target_y") - b, "max_x": F.greatest("source_x", "target_x") + b, "max_y": F.greatest("source_y", "target_y") + b})


def grid_index(edges: DataFrame, grid: Grid) -> DataFrame:
    """Adds the grown box, grid_level, cell_x and cell_y."""
    c = F.col
    e = grown(edges).withColumn("_size", F.greatest(c("max_x") - c("min_x"), c("max_y") - c("min_y")))
    level = F.lit(0)
    for k in range(1, grid.finest + 1):
        level = F.when(c("_size") <= (1 << (grid.shift - k)), k).otherwise(level)
    cell = lambda lo, hi, origin: F.greatest(F.lit(0), F.least(F.expr(f"shiftleft(1, grid_level) - 1").cast("long"), F.floor((F.floor((lo + hi) / 2) - origin) / F.pow(F.lit(2.0), grid.shift - c("grid_level"))).cast("long")))  # noqa: E731, F541
    e = e.withColumn("grid_level", level.cast("int"))
    return e.withColumns({"cell_x": cell(c("min_x"), c("max_x"), grid.x), "cell_y": cell(c("min_y"), c("max_y"), grid.y)}).drop("_size")


def grid_cull(index: DataFrame, grid: Grid, at: Box) -> DataFrame:
    """Edges whose grown box touches the view: cells of each level that can reach it (a range of a dozen levels), then the box."""
    reach = F.lit(False)
    for k in range(grid.finest + 1):
        size = 1 << (grid.shift - k)
        x0, x1, y0, y1 = ((at[0] - grid.x) // size - 2, (at[2] - grid.x) // size + 1, (at[1] - grid.y) // size - 2, (at[3] - grid.y) // size + 1)
        last = (1 << k) - 1
        clamp = lambda v, last=last: max(0, min(last, v))
        reach = reach | ((F.col("grid_level") == k) & F.col("cell_x").between(clamp(x0), clamp(x1)) & F.col("cell_y").between(clamp(y0), clamp(y1)))
    return index.where(reach & touches(at))


def touches(at: Box) -> Column:
    """A grown box touches a rectangle."""
    c = F.col
    return (c("max_x") >= at[0]) & (c("min_x") <= at[2]) & (c("max_y") >= at[1]) & (c("min_y") <= at[3])


def box_touches(at: Box, grow: Column | int = 0) -> Column:
    c = F.col
    return (F.greatest("source_x", "target_x") >= at[0] - grow) & (F.least("source_x", "target_x") <= at[2] + grow) & (F.greatest("source_y", "target_y") >= at[1] - grow) & (F.least("source_y", "target_y") <= at[3] + grow)


def visible(at: Box) -> Column:
    """Whether any of an edge's geometry can lie in the view: its chord's box grown by the error's bound."""
    return box_touches(at, bound(F.col("code")))


def chord_touches(at: Box) -> Column:
    """Whether a segment meets a rectangle: boxes overlap and the corners do not all lie on one side of the line."""
    c = F.col
    side = lambda x, y: (c("target_x") - c("source_x")) * (F.lit(y).cast("long") - c("source_y")) - (c("target_y") - c("source_y")) * (F.lit(x).cast("long") - c("source_x"))
    sides = [side(x, y).cast("double") for x in (at[0], at[2]) for y in (at[1], at[3])]
    return box_touches(at) & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


# Expansions: the cut of a view as a multiset of edges.
def roots(edges: DataFrame, level: int, t: int = LARGEST_CODE, at: Box | None = None) -> DataFrame:
    some = edges.where(alive(level) & (F.col("code") <= t))
    return (some.where(visible(at)) if at else some).select("edge")


def intervals(records: DataFrame, level: int, t: int) -> DataFrame:
    return records.where(drawn(level, t)).select("edge")


NODE = ["edge", "code", "child_a", "child_b", "source_x", "source_y", "target_x", "target_y"]


def walk_from(edges: DataFrame, starts: DataFrame, t: int, seen: Column | None = None, tags: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(cut, missing) of walks from rows (edge, tags): one frontier per depth; what neither exceeds the tolerance nor has
    children is drawn. seen: which nodes are visited at all. missing: children that are not in the table, once per visit."""
    small = edges.select(*NODE)
    kept = (lambda d: d) if seen is None else (lambda d: d.where(seen))
    frontier = stored(kept(starts.join(small, "edge")), "frontier")
    expands = (F.col("code") > t) & F.col("child_a").isNotNull()
    out, lost = frontier.where(~expands).select("edge", *tags), frontier.limit(0).select("edge", F.col("edge").alias("child"), *tags)
    while True:
        nexts = frontier.where(expands).select(F.col("edge").alias("parent"), F.explode(F.array("child_a", "child_b")).alias("edge"), *tags)
        found = stored(nexts.join(small, "edge", "left"), "frontier")
        if found.isEmpty():
            return out, lost
        lost = lost.unionAll(found.where("code is null").select(F.col("parent").alias("edge"), F.col("edge").alias("child"), *tags))
        frontier = kept(found.where("code is not null"))
        out = out.unionAll(frontier.where(~expands).select("edge", *tags))


def walk(edges: DataFrame, level: int, t: int, at: Box | None = None) -> tuple[DataFrame, DataFrame]:
    """The cut and the missing children of a level. With a view, nodes whose geometry cannot lie in it are not visited."""
    return walk_from(edges, edges.where(alive(level)).select("edge"), t, visible(at) if at else None)


def breadth_first(edges: DataFrame, level: int, t: int, at: Box | None = None) -> DataFrame:
    return walk(edges, level, t, at)[0]


def descend(edges: DataFrame, starts: DataFrame, t: int, seen: Column | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """The cut of walks from rows (edge, tags) by recursive SQL with UNION ALL: an edge reached twice is drawn twice. The
    session's limit of recursive rows is lifted."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    edges.select(*NODE).createOrReplaceTempView("prismgraph_edges")
    starts.createOrReplaceTempView("prismgraph_starts")
    more = "".join(f", {x}" for x in tags)
    walk_ = spark.sql(f"""
        WITH RECURSIVE walk({", ".join(NODE)}{more}) AS (
          SELECT {", ".join("e." + x for x in NODE)}{"".join(f", s.{x}" for x in tags)} FROM prismgraph_starts s JOIN prismgraph_edges e ON e.edge = s.edge
          UNION ALL
          SELECT {", ".join("e." + x for x in NODE)}{"".join(f", w.{x}" for x in tags)}
          FROM (SELECT explode(array(child_a, child_b)) AS child{more} FROM walk WHERE code > {t} AND child_a IS NOT NULL) w
          JOIN prismgraph_edges e ON e.edge = w.child)
        SELECT * FROM walk WHERE NOT (code > {t} AND child_a IS NOT NULL)""")
    return (walk_ if seen is None else walk_.where(seen)).select("edge", *tags)


def depth_first(edges: DataFrame, level: int, t: int, at: Box | None = None) -> DataFrame:
    """With a view, what lies outside of it is dropped: a node whose geometry cannot lie in it has no child that can."""
    return descend(edges, edges.where(alive(level)).select("edge"), t, visible(at) if at else None)


def page_walk(paged: DataFrame, refs: DataFrame, level: int, t: int) -> DataFrame:
    """The cut by walking the pages: from every record whose own levels hold the level, along the references to children."""
    ref = (F.col("page_id") * 256 + F.col("pos")).alias("ref")
    here = refs.select(ref, "child_a", "child_b")
    records = paged.select(ref, "edge", "code", "root_lo", "root_hi", "representative")
    start = records.where(in_range(level, F.col("root_lo"), F.col("root_hi"))).select("ref", "edge", "code").join(here, "ref", "left")
    nodes = stored(records.where("representative").select("ref", "edge", "code").join(here, "ref", "left"), "page-nodes")
    expands = (F.col("code") > t) & F.col("child_a").isNotNull()
    frontier, out = stored(start, "page-frontier"), None
    while True:
        drawn_here = frontier.where(~expands).select("edge")
        out = drawn_here if out is None else out.unionAll(drawn_here)
        nexts = frontier.where(expands).select(F.explode(F.array("child_a", "child_b")).alias("ref"))
        frontier = stored(nexts.join(nodes, "ref"), "page-frontier")
        if frontier.isEmpty():
            return out


def step_counts(records: DataFrame, level: int, base: int, steps: int = TOLERANCE_STEPS) -> DataFrame:
    """Segments per tolerance step: each record counts from the first step that reaches its code to its parent's."""
    hits = records.where(in_levels(level))
    root = in_range(level, F.col("root_lo"), F.col("root_hi"))
    a, b = first_step(F.col("code"), base), F.when(root, F.lit(steps)).otherwise(first_step(F.col("parent_code"), base))
    # one at the first step, minus one behind the last, summed up: two rows a record whatever the number of steps
    change = F.explode(F.array(F.struct(a.alias("step"), F.lit(1).alias("d")), F.struct(b.alias("step"), F.lit(-1).alias("d")))).alias("x")
    sums = hits.where(a < b).select(change).groupBy("x.step").agg(F.sum("x.d").alias("d"))
    every = hits.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    return every.join(sums, "step", "left").select("step", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("step")).alias("segments"))


def limited(found: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """A list of fixed capacity: what fits, in an order, and how many rows it could not take."""
    return found.orderBy(*order).limit(limit), found.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("overflow"))


def by_birth(edges: DataFrame) -> DataFrame:
    """Adds place, the number in the order of birth descending, then edge: edges of a level are a prefix."""
    return numbered(edges.select("edge", "birth", "death", F.struct((-F.col("birth")).alias("b"), "edge").alias("_key")), "_key", "place").drop("_key")


def suffix_counts(edges: DataFrame) -> DataFrame:
    """(birth, edges, at_least): edges of each birth level, and of it or a higher one."""
    counts = edges.groupBy("birth").agg(F.count("*").alias("edges"))  # a row per level
    return counts.withColumn("at_least", F.sum("edges").over(Window.orderBy(F.desc("birth"))))


#: Expansions by name: the mode that gives the threshold, whether it walks, and the cut. The last is the default.
EXPANSIONS = {
    "none": ("none", False, lambda g, level, t, at=None: roots(g.edges, level, LARGEST_CODE, at)),
    "full_bfs": ("full", True, lambda g, level, t, at=None: breadth_first(g.edges, level, 0, at)),
    "adaptive_dfs": ("adaptive", True, lambda g, level, t, at=None: depth_first(g.edges, level, t, at)),
    "adaptive_bfs": ("adaptive", True, lambda g, level, t, at=None: breadth_first(g.edges, level, t, at)),
    "persistent_queue": ("adaptive", True, lambda g, level, t, at=None: breadth_first(g.edges, level, t, at)),
    "workgroup_queue": ("adaptive", True, lambda g, level, t, at=None: breadth_first(g.edges, level, t, at)),
    "dual_interval": ("adaptive", False, lambda g, level, t, at=None: intervals(g.paged, level, t)),
}


def expand(g, name: str, level: int, t: int, at: Box | None = None) -> DataFrame:
    return EXPANSIONS[name][2](g, level, t, at)


def matrix(g, level: int, t: int, at: Box) -> DataFrame:
    """(expansion, filter, cull, segments, edges): every expansion over the candidates of every filter, culled and not, as
    segments in view. Interval rules draw from the candidates; walks begin at those that are roots. All combinations of one
    walk go together, by tags on their rows; the two queues are the breadth-first relation (their scheduling is not Spark's)."""
    tags = ("filter", "cull")
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("cull")
    root = in_range(level, F.col("root_lo"), F.col("root_hi"))
    limits = {"none": LARGEST_CODE, "full": 0, "adaptive": t}
    found: dict[str, DataFrame] = {}
    for mode, limit in limits.items():
        for name in FILTERS:
            some = candidates(g, name, level, limit, at).select("edge", "code", "root_lo", "root_hi", "child_lo", "child_hi", "parent_code", F.lit(name).alias("filter"))
            found[mode] = found[mode].unionAll(some) if mode in found else some
        found[mode] = found[mode].select("*", both)
    # a filter that culls whole pages takes the view's pages only, so walks from its roots lack those beyond; all roots that
    # can be seen are needed, and pages for walks are planned by the grown boxes
    begun = {}
    for mode in ("full", "adaptive"):
        planned = [g.walk_pages(level, limits[mode], at) if name == "culling" else None for name in FILTERS]
        starts = None
        for name, pages in zip(FILTERS, planned, strict=True):
            some = g.paged.join(pages, "page_id", "left_semi") if pages is not None else candidates(g, name, level, limits[mode], at)
            some = some.where(root).select("edge", F.lit(name).alias("filter"), both)
            starts = some if starts is None else starts.unionAll(some)
        begun[mode] = stored(starts, "starts")
    seen = ~F.col("cull") | visible(at)
    cuts = {
        "none": found["none"].where(root & (F.col("code") <= LARGEST_CODE)).select("edge", *tags),
        "dual_interval": found["adaptive"].where(drawn(level, t)).select("edge", *tags),
        "full_bfs": walk_from(g.edges, begun["full"], 0, seen, tags)[0],
        "adaptive_dfs": descend(g.edges, begun["adaptive"], t, seen, tags),
        "adaptive_bfs": walk_from(g.edges, begun["adaptive"], t, seen, tags)[0],
    }
    cuts |= {"persistent_queue": cuts["adaptive_bfs"], "workgroup_queue": cuts["adaptive_bfs"]}
    every = None
    for name in EXPANSIONS:
        some = cuts[name].withColumn("expansion", F.lit(name))
        every = some if every is None else every.unionByName(some)
    segments = every.join(g.edges.select("edge", "source_x", "source_y", "target_x", "target_y"), "edge").where(chord_touches(at))
    return segments.groupBy("expansion", *tags).agg(F.count("*").alias("segments"), F.sum("edge").alias("edges"))
