"""Hierarchy passes: split nodes, heights, errors, styles, contexts, records and counted visits.

Passes go height by height. What a round leaves for another is written once by the height that will read it, so a pass
costs each edge a fixed number of reads however deep the hierarchy is, and a lost executor costs a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgraph.functions.codes import error_code, overlap, style_index
from prismgraph.schema import SCALE
from prismgraph.sources.tables import Mailbox, stored

#: A fixed value: the deepest hierarchy that is taken.
DEEPEST = 250


def split_nodes(edges: DataFrame) -> DataFrame:
    """Adds split, the node that a shortcut bypasses.

    It is the end of child A that is no end of the shortcut, where that is one node; only the rest is joined with child B
    too, for the node that both children have, an inner one first. Children without a common node are an error.
    """
    ends = edges.select(F.col("edge").alias("c"), F.array("source", "target").alias("ends"))
    inner = lambda nodes: F.filter(nodes, lambda n: (n != F.col("source")) & (n != F.col("target")))
    one = edges.join(ends.withColumnsRenamed({"c": "child_a", "ends": "ends_a"}), "child_a", "left")
    alone = F.array_distinct(inner(F.col("ends_a")))
    one = one.withColumn("split", F.when(F.size(alone) == 1, F.get(alone, F.lit(0))))
    open_ = F.col("child_a").isNotNull() & F.col("split").isNull()
    common = F.array_intersect("ends_a", "ends_b")
    unrelated = F.raise_error(F.concat(F.lit("children of shortcut "), F.col("edge").cast("string"), F.lit(" do not share a node"))).cast("long")
    both = one.where(open_).join(ends.withColumnsRenamed({"c": "child_b", "ends": "ends_b"}), "child_b", "left")
    both = both.withColumn("split", F.coalesce(F.get(inner(common), F.lit(0)), F.get(common, F.lit(0)), unrelated))
    return one.where(~open_).drop("ends_a").unionByName(both.drop("ends_a", "ends_b"))


def distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, in map units, as a 32-bit float."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return (F.sqrt(ex * ex + ey * ey) / SCALE).cast("float")


BASE = ["edge", "source", "target", "split", "child_a", "child_b", "type", "birth", "death", "split_level", "source_x", "source_y", "target_x", "target_y", "dist"]


def with_geometry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored: edges with the coordinates of their ends, the split node's level, and its distance from the chord."""
    c = F.col
    level = "level" if "level" in nodes.columns else None
    at = lambda name: nodes.select(c("node").alias(name), c("x").alias(f"{name}_x"), c("y").alias(f"{name}_y"), *([c(level).alias("split_level")] if level and name == "split" else []))
    e = edges.drop("split_level").join(at("source"), "source").join(at("target"), "target").join(at("split"), "split", "left")
    e = e if level else e.withColumn("split_level", F.lit(None).cast("int"))
    e = e.withColumn("dist", F.when(c("child_a").isNotNull(), distance(*map(c, ("split_x", "split_y", "source_x", "source_y", "target_x", "target_y")))))
    return stored(e.select(*BASE), "hierarchy-base")


def measure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds height, err (32-bit), code, style and length, bottom up.

    A finished child tells its parents; a parent is finished in the round in which the second child has told. A round
    reads the links of shortcuts to children, what the last round finished, and parents that still wait for a child.
    """
    c = F.col
    base = with_geometry(nodes, edges)
    length = F.sqrt((c("source_x") - c("target_x")).cast("double") ** 2 + (c("source_y") - c("target_y")).cast("double") ** 2).cast("float")
    sides = F.explode(F.array(F.struct(c("child_a").alias("child"), F.lit(True).alias("first")), F.struct(c("child_b").alias("child"), F.lit(False).alias("first")))).alias("s")
    links = stored(base.where("child_a is not null").select(c("edge").alias("parent"), "dist", sides).select("parent", "dist", "s.*"), "links")
    told = ["height", "err", "style", "length"]
    level = stored(base.where("child_a is null").select("edge", F.lit(0).alias("height"), F.lit(0.0).cast("float").alias("err"), style_index(c("type")).alias("style"), length.alias("length")), "height")
    levels, waiting = [level], None
    for _ in range(DEEPEST + 1):
        news = level.join(links, level["edge"] == links["child"]).select("parent", "dist", "first", F.struct(*told).alias("v"))
        if waiting is not None:
            news = news.unionByName(waiting)
        met = stored(news.groupBy("parent", "dist").agg(F.max(F.when(c("first"), c("v"))).alias("a"), F.max(F.when(~c("first"), c("v"))).alias("b")), "height")
        ready = met.where("a is not null and b is not null")
        same = c("a.style") == c("b.style")
        level = ready.select(
            c("parent").alias("edge"),
            (F.greatest("a.height", "b.height") + 1).alias("height"),
            (c("dist").cast("double") + F.greatest("a.err", "b.err").cast("double")).cast("float").alias("err"),
            F.when(same | (c("a.length") >= c("b.length")), c("a.style")).otherwise(c("b.style")).alias("style"),
            F.when(same, (c("a.length") + c("b.length")).cast("float")).otherwise(F.greatest("a.length", "b.length")).alias("length"),
        )
        waiting = met.where("a is null or b is null").select("parent", "dist", F.col("a").isNotNull().alias("first"), F.coalesce("a", "b").alias("v"))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise ValueError(f"the shortcut hierarchy is deeper than {DEEPEST} levels")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    done = stored(base.join(out, "edge").withColumn("code", error_code(c("err"))), "hierarchy")
    lost = base.where("child_a is not null").join(out, "edge", "left_anti")
    if not waiting.isEmpty() or (len(levels) == 1 and not lost.isEmpty()):
        raise ValueError("shortcuts whose children are missing, or form a cycle")
    return done


def level_rules(edges: DataFrame) -> DataFrame:
    """Shortcuts that break the order of levels: a child that is a shortcut splits at a lower node level than its parent."""
    kids = edges.where("child_a is not null").select(F.col("edge").alias("child"), F.col("split_level").alias("child_level"))
    links = edges.where("child_a is not null").select("edge", "split_level", F.explode(F.array("child_a", "child_b")).alias("child"))
    return links.join(kids, "child").where("child_level >= split_level").select("edge", "child")


LINKS = "edge long, level int, code int, child long, second boolean, child_height int, height int"
SPANS = "edge long, seq int, lo int, hi int, height int"
SENT = "edge long, level int, parent long, seq int, second boolean, lo int, hi int, code int, height int"


def by_height(edges: DataFrame) -> tuple[DataFrame, int]:
    """Stored by the parent's height: links of shortcuts to their children, with the children's heights; and the top."""
    sides = F.explode(F.array(F.struct(F.col("child_a").alias("child"), F.lit(False).alias("second")), F.struct(F.col("child_b").alias("child"), F.lit(True).alias("second")))).alias("s")
    some = edges.where("child_a is not null").select("edge", F.coalesce("split_level", "height").cast("int").alias("level"), "code", sides, "height").select("edge", "level", "code", "s.*", "height")
    kids = edges.select(F.col("edge").alias("child"), F.col("height").alias("child_height"))
    return stored(some.join(kids, "child").select(*[x.split()[0] for x in LINKS.split(", ")]), "links", by=("height",)), edges.agg(F.max("height")).first()[0] or 0


def drawn_levels() -> Column:
    return (F.col("birth") >= 0) & (F.col("death") >= 0) & (F.col("death") <= F.col("birth"))


def merged(sent: DataFrame) -> DataFrame:
    """(edge, all): an edge's contexts as (lo, hi, parent_code), the primary first.

    Contexts come by level of the parent's split node and parent, both descending, in the order of the parent's levels,
    child A before B. The first is primary; it takes in those that adjoin it with the same code, all others stay apart.
    """
    order = F.struct((-F.col("level")).alias("l"), (-F.col("parent")).alias("p"), "seq", "second", "lo", "hi", "code")
    kind = "struct<first:struct<lo:int,hi:int,parent_code:int>,rest:array<struct<lo:int,hi:int,parent_code:int>>>"
    plain = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["code"].alias("parent_code"))

    def fold(a: Column, x: Column) -> Column:
        f = a["first"]
        joins = (x["code"] == f["parent_code"]) & ((x["lo"] == f["hi"] + 1) | (x["hi"] + 1 == f["lo"]))
        grown = F.struct(F.least(x["lo"], f["lo"]).alias("lo"), F.greatest(x["hi"], f["hi"]).alias("hi"), f["parent_code"].alias("parent_code"))
        return F.when(joins, F.struct(grown.alias("first"), a["rest"].alias("rest"))).otherwise(F.struct(f.alias("first"), F.array_append(a["rest"], plain(x)).alias("rest"))).cast(kind)

    each = sent.groupBy("edge").agg(F.array_sort(F.collect_list(order)).alias("s"))
    start = F.struct(plain(F.get("s", F.lit(0))).alias("first"), F.array().cast("array<struct<lo:int,hi:int,parent_code:int>>").alias("rest")).cast(kind)
    folded = each.select("edge", F.aggregate(F.slice("s", 2, F.size("s")), start, fold).alias("f"))
    return folded.select("edge", F.concat(F.array("f.first"), F.col("f.rest")).alias("all"))


def contexts(edges: DataFrame) -> DataFrame:
    """(edge, seq, lo, hi, parent_code): the levels under which an edge is reached, as a multiset; seq 0 is the primary.

    From the top down, an edge's own levels and its merged contexts go to both children, under the edge's code.
    """
    spark = edges.sparkSession
    links, top = by_height(edges)
    sent = Mailbox(spark, SENT, "height", "contexts")
    own = stored(edges.where(drawn_levels() & (F.col("height") > 0)).select("edge", F.lit(-1).alias("seq"), F.col("death").alias("lo"), F.col("birth").alias("hi"), "height"), "alive", by=("height",))
    for height in range(top, 0, -1):
        spans = own.where(F.col("height") == height).select("edge", "seq", "lo", "hi")
        if height < top:
            got = merged(sent.get(height)).select("edge", F.posexplode("all").alias("seq", "x")).select("edge", "seq", "x.lo", "x.hi")
            spans = spans.unionByName(got)
        some = links.where(F.col("height") == height).drop("height").join(spans, "edge")
        sent.put(some.select(F.col("child").alias("edge"), "level", F.col("edge").alias("parent"), "seq", "second", "lo", "hi", "code", F.col("child_height").alias("height")))
    return merged(sent.get()).select("edge", F.posexplode("all").alias("seq", "x")).select("edge", "seq", "x.lo", "x.hi", "x.parent_code")


def records(edges: DataFrame, ctx: DataFrame) -> DataFrame:
    """(edge, code, root_lo, root_hi, child_lo, child_hi, parent_code, representative): the rules for records.

    A primary context that overlaps the edge's own levels moves to a record of its own; contexts under a parent no
    coarser than the edge are dropped. A shortcut that is left without records but is reached below a parent that can be
    expanded gets one that is walked through and never drawn.
    """
    c = F.col
    rest_kind = "array<struct<lo:int,hi:int,parent_code:int>>"
    each = ctx.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("seq", "lo", "hi", "parent_code"))).alias("s"))
    each = each.select("edge", F.transform("s", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["parent_code"].alias("parent_code"))).alias("all"))
    each = each.select("edge", F.get("all", F.lit(0)).alias("first"), F.slice("all", 2, F.size("all")).alias("rest"), F.exists("all", lambda x: x["parent_code"] != 0).alias("expandable"))
    e = edges.select("edge", "code", "child_a", F.when(drawn_levels(), c("death")).alias("root_lo"), F.when(drawn_levels(), c("birth")).alias("root_hi")).join(each, "edge", "left")
    moved = overlap(c("root_lo"), c("root_hi"), c("first.lo"), c("first.hi"))
    rest = F.coalesce("rest", F.array().cast(rest_kind))
    e = e.withColumn("extras", F.filter(F.when(moved, F.concat(F.array("first"), rest)).otherwise(rest), lambda x: c("code") < x["parent_code"]))
    e = e.withColumn("child", F.when(~moved & (c("code") < c("first.parent_code")), c("first")))
    no_main = c("root_lo").isNull() & c("child").isNull()
    main = e.where(~no_main).select("edge", "code", "root_lo", "root_hi", c("child.lo").alias("child_lo"), c("child.hi").alias("child_hi"), F.coalesce("child.parent_code", F.lit(0xFFFF)).alias("parent_code"), F.lit(True).alias("representative"))
    none = F.lit(None).cast("int")
    extra = e.select("*", F.posexplode("extras").alias("n", "x")).select("edge", "code", none.alias("root_lo"), none.alias("root_hi"), c("x.lo").alias("child_lo"), c("x.hi").alias("child_hi"), c("x.parent_code").alias("parent_code"), ((c("n") == 0) & no_main).alias("representative"))
    walk = e.where(no_main & (F.size("extras") == 0) & c("child_a").isNotNull() & c("expandable")).select("edge", "code", *[none.alias(n) for n in ("root_lo", "root_hi", "child_lo", "child_hi")], c("code").alias("parent_code"), F.lit(True).alias("representative"))
    return main.unionByName(extra).unionByName(walk)


def cover(edges: DataFrame, ctx: DataFrame) -> DataFrame:
    """(edge, low, high, gap): hull of an edge's own levels and all contexts, and whether the hull has a hole."""
    spans = edges.where(drawn_levels()).select("edge", F.col("death").alias("lo"), F.col("birth").alias("hi")).unionByName(ctx.select("edge", "lo", "hi"))
    each = spans.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    first = F.get("s", F.lit(0))
    start = F.struct(first["hi"].alias("high"), F.lit(False).alias("gap"))
    folded = F.aggregate("s", start, lambda a, x: F.struct(F.greatest(a["high"], x["hi"]).alias("high"), (a["gap"] | (x["lo"] > a["high"] + 1)).alias("gap")))
    return each.select("edge", first["lo"].alias("low"), folded.alias("f")).select("edge", "low", "f.high", "f.gap")


def visit_counts(edges: DataFrame, level: int, t: int) -> DataFrame:
    """(edge, times): how often a depth-first walk draws each edge. Counts flow from parents to children, a height at a
    time: an expanded shortcut hands its sum to both children, so an edge is one row however often it is reached."""
    spark = edges.sparkSession
    links, top = by_height(edges)
    sent = Mailbox(spark, "edge long, times long, height int", "height", "visits")
    alive = drawn_levels() & F.lit(level).between(F.col("death"), F.col("birth"))
    sent.put(edges.where(alive).select("edge", F.lit(1).cast("long").alias("times"), "height"))
    expands = edges.where((F.col("code") > t) & F.col("child_a").isNotNull()).select("edge")
    drawn = None
    for height in range(top, -1, -1):
        here = sent.get(height).groupBy("edge").agg(F.sum("times").alias("times"))
        kept = here.join(expands, "edge", "left_anti") if height else here
        drawn = kept if drawn is None else drawn.unionByName(kept)
        if height:
            some = links.where((F.col("height") == height) & (F.col("code") > t)).select("edge", "child", F.col("child_height").alias("height"))
            sent.put(here.join(some, "edge").select(F.col("child").alias("edge"), "times", "height"))
    return drawn
