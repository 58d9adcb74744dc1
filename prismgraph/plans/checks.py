"""Integrity of stored tables: rules as counts of rows that break them, and opening a data set that keeps them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgraph.operators.layout import page_words
from prismgraph.schema import GROUP_PAGES, NO_ERROR_LIMIT, PAGE_RECORDS


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): rows that break each rule."""
    one = df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name) for name, c in rules.items()])
    return one.select(F.expr(f"stack({len(rules)}, " + ", ".join(f"'{k}', {k}" for k in rules) + ") as (rule, rows)"))


def bad_levels() -> Column:
    """A range of levels is in order, or the empty one of pages that are only walked through."""
    return (F.col("min_level") > F.col("max_level")) & ~((F.col("min_level") == NO_ERROR_LIMIT) & (F.col("max_level") == 0))


def page_rules(pages: DataFrame, vertex_counts: DataFrame, records: int) -> DataFrame:
    c = F.col
    p = pages.join(vertex_counts, "page_id", "left")
    return broken(p, {
        "record_count": ~c("record_count").between(1, PAGE_RECORDS),
        "vertex_count": c("vertex_count").isNull() | (c("vertex_count") > 2 * PAGE_RECORDS),
        "levels": bad_levels(),
        "first_record": (c("first_record") < 0) | (c("first_record") + c("record_count") > records),
        "errors": c("min_error") > NO_ERROR_LIMIT,
        "boxes": (c("min_x") > c("max_x")) | (c("min_y") > c("max_y")),
        "words": page_words(c("record_count"), c("vertex_count")) % 4 != 0,
    })


def group_rules(page_groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Groups follow each other and cover the directory."""
    c = F.col
    have = pages.groupBy(F.floor(c("page_id") / GROUP_PAGES).cast("long").alias("group_id")).agg(F.count("*").alias("have"))
    g = page_groups.join(have, "group_id", "full")
    return broken(g, {"first_page": ~F.coalesce(c("first_page") == c("group_id") * GROUP_PAGES, F.lit(False)), "cover": ~F.coalesce(c("have") == c("page_count"), F.lit(False)), "levels": bad_levels()})


def child_rules(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References to children name records that exist; ranks are those of the page's mask."""
    c = F.col
    size = pages.select(c("page_id").alias("p"), c("record_count").alias("n"))
    each = refs.select("page_id", "pos", "rank", F.explode(F.array("child_a", "child_b")).alias("ref")).withColumn("p", F.floor(c("ref") / PAGE_RECORDS))
    j = each.join(size, "p", "left")
    return broken(j, {"child_page": c("ref").isNotNull() & c("n").isNull(), "child_record": c("ref") % PAGE_RECORDS >= c("n"), "rank": (c("rank") < 0) | (c("rank") > c("pos"))})


def whole_pages(paged: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, whole): whether a page's records are those that its entry names; one that is not is left out, not fatal."""
    c = F.col
    have = paged.groupBy("page_id").agg(F.count("*").alias("have"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("places"))
    j = pages.select("page_id", "record_count").join(have, "page_id", "left")
    whole = (c("have") == c("record_count")) & (c("places") == c("record_count")) & (c("first") == 0) & (c("last") == c("record_count") - 1)
    return j.select("page_id", F.coalesce(whole, F.lit(False)).alias("whole"))


def require(found: DataFrame, what: str) -> None:
    """Raises for the first rule that rows break. A row per rule comes to the driver."""
    wrong = [(r.rule, r.rows) for r in found.collect() if r.rows]
    if wrong:
        raise ValueError(f"{what}: " + ", ".join(f"{n} rows break rule {rule}" for rule, n in sorted(wrong)))


def graph_rules(edges: DataFrame) -> DataFrame:
    """Rules of the hierarchy itself."""
    c = F.col
    return broken(edges, {
        "children": c("child_a").isNull() != c("child_b").isNull(),
        "levels": c("death") > c("birth"),
        "height": c("height") > 250,
        "range_level": (c("birth") > 65534) | (c("death") > 65534),
        "code_order": ~c("code").between(0, NO_ERROR_LIMIT),
        "style": ~c("style").between(0, 63),
        "coordinates": (F.abs("source_x") > (1 << 30) - 1) | (F.abs("source_y") > (1 << 30) - 1) | (F.abs("target_x") > (1 << 30) - 1) | (F.abs("target_y") > (1 << 30) - 1),
        "split": c("child_a").isNotNull() & c("split").isNull(),
    })


def references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends and children that do not exist."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).join(nodes.select("node"), "node", "left_anti")
    kids = edges.select(F.explode(F.array("child_a", "child_b")).alias("child")).where("child is not null")
    kids = kids.join(edges.select(F.col("edge").alias("child")), "child", "left_anti")
    count = lambda d, name: d.agg(F.count("*").alias("rows")).select(F.lit(name).alias("rule"), "rows")
    return count(ends, "endpoint").unionByName(count(kids, "child"))
