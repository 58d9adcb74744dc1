"""Text sources: graph, ranges and style files, with the rules their rows must keep, up to projected tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.functions.view import fit_projection, fixed, project
from prismgraph.operators.hierarchy import split_nodes
from prismgraph.sources.tables import numbered, stored

NODE_FIELDS = ["node", "osm_id", "lat", "lon", "elevation", "level"]
EDGE_FIELDS = ["source", "target", "weight", "type", "max_speed", "child_a", "child_b"]
RANGE_FIELDS = ["edge", "birth", "death"]


class SourceError(ValueError):
    """A source file breaks a rule; the message names the rule, how many rows break it and one of them."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored: (line, words): the lines that hold words, numbered in file order. White space separates words; # begins a
    comment at a word's start only."""
    text = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("place"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("value", r"(^|[ \t\r\n])#.*$", ""), r"[ \t\r]+", " "))
    some = text.select("place", bare.alias("t")).where("t <> ''").select("place", F.split("t", " ").alias("words"))
    return stored(numbered(some, "place", "line").select("line", "words"), "lines")


def rows_of(found: DataFrame, first: int, count: int, fields: list[str]) -> DataFrame:
    """(row, fields) of `count` rows of len(fields) words each, from the word numbered `first` on.

    Where every line of the part holds one row, lines are rows as they stand; else words are dealt out one by one, since
    a row may span lines freely.
    """
    width = len(fields)
    sized = found.withColumn("n", F.size("words"))
    # the place of each line's first word: sums over ranges of lines
    from pyspark.sql import Window

    part = sized.withColumn("_part", F.floor(F.col("line") / 65536))
    sums = part.groupBy("_part").agg(F.sum("n").alias("s"))  # a row for 65,536 lines
    sums = sums.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = part.withColumn("within", within).join(sums, "_part").withColumn("at", F.col("base") + F.col("within") - first)
    part = placed.where((F.col("at") + F.col("n") > 0) & (F.col("at") < count * width)).select("at", "n", "words")
    odd = part.where((F.col("n") != width) | (F.col("at") % width != 0)).isEmpty()
    if odd:
        return part.select(F.floor(F.col("at") / width).cast("long").alias("row"), *[F.get("words", F.lit(i)).alias(x) for i, x in enumerate(fields)])
    words = part.select("at", F.posexplode("words").alias("i", "word")).withColumn("at", F.col("at") + F.col("i")).where((F.col("at") >= 0) & (F.col("at") < count * width))
    c = F.col("at") % width
    return words.groupBy(F.floor(F.col("at") / width).cast("long").alias("row")).agg(*[F.max(F.when(c == i, F.col("word"))).alias(x) for i, x in enumerate(fields)])


_NUMBER = r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def whole(c: str, lo: int, hi: int) -> tuple[Column, Column]:
    """(value, whether it is an integer within the range)."""
    v = F.when(F.col(c).rlike(r"^-?\d{1,20}$"), F.expr(f"try_cast({c} AS decimal(38,0))"))
    ok = F.coalesce(v.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), F.lit(False))
    return F.when(ok, v), ok


def real(c: str) -> tuple[Column, Column]:
    v = F.when(F.col(c).rlike(_NUMBER), F.expr(f"try_cast({c} AS double)"))
    return v, v.isNotNull()


def significant(c: str) -> Column:
    """Significant digits of a decimal: from the first that is not zero to the last, before any exponent."""
    digits = F.regexp_replace(F.regexp_replace(c, "[eE].*$", ""), r"[^0-9]", "")
    return F.length(F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", ""))


def degrees(c: str) -> tuple[Column, dict[str, Column]]:
    v, ok = real(c)
    return v, {"coordinate": ok & (F.abs(v) <= 180), "significant digits": significant(c) <= 15}


def checked(rows: DataFrame, values: dict[str, Column], rules: dict[str, Column], what: str, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Stored (row, values), and the rows that break rules as (row, rule). strict: such rows are an error."""
    problem = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        problem = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(problem)
    done = stored(rows.select("row", *[v.alias(k) for k, v in values.items()], problem.alias("rule")), "parsed")
    bad = done.where("rule is not null").select("row", "rule")
    if strict and (worst := bad.groupBy("rule").agg(F.count("*").alias("n"), F.min("row").alias("row")).orderBy("row").first()):
        raise SourceError(f"{what}: {worst.n} rows break rule '{worst.rule}', the first is row {worst.row}")
    return done.where("rule is null").drop("rule"), bad


@dataclass
class Source:
    nodes: DataFrame
    edges: DataFrame
    rejects: DataFrame


def read_graph(spark: SparkSession, path: str, strict: bool = True) -> Source:
    """Nodes (6 words each) and edges (7 words each) behind the two counts. Rows that break a rule are an error, or rejects."""
    found = lines(spark, path)
    head = [w for r in found.where("line < 2").orderBy("line").collect() for w in r.words][:2]
    if len(head) < 2 or not all(re.fullmatch(r"\d+", w) for w in head):
        raise SourceError(f"{path}: the file must begin with the counts of nodes and edges")
    n, m = map(int, head)
    if not 0 < n < 2**32 - 1 or not 0 < m < 2**32 - 1:
        raise SourceError(f"{path}: a graph has at least one node and one edge, and fewer than 2^32 - 1 of each")
    have = found.agg(F.sum(F.size("words"))).first()[0]
    if have < 2 + 6 * n + 7 * m:
        raise SourceError(f"{path}: {n} nodes and {m} edges are {2 + 6 * n + 7 * m} words, the file has {have}")
    (node, node_ok), (osm, osm_ok), (level, level_ok) = whole("node", 0, n - 1), whole("osm_id", 0, 2**64 - 1), whole("level", 0, 65535)
    (lat, lat_ok), (lon, lon_ok), (elevation, elevation_ok) = degrees("lat"), degrees("lon"), real("elevation")
    rules = {"node id": node_ok, "node order": node.cast("long") == F.col("row"), "OSM id": osm_ok, **lat_ok, **{f"{k} ": v for k, v in lon_ok.items()}, "elevation": elevation_ok, "node level": level_ok}
    values = {"node": node.cast("long"), "osm_id": osm.cast("decimal(20,0)"), "lat": lat, "lon": lon, "elevation": elevation.cast("float"), "level": level.cast("int")}
    nodes, bad_nodes = checked(rows_of(found, 2, n, NODE_FIELDS), values, rules, path, strict)
    (source, source_ok), (target, target_ok) = whole("source", 0, n - 1), whole("target", 0, n - 1)
    (weight, weight_ok), (kind, kind_ok), (speed, speed_ok) = real("weight"), whole("type", -32768, 32767), whole("max_speed", -32768, 32767)
    (a, a_ok), (b, b_ok) = whole("child_a", -(2**63), m - 1), whole("child_b", -(2**63), m - 1)
    child = lambda v: F.when(v >= 0, v.cast("long"))
    rules = {
        "edge endpoint": source_ok & target_ok, "edge weight": weight_ok & (weight >= 0) & (weight <= 2**32 - 1) & (weight == F.floor(weight)), "edge type": kind_ok, "max speed": speed_ok,
        "child edge": a_ok & b_ok, "only one child": child(a).isNull() == child(b).isNull(),
    }
    values = {"source": source.cast("long"), "target": target.cast("long"), "weight": weight.cast("long"), "type": kind.cast("int"), "max_speed": speed.cast("int"), "child_a": child(a), "child_b": child(b)}
    edges, bad_edges = checked(rows_of(found, 2 + 6 * n, m, EDGE_FIELDS), values, rules, path, strict)
    tag = lambda d, t: d.withColumn("table", F.lit(t))
    return Source(nodes.drop("row"), edges.withColumnRenamed("row", "edge"), tag(bad_nodes, "nodes").unionByName(tag(bad_edges, "edges")))


def read_ranges(spark: SparkSession, path: str, edges: int, strict: bool = True) -> DataFrame:
    """edge, birth, death: as many rows as there are edges, in any order; a later row for an edge overrides the earlier ones."""
    found = lines(spark, path)
    have = found.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if have < 3 * edges:
        raise SourceError(f"{path}: the file must hold a row for each of {edges} edges")
    (edge, edge_ok), (birth, birth_ok), (death, death_ok) = whole("edge", 0, edges - 1), whole("birth", -32768, 65534), whole("death", -32768, 65534)
    rules = {"range edge id": edge_ok, "birth": birth_ok, "death": death_ok}
    rows, _ = checked(rows_of(found, 0, edges, RANGE_FIELDS), {"edge": edge.cast("long"), "birth": birth.cast("int"), "death": death.cast("int")}, rules, path, strict)
    return rows.groupBy("edge").agg(F.max_by(F.struct("birth", "death"), "row").alias("r")).select("edge", "r.birth", "r.death")


def projected(nodes: DataFrame) -> tuple[DataFrame, dict]:
    """Nodes with x and y in fixed units, and the projection that fits them."""
    fit = fit_projection(nodes).first().asDict()
    known = nodes.withColumns({k: F.lit(fit[k]) for k in ("centre_lat", "centre_lon", "lon_scale", "norm")})
    x, y = project(F.col("lat"), F.col("lon"))
    out = known.withColumns({"x": fixed(x), "y": fixed(y)}).drop("centre_lat", "centre_lon", "lon_scale", "norm")
    limit = F.raise_error(F.lit("projected coordinate outside the fixed-point range")).cast("long")
    inside = lambda c: F.when(F.abs(c) <= (1 << 30) - 1, F.col(c)).otherwise(limit)
    return out.withColumns({"x": inside("x"), "y": inside("y")}), fit


def read_dataset(spark: SparkSession, graph: str, ranges: str, strict: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, projection) as the hierarchy passes take them: projected, with ranges (none: -1) and split nodes."""
    source = read_graph(spark, graph, strict)
    m = source.edges.count()
    levels = read_ranges(spark, ranges, m, strict)
    edges = source.edges.join(levels, "edge", "left").withColumns({"birth": F.coalesce("birth", F.lit(-1)), "death": F.coalesce("death", F.lit(-1))})
    nodes, fit = projected(source.nodes)
    return stored(nodes, "nodes"), stored(split_nodes(edges), "edges"), fit


# Fixed values of style files: the widest road in pixels, and the type that stands for all unknown ones.
WIDEST, OTHER_TYPE = 32.0, 63
_COLOUR = r"^.([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """(type, class, index, colour, width) of types 0..63, from lines: class, colour, width in pixels, types; * takes all others.

    A word that begins with # and is no colour begins a comment. A file has few lines; they are checked on the driver.
    """
    classes: list[tuple[str, str, float]] = []
    of_type: dict[int, int] = {}
    others = None
    for number, r in enumerate(spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect(), 1):

        def fail(why: str, number=number):
            raise SourceError(f"{path} line {number}: {why}")

        words = []
        for w in r.value.split():
            if w[0] == "#" and not re.match(_COLOUR, w):
                break
            words.append(w)
        if not words:
            continue
        if len(words) < 4:
            fail("expected a class, a colour, a width and types")
        name, colour, width, *types = words
        if not re.match(_COLOUR, colour):
            fail("a colour is #RRGGBB or #RRGGBBAA")
        if not re.fullmatch(r"\d+\.?\d*|\.\d+", width) or not 0 < float(width) <= WIDEST:
            fail(f"a width is a number of pixels above 0 and at most {WIDEST:g}")
        if len(classes) == 255:
            fail("too many classes")
        for t in types:
            if t == "*":
                if others is not None:
                    fail("only one class can take all other types")
                others = len(classes)
            elif not re.fullmatch(r"\d+", t) or int(t) >= OTHER_TYPE:
                fail(f"type {t} is no number from 0 to {OTHER_TYPE - 1}")
            elif int(t) in of_type:
                fail(f"type {t} is in another class already")
            else:
                of_type[int(t)] = len(classes)
        classes.append((name, colour, float(width)))
    if others is None:
        raise SourceError(f"{path}: one class has to take all other types (*)")
    rows = [(t, *classes[i][:1], i, *classes[i][1:]) for t in range(OTHER_TYPE + 1) for i in [of_type.get(t, others)]]
    return spark.createDataFrame(rows, "type int, class string, index int, colour string, width double")
