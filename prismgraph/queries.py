"""Registered queries of the engine's own operators, over the hierarchy derived from the events table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.functions import codes, view
from prismgraph.operators import cuts, demand, hierarchy, layout
from prismgraph.plans import checks, report
from prismgraph.sources import catalog, synth
from prismgraph.sources.tables import read_range, scratch, sections, stored
from prismgraph.streaming import frames

LEVEL, T = 3, 25000
BOX = (-200000000, -200000000, 100000000, 150000000)
#: The derived graph has no degrees; its norm and highest level are given.
NORM, HIGHEST = 0.1, 8


@dataclass
class Graph:
    """The stored tables of one data folder; each is built when first asked for."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def base(self):
        return synth.nodes_and_edges(self.spark, self.sf_dir)

    @cached_property
    def metres(self) -> float:
        return view.METRES_PER_DEGREE / NORM

    @cached_property
    def curve(self) -> view.Curve:
        return view.Curve(view.fit_zoom(self.metres), 0, HIGHEST)

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(self.base[0], "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return hierarchy.measure(self.nodes, self.base[1])

    @cached_property
    def contexts(self) -> DataFrame:
        return stored(hierarchy.contexts(self.edges), "contexts-all")

    @cached_property
    def records(self) -> DataFrame:
        return stored(hierarchy.records(self.edges, self.contexts), "records")

    @cached_property
    def paged(self) -> DataFrame:
        box = layout.bounds(self.nodes)
        return stored(layout.number_pages(layout.place(self.records, self.edges, self.curve, self.metres, box)), "paged")

    @cached_property
    def pages(self) -> DataFrame:
        return stored(layout.directory(self.paged), "pages")

    @cached_property
    def bands(self) -> DataFrame:
        return stored(layout.bands(layout.intervals(self.paged), self.pages), "bands")

    @cached_property
    def banded(self) -> DataFrame:
        return stored(layout.with_bands(self.pages, self.bands), "banded")

    @cached_property
    def groups(self) -> DataFrame:
        g = layout.groups(self.pages)
        return stored(layout.with_bands(g, layout.group_bands(g, self.pages, self.bands), "group_id"), "groups")

    @cached_property
    def visit_tables(self) -> tuple[DataFrame, DataFrame]:
        v, b = layout.visits(self.paged, self.contexts, self.edges)
        return stored(v, "visits"), stored(b, "visit-bands")

    @property
    def visits(self) -> DataFrame:
        return self.visit_tables[0]

    @cached_property
    def refs(self) -> DataFrame:
        return stored(layout.children(self.paged, self.edges), "children")

    @cached_property
    def vertex_counts(self) -> DataFrame:
        return stored(layout.vertex_counts(self.paged), "vertices")

    @cached_property
    def grid(self) -> tuple[DataFrame, cuts.Grid]:
        grid = cuts.grid_of(self.edges)
        return stored(cuts.grid_index(self.edges, grid), "grid"), grid

    def walk_pages(self, level: int, t: int, at) -> DataFrame:
        """Pages that a walk of a view can visit."""
        return layout.with_bands(*self.visit_tables).where(layout.may_draw(at, level, t)).select("page_id")

    def sections(self) -> DataFrame:
        folder = {x: scratch(self.spark, x) for x in ("nodes", "edges", "records", "pages")}
        for x, path in folder.items():
            getattr(self, "paged" if x == "records" else x).write.option("compression", "zstd").parquet(path)
        return sections(self.spark, folder)


_GRAPHS: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    key = (spark.sparkContext.applicationId, sf_dir)
    return _GRAPHS.setdefault(key, Graph(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a run per user, in event order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("long").alias("run"), F.col("event_id").cast("long").alias("seq"), F.col("value").alias("ms"), F.lit(0.125).alias("dt"), F.col("event_id").cast("long").alias("at"), (F.floor(F.col("value") * 10) % 3 != 0).alias("complete"), F.col("event_type").alias("kind"), (F.floor(F.col("value") * 10).cast("long") % 97).alias("page"), F.floor(F.col("value") * 10).cast("long").alias("segments"))


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql
        return f

    return add


def _base() -> str:
    """The same graph as common table expressions for the other engine."""
    offset = "(128 - (128 >> {}))"
    levels = "SELECT edge, split, source, target, child_a, child_b, h, type, birth, death, 0::FLOAT AS err, ({style}) AS style, sqrt((sx-tx)::DOUBLE*(sx-tx) + (sy-ty)::DOUBLE*(sy-ty))::FLOAT AS length FROM placed WHERE h = 0"
    out = f"""WITH RECURSIVE
p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, CAST(floor(value * 10) AS BIGINT) AS v, count(*) OVER () AS n FROM events),
node AS (SELECT p AS node, ((p // 65) * 7919) % 5000 * 100000 - 250000000 + (p % 65) * 60000 AS x,
  ((p // 65) * 104729) % 7000 * 70000 - 245000000 + (v % 41 - 20) * 3000 AS y FROM p WHERE p < 65 * (n // 65)),
chain AS (SELECT DISTINCT node // 65 AS c FROM node),
edge0 AS (SELECT c, h, k, c * 127 + {offset.format("h")} + k AS edge, c * 65 + k * (1 << h) AS source, c * 65 + (k + 1) * (1 << h) AS target,
  CASE WHEN h > 0 THEN c * 65 + k * (1 << h) + (1 << h) // 2 END AS split, CASE WHEN h > 0 THEN c * 127 + {offset.format("(h - 1)")} + 2 * k END AS child_a,
  CASE WHEN h > 0 THEN c * 127 + {offset.format("(h - 1)")} + 2 * k + 1 END AS child_b, 1 + (c + k) % 5 AS type,
  CASE WHEN h = 6 THEN 8 WHEN h > 0 AND (c * 31 + h * 17 + k * 13) % 100 < 15 THEN h + 1 ELSE h END AS birth, h AS death,
  CASE WHEN h < 6 THEN c * 127 + {offset.format("(h + 1)")} + k // 2 END AS parent
  FROM chain, (SELECT unnest(range(7))::INT AS h) hs, LATERAL (SELECT unnest(range(64 >> h)) AS k) ks),
placed AS (SELECT e.*, s.x AS sx, s.y AS sy, t.x AS tx, t.y AS ty, m.x AS mx, m.y AS my FROM edge0 e
  JOIN node s ON s.node = e.source JOIN node t ON t.node = e.target LEFT JOIN node m ON m.node = e.split),
along AS (SELECT *, CASE WHEN (tx-sx)::DOUBLE*(tx-sx) + (ty-sy)::DOUBLE*(ty-sy) > 0 THEN greatest(0.0, least(1.0,
  ((mx-sx) * (tx-sx)::DOUBLE + (my-sy) * (ty-sy)::DOUBLE) / ((tx-sx)::DOUBLE*(tx-sx)::DOUBLE + (ty-sy)::DOUBLE*(ty-sy)::DOUBLE))) ELSE 0.0 END AS t FROM placed WHERE h > 0),
dist AS (SELECT edge, (sqrt((mx - (sx + t * (tx-sx)::DOUBLE)) * (mx - (sx + t * (tx-sx)::DOUBLE)) + (my - (sy + t * (ty-sy)::DOUBLE)) * (my - (sy + t * (ty-sy)::DOUBLE))) / 536870912)::FLOAT AS dist FROM along),
m0 AS ({levels.format(style="type")}),
"""
    for h in range(1, 7):
        out += f"""m{h} AS (SELECT e.edge, e.split, e.source, e.target, e.child_a, e.child_b, e.h, e.type, e.birth, e.death,
  (d.dist::DOUBLE + greatest(a.err, b.err)::DOUBLE)::FLOAT AS err,
  CASE WHEN a.style = b.style OR a.length >= b.length THEN a.style ELSE b.style END AS style,
  CASE WHEN a.style = b.style THEN (a.length + b.length)::FLOAT ELSE greatest(a.length, b.length) END AS length
  FROM placed e JOIN dist d USING (edge) JOIN m{h - 1} a ON a.edge = e.child_a JOIN m{h - 1} b ON b.edge = e.child_b WHERE e.h = {h}),
"""
    out += "m AS (" + " UNION ALL ".join(f"SELECT * FROM m{h}" for h in range(7)) + "),\n"
    out += """coded AS (SELECT m.*, p.sx, p.sy, p.tx, p.ty, p.c, p.k, p.parent, CASE WHEN err > 0 THEN greatest(1, least(65534, ceil((log2(err::DOUBLE) + 40) * 1024)))::INT ELSE 0 END AS code FROM m JOIN placed p USING (edge)),
cov6 AS (SELECT edge, -1 AS seq, death AS lo, birth AS hi FROM coded WHERE h = 6),
"""
    # an edge has one parent here, whose own levels, primary and other contexts reach it in this order, all under one code
    for h in range(5, -1, -1):
        out += f"""num{h} AS (SELECT e.edge, q.code AS pc, c.lo, c.hi, row_number() OVER (PARTITION BY e.edge ORDER BY c.seq) AS i FROM coded e JOIN coded q ON q.edge = e.parent JOIN cov{h + 1} c ON c.edge = q.edge WHERE e.h = {h}),
fold{h} AS (SELECT edge, pc, i, lo AS plo, hi AS phi, true AS prim FROM num{h} WHERE i = 1
  UNION ALL SELECT n.edge, n.pc, n.i, CASE WHEN n.hi + 1 = f.plo THEN n.lo ELSE f.plo END, CASE WHEN n.lo = f.phi + 1 THEN n.hi ELSE f.phi END, n.lo = f.phi + 1 OR n.hi + 1 = f.plo
  FROM fold{h} f JOIN num{h} n ON n.edge = f.edge AND n.i = f.i + 1),
ctx{h} AS (SELECT edge, 0 AS seq, arg_max(plo, i) AS lo, arg_max(phi, i) AS hi, pc FROM fold{h} GROUP BY edge, pc
  UNION ALL SELECT n.edge, row_number() OVER (PARTITION BY n.edge ORDER BY n.i) AS seq, n.lo, n.hi, n.pc FROM num{h} n JOIN fold{h} f ON f.edge = n.edge AND f.i = n.i WHERE NOT f.prim),
cov{h} AS (SELECT edge, -1 AS seq, death AS lo, birth AS hi FROM coded WHERE h = {h} UNION ALL SELECT edge, seq, lo, hi FROM ctx{h}),
"""
    out += "ctx AS (" + " UNION ALL ".join(f"SELECT x.edge, e.code, x.seq, x.lo, x.hi, x.pc FROM ctx{h} x JOIN coded e USING (edge)" for h in range(6)) + "),\n"
    return out


_BASE = _base()
_RECORDS = """joined AS (SELECT e.edge, e.code, e.h, e.death, e.birth, f.lo AS plo, f.hi AS phi, f.pc AS ppc, coalesce(e.death <= f.hi AND f.lo <= e.birth, false) AS moved FROM coded e LEFT JOIN ctx f ON f.edge = e.edge AND f.seq = 0),
rec AS (SELECT edge, code, death AS root_lo, birth AS root_hi, CASE WHEN NOT moved AND code < ppc THEN plo END AS child_lo, CASE WHEN NOT moved AND code < ppc THEN phi END AS child_hi,
  CASE WHEN NOT moved AND code < ppc THEN ppc ELSE 65535 END AS parent_code, true AS representative FROM joined
  UNION ALL SELECT edge, code, NULL, NULL, plo, phi, ppc, false FROM joined WHERE moved AND code < ppc
  UNION ALL SELECT r.edge, j.code, NULL, NULL, r.lo, r.hi, r.pc, false FROM ctx r JOIN joined j USING (edge) WHERE r.seq > 0 AND j.code < r.pc),
drawn AS (SELECT * FROM rec WHERE (3 BETWEEN root_lo AND root_hi) IS TRUE OR (3 BETWEEN child_lo AND child_hi) IS TRUE)
"""
_WALK = """walk AS (SELECT edge, code, child_a, child_b FROM coded WHERE {level} BETWEEN death AND birth
  UNION ALL SELECT e.edge, e.code, e.child_a, e.child_b FROM walk w JOIN coded e ON e.edge IN (w.child_a, w.child_b) WHERE w.code > {t} AND w.child_a IS NOT NULL),
cut AS (SELECT edge FROM walk WHERE NOT (code > {t} AND child_a IS NOT NULL))
"""
_CUT = _WALK.format(level=LEVEL, t=T)
_TOUCH = f"greatest(sx, tx) >= {BOX[0]} AND least(sx, tx) <= {BOX[2]} AND greatest(sy, ty) >= {BOX[1]} AND least(sy, ty) <= {BOX[3]}"


def _placed_sql() -> str:
    """Placement and pages. The zooms at which the curve crosses a level follow from its formula, solved for the zoom."""
    import math

    over = 1.5e6 / (111319.49079327357 / NORM)
    cross = {-1: "'infinity'::DOUBLE"}
    for k in range(HIGHEST + 1):
        x = 1 - (k + 0.5) * 9 / 8 / HIGHEST
        cross[k] = repr(over * (1000 / over) ** (x ** (1 / 1.35))) if x >= 0 else "0.0"
    zoom = lambda e: f"(CASE {e} " + " ".join(f"WHEN {k} THEN {z}" for k, z in cross.items()) + " END)"
    octave = lambda z: f"greatest(0, least(31, floor(log2(greatest({z}, {over!r}) / {over!r}))))::INT"
    layer = lambda x: f"CASE WHEN NOT ({x}f < {x}l) OR NOT ({x}low < {x}high) THEN 4 WHEN {x}low <= 1 AND {x}high > 1 THEN 0 WHEN {x}low > 1 THEN least(4, ceil(log2({x}low)))::INT ELSE 4 END"
    assert math.isclose(over, view.fit_zoom(view.METRES_PER_DEGREE / NORM), rel_tol=1e-6)
    pixel = repr(2 * over / 2160)
    return f""", pl AS (SELECT r.*, c.sx, c.sy, c.tx, c.ty, c.source, c.target, c.style, greatest(coalesce(root_hi, 0), coalesce(child_hi, 0)) AS highest, c.err::DOUBLE * {zoom("root_hi")} / {pixel} AS rlow, 'infinity'::DOUBLE AS rhigh,
  {zoom("root_hi")} AS rf, {zoom("root_lo - 1")} AS rl, {zoom("child_hi")} AS cf, {zoom("child_lo - 1")} AS cl, c.err::DOUBLE * {zoom("child_hi")} / {pixel} AS clow, pow(2.0, parent_code / 1024.0 - 40) AS pe FROM rec r JOIN coded c USING (edge)),
pm AS (SELECT *, CASE WHEN isinf(cl) THEN cl ELSE pe * cl / {pixel} END AS chigh FROM pl),
pn AS (SELECT *, {layer("r")} AS rlayer, CASE WHEN rf < rl THEN {octave("rf")} ELSE 0 END AS roct, {layer("c")} AS clayer FROM pm),
po AS (SELECT *, CASE WHEN NOT (cf < cl) THEN 0 WHEN NOT (clow < chigh) OR clayer = 4 THEN {octave("cf")} ELSE {octave(f"greatest(cf, pow(2.0, clayer) * {pixel} / pe)")} END AS coct FROM pn),
lay AS (SELECT *, CASE WHEN root_lo IS NULL OR child_lo IS NOT NULL AND (clayer < rlayer OR clayer = rlayer AND coct < roct) THEN clayer ELSE rlayer END AS layer,
  CASE WHEN root_lo IS NULL OR child_lo IS NOT NULL AND (clayer < rlayer OR clayer = rlayer AND coct < roct) THEN coct ELSE roct END AS octave FROM po),
bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM node),
cell AS (SELECT lay.*, floor(greatest(0.0, least(65535.0, ((sx + tx) / 2.0 - x0) * (65535.0::DOUBLE / greatest(1.0::DOUBLE, x1 - x0)))))::BIGINT AS gx, floor(greatest(0.0, least(65535.0, ((sy + ty) / 2.0 - y0) * (65535.0::DOUBLE / greatest(1.0::DOUBLE, y1 - y0)))))::BIGINT AS gy FROM lay, bx),
mort AS (SELECT *, (layer::BIGINT << 37) | (octave::BIGINT << 32) | list_sum(list_transform(range(16), lambda b: (((gx >> b) & 1) << (2 * b)) + (((gy >> b) & 1) << (2 * b + 1))))::BIGINT AS key FROM cell),
num AS (SELECT *, row_number() OVER (PARTITION BY layer, octave ORDER BY key, edge, root_lo NULLS FIRST, root_hi NULLS FIRST, child_lo NULLS FIRST, child_hi NULLS FIRST, code, parent_code, representative) - 1 AS n, count(*) OVER (PARTITION BY layer, octave) AS bn FROM mort),
bucket AS (SELECT layer, octave, sum(ceil(bn / 256.0)) OVER (ORDER BY layer, octave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page0, sum(bn) OVER (ORDER BY layer, octave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rec0 FROM (SELECT DISTINCT layer, octave, bn FROM num)),
paged AS (SELECT num.*, (coalesce(page0, 0) + n // 256)::BIGINT AS page_id, (n % 256)::INT AS pos, (coalesce(rec0, 0) + n)::BIGINT AS record FROM num JOIN bucket USING (layer, octave)),
pages AS (SELECT page_id, layer::INT AS layer, octave::INT AS octave, count(*) AS record_count, min(record) AS first_record, min(least(coalesce(root_lo, 65535), coalesce(child_lo, 65535)))::INT AS min_level, max(highest)::INT AS max_level,
  min(code)::INT AS min_error, max(CASE WHEN root_lo IS NOT NULL THEN 65535 ELSE parent_code END)::INT AS max_parent, min(least(sx, tx)) AS min_x, min(least(sy, ty)) AS min_y, max(greatest(sx, tx)) AS max_x, max(greatest(sy, ty)) AS max_y
  FROM paged GROUP BY page_id, layer, octave)
"""


_PLACED = _placed_sql()


@query("last AS (SELECT edge FROM coded WHERE 3 BETWEEN death AND birth AND code <= 65534) SELECT edge FROM last")
def roots_cut(spark, sf_dir):
    return cuts.expand(graph(spark, sf_dir), "none", LEVEL, T)


@query(_CUT + "SELECT edge FROM cut")
def dfs_cut(spark, sf_dir):
    return cuts.expand(graph(spark, sf_dir), "adaptive_dfs", LEVEL, T)


@query(_CUT + "SELECT edge FROM cut")
def bfs_cut(spark, sf_dir):
    return cuts.expand(graph(spark, sf_dir), "adaptive_bfs", LEVEL, T)


@query(_CUT + "SELECT edge FROM cut")
def interval_cut(spark, sf_dir):
    return cuts.expand(graph(spark, sf_dir), "dual_interval", LEVEL, T)


@query(_WALK.format(level=LEVEL, t=0) + "SELECT edge FROM cut")
def full_cut(spark, sf_dir):
    return cuts.expand(graph(spark, sf_dir), "full_bfs", LEVEL, T)


@query(_CUT + "SELECT edge FROM cut")
def page_walk(spark, sf_dir):
    """The cut by walking the pages along their references to children."""
    g = graph(spark, sf_dir)
    return cuts.page_walk(g.paged, g.refs, LEVEL, T)


@query("v AS (SELECT edge, code, child_a, child_b, 1::BIGINT AS times FROM coded WHERE 5 BETWEEN death AND birth UNION ALL SELECT e.edge, e.code, e.child_a, e.child_b, w.times FROM v w JOIN coded e ON e.edge IN (w.child_a, w.child_b) WHERE w.code > 25000 AND w.child_a IS NOT NULL) SELECT edge, sum(times)::BIGINT AS times FROM v WHERE NOT (code > 25000 AND child_a IS NOT NULL) GROUP BY edge")
def visit_counts(spark, sf_dir):
    """Reference cuts by counts that flow from parents to children, height by height."""
    return hierarchy.visit_counts(graph(spark, sf_dir).edges, 5, T)


@query("kept AS (SELECT * FROM coded WHERE edge % 11 <> 3), w AS (SELECT edge, code, child_a, child_b FROM kept WHERE 3 BETWEEN death AND birth UNION ALL SELECT e.edge, e.code, e.child_a, e.child_b FROM w JOIN kept e ON e.edge IN (w.child_a, w.child_b) WHERE w.code > 25000 AND w.child_a IS NOT NULL), "
       "r AS (SELECT edge, unnest([child_a, child_b]) AS child FROM w WHERE code > 25000 AND child_a IS NOT NULL) SELECT edge, child FROM r WHERE child % 11 = 3")
def missing_children(spark, sf_dir):
    """A walk over a table from which edges are gone: the children that it misses, once per visit."""
    return cuts.walk(graph(spark, sf_dir).edges.where("edge % 11 <> 3"), LEVEL, T)[1]


_FILTER = "edge, code, root_lo::INT AS root_lo, root_hi::INT AS root_hi, child_lo::INT AS child_lo, child_hi::INT AS child_hi, parent_code::INT AS parent_code"
_COLS = ["edge", "code", "root_lo", "root_hi", "child_lo", "child_hi", "parent_code"]
_TOUCHED = f"max_x >= {BOX[0]} AND min_x <= {BOX[2]} AND max_y >= {BOX[1]} AND min_y <= {BOX[3]}"
_BAND_OF = "(({level} - min_level) * 16 // (max_level - min_level + 1))"
_SPANS = "sp AS (SELECT page_id, code, root_lo AS lo, root_hi AS hi, 65535 AS p FROM paged WHERE root_lo IS NOT NULL UNION ALL SELECT page_id, code, child_lo, child_hi, parent_code FROM paged WHERE child_lo IS NOT NULL)"
_BANDS = f""", {_SPANS},
bd AS (SELECT s.page_id, code, p, unnest(range((lo - min_level) * 16 // (max_level - min_level + 1), (hi - min_level) * 16 // (max_level - min_level + 1) + 1)) AS band FROM sp s JOIN pages USING (page_id)),
bands AS (SELECT page_id, band::INT AS band, min(code >> 8)::INT AS min_error, max(p >> 8)::INT AS max_parent FROM bd GROUP BY 1, 2)
"""
_MAY = f""", may AS (SELECT p.page_id FROM pages p JOIN bands b ON b.page_id = p.page_id AND 3 BETWEEN min_level AND max_level AND b.band = {_BAND_OF.format(level=LEVEL)}
  WHERE {_TOUCHED} AND p.min_error <= {T} AND {T} < p.max_parent AND {T >> 8} BETWEEN b.min_error AND b.max_parent)
"""


@query(_RECORDS + f"SELECT {_FILTER} FROM drawn")
def candidates_full_scan(spark, sf_dir):
    return cuts.full_scan(graph(spark, sf_dir).paged, LEVEL).select(*_COLS)


@query(_RECORDS + f"SELECT {_FILTER} FROM drawn")
def candidates_birth_ordered(spark, sf_dir):
    return cuts.birth_ordered(graph(spark, sf_dir).paged, LEVEL).select(*_COLS)


@query(_RECORDS + _PLACED + _BANDS + _MAY + f"SELECT {_FILTER} FROM paged WHERE page_id IN (SELECT page_id FROM may) AND ((3 BETWEEN root_lo AND root_hi) IS TRUE OR (3 BETWEEN child_lo AND child_hi) IS TRUE)")
def candidates_culling(spark, sf_dir):
    return cuts.candidates(graph(spark, sf_dir), "culling", LEVEL, T, BOX).select(*_COLS)


@query(_RECORDS + _PLACED + "SELECT edge, page_id, pos, row_number() OVER (ORDER BY page_id, pos) - 1 AS place FROM paged WHERE (3 BETWEEN root_lo AND root_hi) IS TRUE OR (3 BETWEEN child_lo AND child_hi) IS TRUE")
def candidates_two_pass(spark, sf_dir):
    return cuts.two_pass(graph(spark, sf_dir).paged, LEVEL).select("edge", "page_id", "pos", "place")


@query(_RECORDS + _PLACED + "SELECT edge, page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY highest DESC, pos DESC) - 1 AS birth FROM paged")
def birth_order(spark, sf_dir):
    return layout.birth_order(graph(spark, sf_dir).paged).select("edge", "page_id", "pos", "birth")


@query("z AS (SELECT edge, row_number() OVER (ORDER BY birth DESC, edge) - 1 AS place FROM coded) SELECT edge, place FROM z")
def edges_by_birth(spark, sf_dir):
    return cuts.by_birth(graph(spark, sf_dir).edges).select("edge", "place")


@query("z AS (SELECT birth::INT AS birth, count(*) AS edges FROM coded GROUP BY 1) SELECT birth, edges, sum(edges) OVER (ORDER BY birth DESC)::BIGINT AS at_least FROM z")
def suffix_counts(spark, sf_dir):
    return cuts.suffix_counts(graph(spark, sf_dir).edges)


_BOUND = "CASE WHEN {0} = 0 THEN 0 ELSE least(1073741823, ceil(pow(2.0, {0} / 1024.0 - 40) * 536870912))::BIGINT END"
_GROWN = f"greatest(sx, tx) >= {BOX[0]} - b AND least(sx, tx) <= {BOX[2]} + b AND greatest(sy, ty) >= {BOX[1]} - b AND least(sy, ty) <= {BOX[3]} + b"


@query(f"z AS (SELECT edge, sx, sy, tx, ty, {_BOUND.format('code')} AS b FROM coded) SELECT edge FROM z WHERE {_GROWN}")
def grid_cull(spark, sf_dir):
    """Edges whose grown boxes touch the view, through cells of many sizes."""
    return cuts.grid_cull(*graph(spark, sf_dir).grid, BOX).select("edge")


def _segments(spark, sf_dir):
    g = graph(spark, sf_dir)
    return cuts.expand(g, "dual_interval", LEVEL, T).join(g.edges, "edge")


_SIDES = ", ".join(f"((tx-sx)*({y}-sy) - (ty-sy)*({x}-sx))::DOUBLE" for x in (BOX[0], BOX[2]) for y in (BOX[1], BOX[3]))
_CHORD = f"{_TOUCH} AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0"


@query(_CUT + f", s AS (SELECT c.* FROM cut JOIN coded c USING (edge)) SELECT edge, sx AS ax, sy AS ay, tx AS bx, ty AS by, style::INT AS type FROM s WHERE {_CHORD}")
def segments_in_view(spark, sf_dir):
    c = F.col
    return _segments(spark, sf_dir).where(cuts.chord_touches(BOX)).select("edge", c("source_x").alias("ax"), c("source_y").alias("ay"), c("target_x").alias("bx"), c("target_y").alias("by"), c("style").alias("type"))


@query(_CUT + f", s AS (SELECT c.* FROM cut JOIN coded c USING (edge)) SELECT edge FROM s WHERE {_TOUCH}")
def segments_culled(spark, sf_dir):
    return _segments(spark, sf_dir).where(cuts.box_touches(BOX)).select("edge")


@query(f"kin AS (SELECT *, {_BOUND.format('code')} AS b FROM coded), walk AS (SELECT edge, code, child_a, child_b FROM kin WHERE 3 BETWEEN death AND birth AND {_GROWN} UNION ALL SELECT e.edge, e.code, e.child_a, e.child_b FROM walk w JOIN kin e ON e.edge IN (w.child_a, w.child_b) AND {_GROWN} WHERE w.code > {T} AND w.child_a IS NOT NULL) SELECT edge FROM walk WHERE NOT (code > {T} AND child_a IS NOT NULL)")
def visible_walk(spark, sf_dir):
    """A walk that leaves out what cannot reach the view."""
    return cuts.expand(graph(spark, sf_dir), "adaptive_bfs", LEVEL, T, BOX)


@query(_RECORDS + """, s AS (SELECT unnest(range(13)) AS step), d AS (SELECT greatest(0, least(13, ceil((code - 24000) / 256.0))) AS a,
  CASE WHEN (3 BETWEEN root_lo AND root_hi) IS TRUE THEN 13 ELSE greatest(0, least(13, ceil((parent_code - 24000) / 256.0))) END AS b FROM drawn)
SELECT step::INT AS step, count(a) AS segments FROM s LEFT JOIN d ON step >= a AND step < b GROUP BY step""")
def step_counts(spark, sf_dir):
    return cuts.step_counts(graph(spark, sf_dir).records, LEVEL, 24000)


@query(_CUT + "SELECT count(*) AS n, sum(edge)::BIGINT AS edges, sum(edge % 1009 * (edge % 997))::BIGINT AS mixed FROM cut")
def cut_checksum(spark, sf_dir):
    return cuts.intervals(graph(spark, sf_dir).records, LEVEL, T).agg(F.count("*").alias("n"), F.sum("edge").alias("edges"), F.sum(F.col("edge") % 1009 * (F.col("edge") % 997)).alias("mixed"))


@query(_RECORDS + "SELECT count(*) AS records, sum((r.edge * 31 + c.style * 7 + c.sx * 13 + c.sy * 17 + c.tx * 19 + c.ty * 23) % 1000003)::BIGINT AS geometry FROM rec r JOIN coded c USING (edge)")
def geometry_checksum(spark, sf_dir):
    """What all records draw, summed whatever their order."""
    c = F.col
    mix = (c("edge") * 31 + c("style") * 7 + c("source_x") * 13 + c("source_y") * 17 + c("target_x") * 19 + c("target_y") * 23) % 1000003
    return graph(spark, sf_dir).paged.agg(F.count("*").alias("records"), F.sum(mix).alias("geometry"))


@query(_CUT + ", c2 AS (SELECT edge FROM coded WHERE 3 BETWEEN death AND birth) SELECT edge, 'missing' AS side FROM (SELECT edge FROM cut EXCEPT ALL SELECT edge FROM c2) UNION ALL SELECT edge, 'extra' FROM (SELECT edge FROM c2 EXCEPT ALL SELECT edge FROM cut)")
def compare_cuts(spark, sf_dir):
    g = graph(spark, sf_dir)
    a, b = cuts.intervals(g.records, LEVEL, T), cuts.roots(g.edges, LEVEL)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionAll(b.exceptAll(a).withColumn("side", F.lit("extra")))


@query(_RECORDS + _PLACED + _BANDS + _MAY + ", here AS (SELECT edge FROM paged WHERE (3 BETWEEN root_lo AND root_hi) IS TRUE OR (3 BETWEEN child_lo AND child_hi) IS TRUE), culled AS (SELECT edge FROM paged WHERE page_id IN (SELECT page_id FROM may) AND ((3 BETWEEN root_lo AND root_hi) IS TRUE OR (3 BETWEEN child_lo AND child_hi) IS TRUE)) SELECT edge, 'culled away' AS side FROM (SELECT edge FROM here EXCEPT ALL SELECT edge FROM culled)")
def compare_candidates(spark, sf_dir):
    """The candidates of a scan against those of culling, both ways: only what lies in pages out of view may differ."""
    g = graph(spark, sf_dir)
    a, b = (cuts.candidates(g, name, LEVEL, T, BOX).select("edge") for name in ("full_scan", "culling"))
    return a.exceptAll(b).withColumn("side", F.lit("culled away")).unionAll(b.exceptAll(a).withColumn("side", F.lit("added")))


def _matrix_sql() -> str:
    walk = "w{0} AS (SELECT edge, code, child_a, child_b FROM coded WHERE 3 BETWEEN death AND birth UNION ALL SELECT e.edge, e.code, e.child_a, e.child_b FROM w{0} w JOIN coded e ON e.edge IN (w.child_a, w.child_b) WHERE w.code > {0} AND w.child_a IS NOT NULL), v{0} AS (SELECT c.* FROM w{0} w JOIN coded c USING (edge) WHERE NOT (w.code > {0} AND w.child_a IS NOT NULL))"
    cut = lambda name, t: f"SELECT '{name}' AS expansion, count(*) AS segments, sum(edge)::BIGINT AS edges FROM v{t} WHERE {_CHORD}"
    modes = {"none": 65534, "full_bfs": 0, **{x: T for x in ("adaptive_dfs", "adaptive_bfs", "persistent_queue", "workgroup_queue", "dual_interval")}}
    return ", ".join(walk.format(t) for t in (0, T, 65534)) + ", mx AS (" + " UNION ALL ".join(cut(n, t) for n, t in modes.items()) + "), f AS (SELECT unnest(['full_scan', 'birth_ordered', 'culling', 'two_pass']) AS filter), c AS (SELECT unnest([false, true]) AS cull) SELECT * FROM mx, f, c"


@query(_matrix_sql())
def expansion_matrix(spark, sf_dir):
    """Every expansion over every filter, culled and not, as edges in view and a sum: the walk of its threshold gives each."""
    return cuts.matrix(graph(spark, sf_dir), LEVEL, T, BOX)


@query(_RECORDS + _PLACED + "SELECT edge, page_id, pos, key, record FROM paged")
def page_numbers(spark, sf_dir):
    return graph(spark, sf_dir).paged.select("edge", "page_id", "pos", "key", "record")


@query(_RECORDS + _PLACED + "SELECT edge, coalesce(root_lo, -1)::INT AS root_lo, coalesce(child_lo, -1)::INT AS child_lo, layer::INT AS layer, octave::INT AS octave FROM lay")
def placement(spark, sf_dir):
    """The layer and octave in which each record is first needed."""
    return graph(spark, sf_dir).paged.select("edge", F.coalesce("root_lo", F.lit(-1)).alias("root_lo"), F.coalesce("child_lo", F.lit(-1)).alias("child_lo"), "layer", "octave")


@query("x AS (SELECT unnest(range(0, 7)) AS k), o AS (SELECT 1500000.0 / (111319.49079327357 / 0.1) AS over) SELECT k::INT AS k, CAST(round(log2(over * pow(1000 / over, pow(1 - (k + 0.5) * 9 / 8 / 8, 1 / 1.35))) * 1000) AS BIGINT) AS octave_milli FROM x, o")
def level_crossings(spark, sf_dir):
    """The zooms at which the level curve falls below k + 0.5, found by bisection, in thousandths of an octave."""
    found = graph(spark, sf_dir).curve.crossings()
    rows = spark.createDataFrame([(k, float(z)) for k, z in zip(range(-1, HIGHEST + 1), found, strict=True) if 0 < z < 1e300], "k int, zoom double")
    return rows.select("k", F.round(codes.log2(F.col("zoom")) * 1000).cast("long").alias("octave_milli"))


@query(_RECORDS + _PLACED + "SELECT key >> 20 AS cell, count(*) AS records FROM mort GROUP BY 1")
def sort_cells(spark, sf_dir):
    return layout.sort_cells(graph(spark, sf_dir).paged)


@query(_RECORDS + _PLACED + "SELECT * FROM pages")
def page_directory(spark, sf_dir):
    return graph(spark, sf_dir).pages


_GROUP_COLS = "(page_id // 64)::BIGINT AS group_id, min(page_id) AS first_page, count(*) AS page_count, min(min_level) AS min_level, max(max_level) AS max_level, min(min_error) AS min_error, max(max_parent) AS max_parent, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y"


@query(_RECORDS + _PLACED + f"SELECT {_GROUP_COLS} FROM pages GROUP BY 1")
def page_groups(spark, sf_dir):
    return layout.groups(graph(spark, sf_dir).pages)


@query(_RECORDS + _PLACED + _BANDS + "SELECT page_id, band, min_error, max_parent FROM bands")
def page_bands(spark, sf_dir):
    return graph(spark, sf_dir).bands


@query(_RECORDS + _PLACED + _BANDS + f""", grp AS (SELECT {_GROUP_COLS} FROM pages GROUP BY 1), lv AS (SELECT page_id, page_id // 64 AS group_id, min_level, max_level, unnest(range(min_level, max_level + 1)) AS level FROM pages),
each AS (SELECT l.group_id, (level - g.min_level) * 16 // (g.max_level - g.min_level + 1) AS band, b.min_error, b.max_parent FROM lv l JOIN bands b ON b.page_id = l.page_id AND b.band = (level - l.min_level) * 16 // (l.max_level - l.min_level + 1) JOIN grp g ON g.group_id = l.group_id)
SELECT group_id::BIGINT AS group_id, band::INT AS band, min(min_error)::INT AS min_error, max(max_parent)::INT AS max_parent FROM each GROUP BY 1, 2""")
def group_bands(spark, sf_dir):
    g = graph(spark, sf_dir)
    return layout.group_bands(layout.groups(g.pages), g.pages, g.bands)


@query(_RECORDS + _PLACED + _BANDS + _MAY + "SELECT page_id FROM may")
def pages_for_query(spark, sf_dir):
    g = graph(spark, sf_dir)
    return layout.plan_pages(g.groups, g.banded, BOX, LEVEL, T).select("page_id")


def _views(spark, sf_dir) -> DataFrame:
    c = F.col
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 401 = 0")
    x, y = (c("user_id") * 7919 % 800 - 400) * 1000000, (c("event_id") * 104729 % 700 - 350) * 1000000
    return e.select(c("event_id").alias("view"), (x - 60000000).alias("box_min_x"), (y - 60000000).alias("box_min_y"), (x + 60000000).alias("box_max_x"), (y + 60000000).alias("box_max_y"), (c("event_id") % 9).cast("int").alias("view_level"), (20000 + c("user_id") % 12 * 1000).cast("int").alias("t"))


@query(_RECORDS + _PLACED + _BANDS + """, vw AS (SELECT event_id AS view, (user_id * 7919 % 800 - 400)::BIGINT * 1000000 AS cx, (event_id * 104729 % 700 - 350)::BIGINT * 1000000 AS cy, (event_id % 9)::INT AS level, (20000 + user_id % 12 * 1000)::INT AS t FROM events WHERE event_id % 401 = 0)
SELECT v.view, p.page_id FROM vw v JOIN pages p ON p.max_x >= cx - 60000000 AND p.min_x <= cx + 60000000 AND p.max_y >= cy - 60000000 AND p.min_y <= cy + 60000000 AND level BETWEEN p.min_level AND p.max_level AND p.min_error <= t AND t < p.max_parent
JOIN bands b ON b.page_id = p.page_id AND b.band = (level - p.min_level) * 16 // (p.max_level - p.min_level + 1) AND (t >> 8) BETWEEN b.min_error AND b.max_parent""")
def pages_for_views(spark, sf_dir):
    """The pages of many views at once."""
    g = graph(spark, sf_dir)
    return layout.plan_views_pages(_views(spark, sf_dir), g.groups, g.banded)


@query()
def fit_views(spark, sf_dir):
    """How much farther away views must be taken from to fit a pool of 20 pages."""
    g = graph(spark, sf_dir)
    far = [(BOX, max(0, 6 - s // 8), layout.coarser(22000, s)) for s in range(65)]
    rows = [(start, *layout.fit_view(g.banded, [(b, max(0, x - start), t) for b, x, t in far], 20, HIGHEST)) for start in (0, 2, 5)]
    return spark.createDataFrame(rows, "start int, steps int, level int, threshold int")


def _cameras(spark, sf_dir) -> DataFrame:
    c = F.col
    v = c("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0").select("event_id", ((c("user_id") % 100 - 50) / 64).alias("x"), ((c("event_id") % 100 - 50) / 64).alias("y"), (F.floor(v) + 2).cast("double").alias("zoom"), F.lit(1600).alias("width"), F.lit(900).alias("height"), F.lit(1.0).alias("pixels"))


@query("""c AS (SELECT event_id, (user_id % 100 - 50) / 64.0 AS x, (event_id % 100 - 50) / 64.0 AS y, floor(value) + 2 AS zoom FROM events WHERE value > 0), k AS (SELECT 111319.49079327357 / 0.1 AS metres),
v AS (SELECT *, 1 / (zoom * metres / 1500000.0)::FLOAT::DOUBLE AS hy, (1500000.0 / metres)::FLOAT::DOUBLE AS over FROM c, k), w AS (SELECT *, hy * 1600 / 900 AS hx, 2 * hy / 900 AS pixel, log2(greatest(over, least(1000.0, zoom)) / over) / log2(1000.0 / over) AS part FROM v),
u AS (SELECT *, round(8.0 / 9.0 * (1 - pow(part, 1.35)) * 8) AS level, (x - hx - 16 * pixel)::FLOAT AS x0, (y + hy + 16 * pixel)::FLOAT AS y1 FROM w)
SELECT event_id, level::INT AS level, floor((log2(pixel) + 40) * 1024)::INT AS tolerance, floor((log2(pixel) + 40) * 1024)::INT AS pixel_code, greatest(-1073741824, least(1073741824, ceil(x0::DOUBLE * 536870912) + 2))::INT AS cull_min_x, greatest(-1073741824, least(1073741824, floor(y1::DOUBLE * 536870912) - 2))::INT AS cull_max_y FROM u""")
def view_plans(spark, sf_dir):
    """Level, codes and cull box of many cameras."""
    g = graph(spark, sf_dir)
    v = view.plan_views(_cameras(spark, sf_dir), g.curve, g.metres)
    box = view.cull_box()
    return v.select("event_id", "level", "tolerance", "pixel_code", box[0], box[3])


@query("c AS (SELECT event_id, (user_id % 100 - 50) / 64.0 AS x, floor(value) + 2 AS zoom FROM events WHERE value > 0), v AS (SELECT *, 1 / (zoom * (111319.49079327357 / 0.1) / 1500000.0)::FLOAT::DOUBLE * 1600 / 900 AS hx FROM c) SELECT event_id, CAST(floor((x - 2 * hx)::FLOAT::DOUBLE * 4096) AS BIGINT) AS ring_left FROM v")
def prefetch_ring(spark, sf_dir):
    """The view grown by half a screen on each side."""
    g = graph(spark, sf_dir)
    v = view.plan_views(_cameras(spark, sf_dir), g.curve, g.metres).select("event_id", *view.ring())
    return v.select("event_id", F.floor(F.col("ring_min_x").cast("double") * 4096).alias("ring_left"))


@query(_RECORDS + _PLACED + ", ends AS (SELECT page_id, source AS node FROM paged UNION ALL SELECT page_id, target FROM paged) SELECT page_id, count(DISTINCT node) AS vertex_count FROM ends GROUP BY page_id")
def page_vertices(spark, sf_dir):
    return graph(spark, sf_dir).vertex_counts


@query(_RECORDS + _PLACED + ", ends AS (SELECT page_id, source AS node, pos * 2 AS used FROM paged UNION ALL SELECT page_id, target, pos * 2 + 1 FROM paged), f AS (SELECT page_id, node, min(used) AS first FROM ends GROUP BY 1, 2) SELECT page_id, node, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS vertex FROM f")
def vertex_order(spark, sf_dir):
    """A page's nodes in the order of their first use."""
    return layout.vertices(graph(spark, sf_dir).paged)


_VISITS = """, reach AS (SELECT page_id, root_lo AS lo, root_hi AS hi, 65535 AS p FROM paged WHERE representative AND root_lo IS NOT NULL UNION ALL SELECT p.page_id, c.lo, c.hi, c.pc FROM paged p JOIN ctx c USING (edge) WHERE p.representative),
lv AS (SELECT page_id, min(lo) AS min_level, max(hi) AS max_level, max(p) AS max_parent FROM reach GROUP BY 1),
gw AS (SELECT page_id, count(*) AS visits, count(c.child_a) AS shortcuts, max(p.code) AS worst FROM paged p JOIN coded c USING (edge) WHERE p.representative GROUP BY 1),
vs AS (SELECT p.page_id, coalesce(visits, 0) AS visits, coalesce(shortcuts, 0) AS shortcuts, coalesce(l.min_level, 65535)::INT AS min_level, coalesce(l.max_level, 0)::INT AS max_level, 0 AS min_error, coalesce(l.max_parent, 0)::INT AS max_parent, min_x, min_y, max_x, max_y, """ + _BOUND.format("coalesce(worst, 0)") + """ AS g
  FROM pages p LEFT JOIN gw USING (page_id) LEFT JOIN lv l ON l.page_id = p.page_id)
"""


@query(_RECORDS + _PLACED + _VISITS + "SELECT page_id, visits, shortcuts, min_level, max_level, min_error, max_parent, min_x - g AS min_x, min_y - g AS min_y, max_x + g AS max_x, max_y + g AS max_y FROM vs")
def visit_directory(spark, sf_dir):
    return graph(spark, sf_dir).visits


@query(_RECORDS + _PLACED + _VISITS + ", e AS (SELECT r.page_id, p, unnest(range((lo - min_level) * 16 // (max_level - min_level + 1), (hi - min_level) * 16 // (max_level - min_level + 1) + 1)) AS band FROM reach r JOIN vs USING (page_id)) SELECT page_id, band::INT AS band, 0 AS min_error, max(p >> 8)::INT AS max_parent FROM e GROUP BY 1, 2")
def visit_bands(spark, sf_dir):
    return graph(spark, sf_dir).visit_tables[1]


_REFS = ", loc AS (SELECT edge, page_id, pos, page_id * 256 + pos AS ref FROM paged WHERE representative), refs AS (SELECT a.page_id, a.pos, a.edge, row_number() OVER (PARTITION BY a.page_id ORDER BY a.pos) - 1 AS rank, x.ref AS child_a, y.ref AS child_b FROM loc a JOIN coded c USING (edge) LEFT JOIN loc x ON x.edge = c.child_a LEFT JOIN loc y ON y.edge = c.child_b WHERE c.child_a IS NOT NULL)\n"


@query(_RECORDS + _PLACED + _REFS + "SELECT * FROM refs")
def child_refs(spark, sf_dir):
    """Where the representatives of a shortcut's children are."""
    return graph(spark, sf_dir).refs


@query(_RECORDS + _PLACED + _REFS + ", w AS (SELECT p.page_id, 8 + 2 * count(r.edge) AS words FROM pages p LEFT JOIN refs r USING (page_id) GROUP BY 1) SELECT page_id, words, (sum(words) OVER (ORDER BY page_id) - words)::BIGINT AS first_word FROM w")
def child_blocks(spark, sf_dir):
    g = graph(spark, sf_dir)
    return layout.child_blocks(g.refs, g.pages)


_KM = "round(greatest(max_x - min_x, max_y - min_y) / 536870912.0::DOUBLE * (111319.49079327357::DOUBLE / 0.1) / 1000, 6)"
_WORDS = "ceil((4 + record_count * 4 + vertex_count * 2 + ceil(record_count / 4.0)) / 4.0) * 16"
_COUNTED = ", ends AS (SELECT page_id, source AS node FROM paged UNION ALL SELECT page_id, target FROM paged), vc AS (SELECT page_id, count(DISTINCT node) AS vertex_count FROM ends GROUP BY 1), pv AS (SELECT *, " + _KM + " AS km FROM pages JOIN vc USING (page_id))"
_PICK = "(list_sort(list({0})))[floor({1} * (count(*) - 1) + 0.5)::INT + 1]"


@query(_RECORDS + _PLACED + _COUNTED + f"SELECT layer, octave, count(*) AS pages, sum(record_count)::BIGINT AS records, sum(CASE WHEN min_level > max_level THEN 1 ELSE 0 END)::BIGINT AS walk_only_pages, sum(vertex_count)::BIGINT AS vertices, sum({_WORDS})::BIGINT AS bytes, max(km) AS box_km_max, {_PICK.format('km', 0.5)} AS box_km_p50, {_PICK.format('km', 0.95)} AS box_km_p95, round(100.0 * (sum(record_count) / count(*)) / 256.0, 6) AS fill_percent FROM pv GROUP BY layer, octave")
def layout_layers(spark, sf_dir):
    g = graph(spark, sf_dir)
    return report.layers(g.pages, g.vertex_counts, g.metres)


@query(_RECORDS + _PLACED + _VISITS + ", lvls AS (SELECT unnest(range(0, 20))::INT AS level) SELECT level, (SELECT count(*) FROM pages WHERE level BETWEEN min_level AND max_level) AS pages, (SELECT count(*) FROM vs WHERE level BETWEEN min_level AND max_level) AS traversal_pages FROM lvls WHERE level IN (SELECT min_level FROM pages) OR level IN (SELECT max_level + 1 FROM pages) OR level IN (SELECT min_level FROM vs) OR level IN (SELECT max_level + 1 FROM vs WHERE min_level <= max_level)")
def layout_levels(spark, sf_dir):
    g = graph(spark, sf_dir)
    return report.levels(g.pages, g.visits)


@query(_RECORDS + _PLACED + ", b AS (SELECT unnest(range(8)) AS bucket) SELECT bucket, (SELECT count(*) FROM pages WHERE record_count * 8 // 257 = bucket) AS pages FROM b")
def layout_page_fill(spark, sf_dir):
    return report.page_fill(graph(spark, sf_dir).pages)


@query(_RECORDS + _PLACED + _COUNTED + f"SELECT count(*) AS pages, sum(record_count)::BIGINT AS records, round(avg(record_count), 6) AS mean, min(record_count) AS least, round(sum(vertex_count) / sum(record_count), 6) AS vertices_per_record, max(km) AS box_km_max, sum({_WORDS})::BIGINT AS bytes, {_PICK.format('record_count', 0.5)} AS p50, {_PICK.format('record_count', 0.05)} AS p5, {_PICK.format('km', 0.5)} AS box_km_p50, {_PICK.format('km', 0.95)} AS box_km_p95 FROM pv")
def layout_summary(spark, sf_dir):
    g = graph(spark, sf_dir)
    return report.layout_summary(g.pages, g.vertex_counts, g.metres)


@query()
def layout_sections(spark, sf_dir):
    """Files and bytes of the stored tables."""
    return graph(spark, sf_dir).sections()


@query("e AS (SELECT event_type AS stage, round(sum(value), 3) AS seconds FROM events GROUP BY 1) SELECT stage, seconds, round(100.0 * seconds / sum(seconds) OVER (), 6) AS percent, round(1000000 / seconds, 3) AS edges_per_s FROM e")
def build_summary(spark, sf_dir):
    stages = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 3).alias("seconds"))
    return report.build(stages, 1000000)


@query(_RECORDS + f"SELECT {_FILTER}, representative FROM rec")
def record_rules(spark, sf_dir):
    return graph(spark, sf_dir).records.select(*_COLS, "representative")


@query("SELECT edge, seq::INT AS seq, lo::INT AS lo, hi::INT AS hi, pc AS parent_code FROM ctx")
def merged_contexts(spark, sf_dir):
    """The levels under which edges are reached; adjoining ones under one code are one."""
    return graph(spark, sf_dir).contexts


@query("s AS (SELECT edge, death AS lo, birth AS hi FROM coded UNION ALL SELECT edge, lo, hi FROM ctx), l AS (SELECT edge, min(lo) AS low, max(hi) AS high, list_distinct(flatten(list(range(lo, hi + 1)))) AS ls FROM s GROUP BY edge) SELECT edge, low::INT AS low, high::INT AS high, len(ls) < high - low + 1 AS gap FROM l")
def cover_hull(spark, sf_dir):
    g = graph(spark, sf_dir)
    return hierarchy.cover(g.edges, g.contexts)


@query("SELECT count(*) AS contexts, sum(lo * 7 + hi * 3 + pc)::BIGINT AS mixed FROM ctx")
def context_counts(spark, sf_dir):
    return graph(spark, sf_dir).contexts.agg(F.count("*").alias("contexts"), F.sum(F.col("lo") * 7 + F.col("hi") * 3 + F.col("parent_code")).alias("mixed"))


@query("SELECT edge, h::INT AS height, code FROM coded")
def height_error(spark, sf_dir):
    return graph(spark, sf_dir).edges.select("edge", "height", "code")


@query("SELECT max(h)::INT AS height, max(birth)::INT AS level FROM coded")
def hierarchy_extent(spark, sf_dir):
    return graph(spark, sf_dir).edges.agg(F.max("height").alias("height"), F.max("birth").cast("int").alias("level"))


@query("SELECT edge, style::INT AS style FROM coded")
def style_fold(spark, sf_dir):
    return graph(spark, sf_dir).edges.select("edge", "style")


@query("SELECT edge, split FROM edge0 WHERE split IS NOT NULL")
def split_nodes(spark, sf_dir):
    return hierarchy.split_nodes(graph(spark, sf_dir).edges.drop("split")).where("split is not null").select("edge", "split")


_DEGREES = "g AS (SELECT node, 47.5 + (y + 250000000) / 1e9::DOUBLE AS lat, 8.0 + (x + 250000000) / 1e9::DOUBLE AS lon FROM node), b AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM g), f AS (SELECT *, (lat0 + lat1) / 2 AS clat, (lon0 + lon1) / 2 AS clon, cos(radians((lat0 + lat1) / 2)) AS ls FROM b), n AS (SELECT *, 0.95 / greatest((lon1 - lon0) / 2 * ls, (lat1 - lat0) / 2, 1e-12) AS norm FROM f)"


def _degrees(spark, sf_dir) -> DataFrame:
    return graph(spark, sf_dir).nodes.select("node", (47.5 + (F.col("y") + 250000000) / 1e9).alias("lat"), (8.0 + (F.col("x") + 250000000) / 1e9).alias("lon"))


@query(_DEGREES + " SELECT round(clat, 9) AS centre_lat, round(clon, 9) AS centre_lon, round(ls, 9) AS lon_scale, round(norm, 6) AS norm, round(111319.49079327357 / norm, 3) AS metres_per_unit FROM n")
def projection_fit(spark, sf_dir):
    """The projection that fits nodes in degrees into the unit square."""
    r = lambda c, d: F.round(c, d).alias(c)
    return view.fit_projection(_degrees(spark, sf_dir)).select(r("centre_lat", 9), r("centre_lon", 9), r("lon_scale", 9), r("norm", 6), r("metres_per_unit", 3))


@query(_DEGREES + " SELECT node, CAST(round(round((lon - clon) * ls * norm * 536870912) / 1024) AS BIGINT) AS x, CAST(round(round((lat - clat) * norm * 536870912) / 1024) AS BIGINT) AS y FROM g, n")
def projected_nodes(spark, sf_dir):
    """Fixed-point places of nodes in degrees, in units of 1024."""
    from prismgraph.sources.graph_text import projected

    nodes, _ = projected(_degrees(spark, sf_dir))
    return nodes.select("node", F.round(F.col("x") / 1024).cast("long").alias("x"), F.round(F.col("y") / 1024).cast("long").alias("y"))


@query("SELECT event_id, CASE WHEN value > 0 THEN greatest(1, least(65534, ceil((log2(value) + 40) * 1024)))::INT ELSE 0 END AS error_code, CASE WHEN value > 0 THEN greatest(0, least(65534, floor((log2(value) + 40) * 1024)))::INT ELSE 0 END AS tolerance_code FROM events")
def error_codes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", codes.error_code(F.col("value")).alias("error_code"), codes.tolerance_code(F.col("value")).alias("tolerance_code"))


@query("SELECT DISTINCT code, " + _BOUND.format("code") + " AS bound FROM coded")
def error_bounds(spark, sf_dir):
    return graph(spark, sf_dir).edges.select("code", codes.bound(F.col("code")).alias("bound")).distinct()


@query("z AS (SELECT event_id, greatest(0.001, value) AS px FROM events) SELECT event_id, greatest(0, least(12, round(4 * log2(px))))::INT AS step, CAST(round((event_id - 300) / 256.0) AS INT) AS of_threshold FROM z")
def tolerance_steps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", codes.nearest_step(F.col("value")).alias("step"), codes.step_of_threshold(F.col("event_id"), F.lit(300)).alias("of_threshold"))


@query(_RECORDS + _PLACED + "SELECT DISTINCT edge, key & 4294967295 AS morton FROM mort")
def morton_keys(spark, sf_dir):
    return graph(spark, sf_dir).paged.select("edge", F.col("key").bitwiseAND(F.lit(4294967295)).alias("morton")).distinct()


@query("SELECT event_id, CAST(round(greatest(0.0, least(9.0, 8.0/9.0 * (1 - pow(greatest(0.0, least(1.0, log2(greatest(1.5, least(1000.0, value))/1.5)/log2(1000.0/1.5))), 1.35)) * 9)) * 64) AS BIGINT) AS level64 FROM events")
def lod_curve(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.round(view.Curve(1.5, 0, 9).column(F.col("value")) * 64).cast("long").alias("level64"))


@query("SELECT event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY 1")
def timing_stats(spark, sf_dir):
    return report.timing(_runs(spark, sf_dir), ["kind"], "ms")


_RANKED = "r AS (SELECT event_type AS kind, value AS {0}, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, floor(0.95 * (count(*) OVER (PARTITION BY event_type) - 1) + {1}) AS k FROM events) SELECT kind, {0} FROM r WHERE i = k"


@query(_RANKED.format("p95", 0.5))
def percentile_rounded(spark, sf_dir):
    return report.ranked(_runs(spark, sf_dir), ["kind"], "ms", {"p95": 0.95}, 0.5)


@query(_RANKED.format("p95", 0.0))
def percentile_floor(spark, sf_dir):
    return report.ranked(_runs(spark, sf_dir), ["kind"], "ms", {"p95": 0.95}, 0.0)


@query("SELECT event_id % 2 = 0 AS cull, (user_id % 7)::BIGINT AS slot, " + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1, 2")
def suite_pivot(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumns({"slot": F.col("run") % 7, "cull": F.col("seq") % 2 == 0})
    return report.suite_pivot(runs, "slot", "kind", ["click", "error", "purchase", "signup", "view"], "ms", ("cull",))


@query("f AS (SELECT event_type AS phase, value AS ms, event_id AS seen, CAST(floor(value * 10) AS BIGINT) % 3 <> 0 AS complete FROM events) SELECT phase, count(*) AS frames, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms, max(CAST(floor(ms * 10) AS BIGINT)) AS max_segments, sum(CAST(floor(ms * 10) AS BIGINT) * 512)::BIGINT AS bytes, round(100.0 * avg(CASE WHEN complete THEN 0 ELSE 1 END), 6) AS incomplete_pct, min(CASE WHEN complete THEN seen END) AS first_complete, (list_sort(list(ms)))[floor(0.95 * (count(*) - 1))::INT + 1] AS p95_ms FROM f GROUP BY 1")
def sweep_summary(spark, sf_dir):
    return report.sweep(_runs(spark, sf_dir).withColumnRenamed("kind", "phase").withColumn("bytes", F.col("segments") * 512))


_FRAMES = "f AS (SELECT user_id::BIGINT AS run, event_id AS seq, value, CAST(floor(value * 10) AS BIGINT) % 3 <> 0 AS complete, CAST(floor(value * 10) AS BIGINT) AS segments FROM events)"


@query(_FRAMES + ", s AS (SELECT *, sum(CASE WHEN NOT complete AND coalesce(pc, true) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq) AS island FROM (SELECT *, lag(complete) OVER (PARTITION BY run ORDER BY seq) AS pc FROM f)) SELECT run, island::BIGINT AS island, min(seq) AS began, min(CASE WHEN complete THEN seq END) AS ended FROM s WHERE island > 0 GROUP BY run, island")
def settle_times(spark, sf_dir):
    return frames.settle_times(_runs(spark, sf_dir))


@query(_FRAMES + " SELECT run, seq, last_value(CASE WHEN complete THEN segments END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM f")
def last_complete(spark, sf_dir):
    return frames.last_complete(_runs(spark, sf_dir), "segments").select("run", "seq", "shown")


@query(_FRAMES + " SELECT run, seq, coalesce(complete <> lag(complete) OVER (PARTITION BY run ORDER BY seq), true) AS recompute FROM f")
def recompute_frames(spark, sf_dir):
    return frames.moved(_runs(spark, sf_dir), ["complete"]).select("run", "seq", "recompute")


@query()
def tolerance_predictive(spark, sf_dir):
    return frames.tolerance(_runs(spark, sf_dir), "predictive", 16.0)


@query(_FRAMES + """, n AS (SELECT run, seq, value / 16.0 - 0.85 AS err, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM f),
w AS (SELECT run, seq, i, err, greatest(0.0::DOUBLE, least(4.0::DOUBLE, err * 0.125)) AS integral FROM n WHERE i = 1 UNION ALL SELECT n.run, n.seq, n.i, n.err, greatest(0.0::DOUBLE, least(4.0::DOUBLE, w.integral + n.err * 0.125)) FROM w JOIN n ON n.run = w.run AND n.i = w.i + 1)
SELECT run, seq, round(greatest(0.0, least(12.0, 2 * err + 3 * integral)))::INT AS step FROM w""")
def tolerance_feedback(spark, sf_dir):
    return frames.tolerance(_runs(spark, sf_dir), "feedback", 16.0)


@query()
def lru_pool(spark, sf_dir):
    """A pool of 8 slots; touches of one frame (four events on end) are pinned together."""
    return frames.lru_pool(_runs(spark, sf_dir).select("run", "seq", "page", F.floor(F.col("seq") / 400).alias("frame")), 8)


@query(_FRAMES + ", mo AS (SELECT run, seq, complete AS moving, max(CASE WHEN complete THEN seq END) OVER (PARTITION BY run ORDER BY seq) AS last, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM f), g AS (SELECT mo.*, l.i AS li FROM mo LEFT JOIN mo l ON l.run = mo.run AND l.seq = mo.last) SELECT run, seq, li IS NOT NULL AND (i - li) * 0.125 < 0.15 AS coarse FROM g")
def motion_coarsening(spark, sf_dir):
    return frames.coarsened(_runs(spark, sf_dir).withColumn("moving", F.col("complete")))


@query(_FRAMES + """, n AS (SELECT run, seq, value + 2 AS target, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM f),
w AS (SELECT run, seq, i, target, 10 + (target - 10) * (1 - exp(-1.4)) AS zoom FROM n WHERE i = 1 UNION ALL SELECT n.run, n.seq, n.i, n.target, w.zoom + (n.target - w.zoom) * (1 - exp(-1.4)) FROM w JOIN n ON n.run = w.run AND n.i = w.i + 1) SELECT run, seq, round(zoom, 2) AS zoom FROM w""")
def camera_easing(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("target", F.col("ms") + 2)
    return frames.eased_zoom(r, 10.0).withColumn("zoom", F.round("zoom", 2))


@query(_FRAMES + """, n AS (SELECT run, seq, complete AS moving, segments * 40000 AS bytes, value + 1 AS ms, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM f),
u AS (SELECT *, bytes >= 1048576 AS counts, CASE WHEN bytes >= 1048576 THEN bytes / ms END AS now FROM n),
w AS (SELECT run, seq, i, moving, 0.0::DOUBLE AS rate, coalesce(now, 0.0) AS after FROM u WHERE i = 1 UNION ALL SELECT u.run, u.seq, u.i, u.moving, w.after, CASE WHEN u.now IS NULL THEN w.after WHEN w.after > 0 THEN 0.8 * w.after + 0.2 * u.now ELSE u.now END FROM w JOIN u ON u.run = w.run AND u.i = w.i + 1)
SELECT run, seq, CASE WHEN rate > 0 THEN greatest(1, least(256, floor(rate * CASE WHEN moving THEN 4 ELSE 12 END / 1048576)))::BIGINT ELSE 16 END AS budget_mib FROM w""")
def upload_budgets(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumns({"moving": F.col("complete"), "bytes": F.col("segments") * 40000, "ms": F.col("ms") + 1})
    return frames.upload_budget(r).select("run", "seq", F.floor(F.col("budget") / (1 << 20)).alias("budget_mib"))


@query(_FRAMES + ", ps AS (SELECT run, seq, unnest(range(13)) AS step, value FROM f), t AS (SELECT run, seq, step, value * pow(0.93, step) AS ms FROM ps) SELECT run, seq, coalesce(min(step) FILTER (ms <= 0.9 * 16.0), 12)::INT AS step FROM t GROUP BY 1, 2")
def first_fitting_step(spark, sf_dir):
    r = _runs(spark, sf_dir).select("run", "seq", F.col("ms").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("step"))
    return frames.first_fitting(r.withColumn("ms", F.col("v") * F.pow(F.lit(0.93), F.col("step"))), 16.0)


@query(_FRAMES + ", s AS (SELECT run, segments % 97 AS page, max(seq) AS last_use, (segments % 97 % 7) * 1000 AS bytes FROM f GROUP BY ALL), t AS (SELECT *, sum(bytes) OVER (PARTITION BY run) AS total, max(last_use) OVER (PARTITION BY run) AS newest, coalesce(sum(CASE WHEN bytes > 0 THEN bytes ELSE 0 END) OVER (PARTITION BY run ORDER BY last_use, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM s) SELECT run, page, bytes::BIGINT AS bytes, last_use FROM t WHERE bytes = 0 OR (last_use < newest AND total - freed > 20000)")
def store_evictions(spark, sf_dir):
    r = _runs(spark, sf_dir)
    slots = r.groupBy("run", "page").agg(F.max("seq").alias("last_use")).withColumn("bytes", F.col("page") % 7 * 1000)
    return frames.evictions(slots, 20000).select("run", "page", "bytes", "last_use")


@query()
def suite_waits(spark, sf_dir):
    return frames.suite_waits(_runs(spark, sf_dir).withColumn("settled", F.col("complete")))


@query()
def sweep_states(spark, sf_dir):
    return frames.sweep_phases(_runs(spark, sf_dir).withColumn("dt", F.lit(0.25)))


@query("z AS (SELECT event_id, event_type AS kind, value AS s, least(1.0, value / 12.0) AS t FROM events WHERE value >= 0) SELECT event_id, CAST(round((CASE kind WHEN 'click' THEN 2.0 * pow(500.0, t) WHEN 'view' THEN 2.0 * pow(500.0, 1 - t) WHEN 'error' THEN 1000.0 ELSE 2.0 END) * 100) AS BIGINT) AS zoom FROM z")
def sweep_targets(spark, sf_dir):
    """The zoom that each phase of the sweep asks for."""
    c = F.col
    phase = F.when(c("event_type") == "click", "zoom in").when(c("event_type") == "view", "zoom out").when(c("event_type") == "error", "hold near").otherwise("overview")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 0")
    return e.select("event_id", F.round(frames.sweep_target(phase, c("value"), 2.0) * 100).cast("long").alias("zoom"))


# Demand paging, over pages that events name.
_ASKED = "a AS (SELECT event_id AS seq, user_id::BIGINT % 50 AS run, CAST(floor(value * 10) AS BIGINT) % 997 AS page_id, event_type AS kind FROM events)"


def _asked(spark, sf_dir) -> DataFrame:
    c = F.col
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(c("event_id").alias("seq"), (c("user_id").cast("long") % 50).alias("run"), (F.floor(c("value") * 10) % 997).alias("page_id"), c("event_type").alias("kind"))


@query(_ASKED + " SELECT DISTINCT page_id FROM a WHERE kind = 'view' AND page_id NOT IN (SELECT page_id FROM a WHERE kind = 'click' AND run < 10) AND page_id NOT IN (SELECT page_id FROM a WHERE kind = 'error' AND run > 40)")
def missing_pages(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return demand.missing(a.where("kind = 'view'").select("page_id").distinct(), a.where("kind = 'click' and run < 10"), a.where("kind = 'error' and run > 40"))


@query(_ASKED + " SELECT seq, page_id FROM a WHERE kind = 'purchase' AND page_id IN (SELECT page_id FROM a WHERE kind = 'signup')")
def pages_still_wanted(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return demand.still_wanted(a.where("kind = 'purchase'").select("seq", "page_id"), a.where("kind = 'signup'"))


@query(_ASKED + ", v AS (SELECT DISTINCT page_id FROM a WHERE kind = 'view' AND run < 2), r AS (SELECT DISTINCT page_id FROM a WHERE run < 3), n AS (SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM r) AS n) SELECT page_id, true AS required FROM v UNION ALL SELECT page_id, false FROM r, n WHERE page_id NOT IN (SELECT page_id FROM v) AND n <= 2000")
def pages_with_ring(spark, sf_dir):
    """The view's pages, and those of the ring where the pool has room for both twice over."""
    a = _asked(spark, sf_dir)
    return demand.wanted(a.where("kind = 'view' and run < 2").select("page_id").distinct(), a.where("run < 3").select("page_id").distinct(), 4000)


@query(_ASKED + " SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY (kind = 'view') DESC, seq) - 1 AS turn FROM a")
def take_order(spark, sf_dir):
    return demand.take_order(_asked(spark, sf_dir).withColumn("required", F.col("kind") == "view")).select("run", "seq", "turn")


@query(_ASKED + ", x AS (SELECT DISTINCT page_id FROM a WHERE page_id NOT IN (SELECT page_id FROM a WHERE kind = 'click' AND run < 3)) SELECT page_id FROM x ORDER BY page_id LIMIT 4096")
def preload_window(spark, sf_dir):
    a = _asked(spark, sf_dir)
    return demand.preload(a.select("page_id").distinct(), a.where("kind = 'click' and run < 3").select("page_id"), a.limit(0).select("page_id"), 1000, 997)


@query(_ASKED + """, pg AS (SELECT DISTINCT run, page_id * 100000 + page_id % 7 * 9000 AS off, 3000 + page_id % 13 * 500 AS bytes FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY off) AS i FROM pg),
w AS (SELECT run, i, off, bytes, off AS first, off + bytes AS last, 1 AS call FROM n WHERE i = 1 UNION ALL
  SELECT n.run, n.i, n.off, n.bytes, CASE WHEN n.off > w.last + 131072 OR n.off + n.bytes - w.first > 4194304 THEN n.off ELSE w.first END, CASE WHEN n.off > w.last + 131072 OR n.off + n.bytes - w.first > 4194304 THEN n.off + n.bytes ELSE greatest(w.last, n.off + n.bytes) END,
  w.call + CASE WHEN n.off > w.last + 131072 OR n.off + n.bytes - w.first > 4194304 THEN 1 ELSE 0 END FROM w JOIN n ON n.run = w.run AND n.i = w.i + 1)
SELECT run, call - 1 AS call, first, max(last) AS "end", count(*) AS pages FROM w GROUP BY 1, 2, 3""")
def read_calls(spark, sf_dir):
    """Demanded pages in as few reads as gaps and sizes allow."""
    c = F.col
    p = _asked(spark, sf_dir).select("run", "page_id").distinct()
    return demand.read_calls(p.select("run", "page_id", (c("page_id") * 100000 + c("page_id") % 7 * 9000).alias("offset"), (3000 + c("page_id") % 13 * 500).alias("bytes")))


@query(_ASKED + ", f AS (SELECT run, seq AS sequence, page_id AS step FROM a WHERE kind = 'view'), k AS (SELECT *, max(sequence) OVER (PARTITION BY run, sequence % 8) AS newest FROM f), mt AS (SELECT DISTINCT run, sequence, sequence % 100 AS ms FROM f) SELECT mt.run, mt.sequence, mt.ms, k.step FROM mt JOIN k ON k.run = mt.run AND k.sequence = mt.sequence AND k.sequence = k.newest")
def frame_samples(spark, sf_dir):
    """Measured frames with what they drew; only the newest of each slot are remembered."""
    f = _asked(spark, sf_dir).where("kind = 'view'").select("run", F.col("seq").alias("sequence"), F.col("page_id").alias("step"))
    return demand.samples(f.select("run", "sequence", (F.col("sequence") % 100).alias("ms")).distinct(), f)


@query(_ASKED + " SELECT greatest(count(*) - 100, 0) AS overflow FROM a")
def list_overflow(spark, sf_dir):
    """How many rows a list of a hundred could not take."""
    return cuts.limited(_asked(spark, sf_dir), ["seq"], 100)[1]


@query(_ASKED + " SELECT seq FROM a ORDER BY seq LIMIT 100")
def list_kept(spark, sf_dir):
    return cuts.limited(_asked(spark, sf_dir), ["seq"], 100)[0].select("seq")


# A folder's listing, as events name it.
_LISTING = "l AS (SELECT DISTINCT 'd' || (user_id % 13) || '/g' || (event_id % 500) || CASE event_type WHEN 'click' THEN '.sch' WHEN 'view' THEN '.sch.ranges' WHEN 'purchase' THEN '.prism' WHEN 'signup' THEN '.sch.bz2' ELSE '' END AS path FROM events)"


@query(_LISTING + """, g AS (SELECT path FROM l WHERE NOT ends_with(path, '.prism') AND NOT ends_with(path, '.ranges') AND NOT ends_with(path, '.bz2') AND path || '.ranges' IN (SELECT path FROM l)),
b AS (SELECT path AS name, path AS graph, path || '.ranges' AS ranges, CASE WHEN ends_with(path, '.sch') THEN regexp_replace(path, '[.]sch$', '.prism') ELSE path || '.prism' END AS tables FROM g)
SELECT * FROM b UNION ALL SELECT path, NULL, NULL, path FROM l WHERE ends_with(path, '.prism') AND path NOT IN (SELECT tables FROM b)""")
def dataset_catalog(spark, sf_dir):
    """Graphs that have ranges, and stored tables whose sources are gone."""
    c = F.col
    ending = F.when(c("event_type") == "click", ".sch").when(c("event_type") == "view", ".sch.ranges").when(c("event_type") == "purchase", ".prism").when(c("event_type") == "signup", ".sch.bz2").otherwise("")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return catalog.catalog(e.select(F.concat(F.lit("d"), (c("user_id") % 13).cast("string"), F.lit("/g"), (c("event_id") % 500).cast("string"), ending).alias("path")).distinct())


# Three classes of roads and the one that takes all others.
_STYLES = [(1, "motorway", "#d04040"), (2, "trunk", "#e08030"), (3, "primary", "#f0c04080"), (None, "other", "#909090")]


def _styles(spark) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(_STYLES)], "type int, class string, colour string, index int")


_STYLE_ROWS = "st(type, class, colour, index) AS (VALUES " + ", ".join(f"({t or 'NULL::INT'}, '{c}', '{h}', {i})" for i, (t, c, h) in enumerate(_STYLES)) + ")"


@query(_STYLE_ROWS + " SELECT e.edge, coalesce(s.class, (SELECT class FROM st WHERE type IS NULL)) AS class FROM edge0 e LEFT JOIN st s ON s.type = e.type")
def style_lookup(spark, sf_dir):
    s = _styles(spark)
    other = s.where("type is null").select(F.col("class").alias("_other"))
    e = graph(spark, sf_dir).edges.select("edge", "type").join(F.broadcast(s.where("type is not null").select("type", "class")), "type", "left")  # a row per class
    return e.crossJoin(F.broadcast(other)).select("edge", F.coalesce("class", "_other").alias("class"))  # one row


@query(_STYLE_ROWS + ", h AS (SELECT class, index, substr(colour, 2) || CASE WHEN length(colour) = 7 THEN 'ff' ELSE '' END AS c FROM st) SELECT class, " + ", ".join(f"round(('0x' || substr(c, {1 + 2 * i}, 2))::INT / 255.0, 6) AS {n}" for i, n in enumerate(("red", "green", "blue", "alpha"))) + ", round((index + 1) / 5.0, 6) AS depth FROM h")
def style_values(spark, sf_dir):
    """Colours as shares, and the depth of each class."""
    s = _styles(spark).withColumns({"c": codes.hex_colour(F.col("colour")), "depth": F.round(codes.class_depth(F.col("index"), F.lit(4)), 6)})
    return s.select("class", *[F.round(F.get("c", F.lit(i)), 6).alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))], "depth")


_RULE = "SELECT '{0}' AS rule, sum(CASE WHEN {1} THEN 1 ELSE 0 END)::BIGINT AS rows FROM {2}"


def _rules_sql(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(_RULE.format(k, v, table) for k, v in rules.items())


@query("odd AS (SELECT edge, CASE WHEN edge % 101 = 0 THEN NULL ELSE child_a END AS child_a, child_b, CASE WHEN edge % 37 = 0 THEN birth + 10 ELSE death END AS death, birth, CASE WHEN edge % 53 = 0 THEN 300 ELSE h END AS height, code, style, split, sx, sy, tx, ty FROM coded) " + _rules_sql("odd", {"children": "(child_a IS NULL) <> (child_b IS NULL)", "levels": "death > birth", "height": "height > 250", "range_level": "birth > 65534 OR death > 65534", "code_order": "code NOT BETWEEN 0 AND 65535", "style": "style NOT BETWEEN 0 AND 63", "coordinates": "greatest(abs(sx), abs(sy), abs(tx), abs(ty)) > 1073741823", "split": "child_a IS NOT NULL AND split IS NULL"}))
def dq_constraints(spark, sf_dir):
    """Rules of the hierarchy, over a copy in which some rows break them."""
    c = F.col
    e = graph(spark, sf_dir).edges
    odd = e.withColumns({"child_a": F.when(c("edge") % 101 != 0, c("child_a")), "death": F.when(c("edge") % 37 == 0, c("birth") + 10).otherwise(c("death")), "height": F.when(c("edge") % 53 == 0, 300).otherwise(c("height"))})
    return checks.graph_rules(odd)


@query("SELECT 'endpoint' AS rule, sum((CASE WHEN source % 13 = 0 THEN 1 ELSE 0 END) + (CASE WHEN target % 13 = 0 THEN 1 ELSE 0 END))::BIGINT AS rows FROM coded WHERE edge % 17 <> 0 UNION ALL SELECT 'child', sum((CASE WHEN child_a % 17 = 0 THEN 1 ELSE 0 END) + (CASE WHEN child_b % 17 = 0 THEN 1 ELSE 0 END))::BIGINT FROM coded WHERE edge % 17 <> 0")
def dq_references(spark, sf_dir):
    """Ends and children that are gone from a copy of the tables."""
    g = graph(spark, sf_dir)
    return checks.references(g.nodes.where("node % 13 <> 0"), g.edges.where("edge % 17 <> 0"))


@query(_RECORDS + _PLACED + _COUNTED + ", odd AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 300 ELSE record_count END AS record_count, CASE WHEN page_id % 7 = 0 THEN max_level + 1 ELSE min_level END AS min_level, max_level, CASE WHEN page_id % 3 = 0 THEN first_record + 1000000000 ELSE first_record END AS first_record, min_error, min_x, max_x, min_y, max_y, vertex_count FROM pv) " + _rules_sql("odd", {"record_count": "record_count NOT BETWEEN 1 AND 256", "vertex_count": "vertex_count > 512", "levels": "min_level > max_level", "first_record": "first_record + record_count > (SELECT count(*) FROM rec)", "errors": "min_error > 65535", "boxes": "min_x > max_x OR min_y > max_y", "words": "false"}))
def dq_pages(spark, sf_dir):
    """Rules of the page directory, over a copy in which some entries break them."""
    c, g = F.col, graph(spark, sf_dir)
    odd = g.pages.withColumns({"record_count": F.when(c("page_id") % 5 == 0, 300).otherwise(c("record_count")), "min_level": F.when(c("page_id") % 7 == 0, c("max_level") + 1).otherwise(c("min_level")), "first_record": F.when(c("page_id") % 3 == 0, c("first_record") + 1000000000).otherwise(c("first_record"))})
    return checks.page_rules(odd, g.vertex_counts, g.paged.count())


@query(_RECORDS + _PLACED + ", left_ AS (SELECT * FROM paged WHERE record % 97 <> 0), h AS (SELECT page_id, count(*) AS n FROM left_ GROUP BY 1) SELECT p.page_id, coalesce(h.n = p.record_count, false) AS whole FROM pages p LEFT JOIN h USING (page_id)")
def whole_pages(spark, sf_dir):
    """Which pages have all their records, where some are gone."""
    g = graph(spark, sf_dir)
    return checks.whole_pages(g.paged.where("record % 97 <> 0"), g.pages)


@query(_RECORDS + _PLACED + "SELECT edge, page_id, pos FROM paged WHERE record BETWEEN 1000 AND 1299")
def record_range(spark, sf_dir):
    """Three hundred records by their numbers."""
    return read_range(graph(spark, sf_dir).paged, "record", 1000, 300).select("edge", "page_id", "pos")


@query(_RECORDS + _PLACED + "SELECT edge, pos, code FROM paged WHERE page_id = 7")
def one_page(spark, sf_dir):
    return graph(spark, sf_dir).paged.where("page_id = 7").select("edge", "pos", "code")


# Units of a shortcut that is only walked through, below a parent of the same error: one for a hundred events.
_UNITS = "u AS (SELECT unnest(range((SELECT count(*) // 100 FROM events))) AS u)"


def _walk_only(spark, sf_dir):
    c = F.col
    units = spark.range(spark.read.parquet(f"{sf_dir}/events.parquet").count() // 100).withColumnRenamed("id", "u")
    # nodes 0..3 of a unit: 1 lies off the line 0-2, 3 goes on along it; S = 0-2 bypasses 1, P = 0-3 bypasses 2
    nodes = units.select(F.explode(F.array(*[F.struct((c("u") * 4 + i).alias("node"), (c("u") * 1000 + x).alias("x"), (c("u") * 10 + y).alias("y")) for i, (x, y) in enumerate([(0, 0), (100, 50), (200, 0), (400, 0)])])).alias("n")).select("n.*")
    rows = [(0, 0, 1, None, None, None, 0, 0), (1, 1, 2, None, None, None, 0, 0), (2, 2, 3, None, None, None, 0, 0), (3, 0, 2, 1, 0, 1, -1, -1), (4, 0, 3, 2, 3, 2, 2, 1)]
    of = lambda v, k: F.lit(None).cast("long") if v is None else c("u") * k + v
    edges = units.select(F.explode(F.array(*[F.struct((c("u") * 5 + e).alias("edge"), of(a, 4).alias("source"), of(b, 4).alias("target"), of(s, 4).alias("split"), of(x, 5).alias("child_a"), of(y, 5).alias("child_b"), F.lit(1).alias("type"), F.lit(hi).alias("birth"), F.lit(lo).alias("death")) for e, a, b, s, x, y, hi, lo in rows])).alias("e")).select("e.*")
    return hierarchy.measure(nodes, edges)


@query(_UNITS + ", r AS (SELECT u * 5 + 3 AS edge, ceil((log2((50 / 536870912.0)::FLOAT::DOUBLE) + 40) * 1024)::INT AS code FROM u) SELECT edge, code, code AS parent_code FROM r")
def walk_only_records(spark, sf_dir):
    """Shortcuts that are never drawn but walked through: the records without levels."""
    e = _walk_only(spark, sf_dir)
    return hierarchy.records(e, hierarchy.contexts(e)).where("root_lo is null and child_lo is null").select("edge", "code", "parent_code")
