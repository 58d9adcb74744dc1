"""Hand-made hierarchies through files, text sources, reports, checks and frame folds against known values."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismgraph.functions import codes, view
from prismgraph.operators import cuts, hierarchy, layout
from prismgraph.plans import checks, report
from prismgraph.sources import catalog, graph_text, tables
from prismgraph.streaming import frames

NODES = "0 100 48.00 9.00 0 4\n1 101 48.01 9.01 0 0\n2 102 48.00 9.02 0 2\n3 103 48.01 9.03 0 1\n4 104 48.00 9.04 0 3\n"
EDGES = ["0 1 10 1 50 -1 -1", "1 2 10 1 50 -1 -1", "2 3 10 2 50 -1 -1", "3 4 10 2 50 -1 -1", "0 2 20 1 50 0 1", "2 4 20 2 50 2 3", "0 4 40 1 50 4 5"]
RANGES = ["0 0 0", "1 0 0", "2 0 0", "3 0 0", "4 1 1", "5 1 1", "6 2 2"]


class Files:
    def __init__(self, folder):
        self.folder, self.n = folder, 0

    def __call__(self, nodes, edges, ranges):
        self.n += 1
        g, r = (str(self.folder / f"g{self.n}{x}") for x in (".sch", ".sch.ranges"))
        with open(g, "w") as f:
            f.write(f"# counts\n{nodes.count(chr(10))} {len(edges)}\n{nodes}" + "\n".join(edges) + "\n")
        with open(r, "w") as f:
            f.write("\n".join(ranges) + "\n")
        return g, r


@pytest.fixture
def written(tmp_path):
    return Files(tmp_path)


def built(spark, paths):
    nodes, edges, fit = graph_text.read_dataset(spark, *paths)
    e = hierarchy.measure(nodes, edges)
    ctx = tables.stored(hierarchy.contexts(e), "ctx")
    return nodes, e, ctx, tables.stored(hierarchy.records(e, ctx), "rec"), fit


def paged_of(spark, paths):
    nodes, e, ctx, rec, fit = built(spark, paths)
    curve = view.Curve(view.fit_zoom(fit["metres_per_unit"]), 0, 3)
    paged = tables.stored(layout.number_pages(layout.place(rec, e, curve, fit["metres_per_unit"], layout.bounds(nodes))), "paged")
    return nodes, e, ctx, rec, paged


def ids(df):
    return Counter(r.edge for r in df.collect())


def all_cuts(e, rec, level, t):
    return [ids(x) for x in (cuts.intervals(rec, level, t), cuts.breadth_first(e, level, t), cuts.depth_first(e, level, t))] + [Counter({r.edge: r.times for r in hierarchy.visit_counts(e, level, t).collect()})]


def test_bent_road(spark, written):
    nodes, e, ctx, rec, fit = built(spark, written(NODES, EDGES, RANGES))
    assert abs(fit["lon_scale"] - 0.6690657521909614) < 1e-12 and abs(fit["norm"] - 70.99451712250217) < 1e-9
    assert [(r.x, r.y) for r in nodes.orderBy("node").collect()] == [(-510027366, -190574456), (-255013683, 190574456), (0, -190574456), (255013683, 190574456), (510027366, -190574456)]
    got = {x.edge: x for x in e.collect()}
    assert got[4].code == got[5].code == got[6].code == 40454 and abs(got[6].err - 0.70994520) < 1e-7
    assert [got[i].height for i in range(7)] == [0, 0, 0, 0, 1, 1, 2] and [got[i].style for i in range(7)] == [1, 1, 2, 2, 1, 2, 1]
    assert [got[i].split for i in (4, 5, 6)] == [1, 3, 2]
    rows = {r.edge: r for r in rec.collect()}
    assert len(rows) == rec.count() == 7 and (rows[0].child_lo, rows[0].child_hi, rows[0].parent_code) == (1, 2, 40454)
    for level, t, want in ((2, 65534, {6: 1}), (1, 65534, {4: 1, 5: 1}), (2, 0, {0: 1, 1: 1, 2: 1, 3: 1}), (3, 0, {})):
        assert all(x == Counter(want) for x in all_cuts(e, rec, level, t))
    assert not any(r.gap for r in hierarchy.cover(e, ctx).collect()) and hierarchy.level_rules(e).isEmpty()


@pytest.mark.parametrize(
    ("edges", "ranges", "count", "want"),
    [
        (EDGES, [*RANGES[:4], "4 2 1", *RANGES[5:]], 9, {(2, 0): {0: 2, 1: 2, 2: 1, 3: 1}, (2, 65534): {4: 1, 6: 1}}),
        ([*EDGES, "0 3 30 1 50 4 2"], [*RANGES, "7 2 2"], 12, {(2, 0): {0: 2, 1: 2, 2: 2, 3: 1}, (2, 65534): {6: 1, 7: 1}}),
    ],
)
def test_visits_are_a_multiset(spark, written, edges, ranges, count, want):
    _, e, _, rec, _ = built(spark, written(NODES, edges, ranges))
    assert rec.count() == count
    for (level, t), cut in want.items():
        assert all(x == Counter(cut) for x in all_cuts(e, rec, level, t))


def test_styles_of_shortcuts(spark, written):
    nodes = "0 0 48.0 9.0 0 2\n1 0 48.0005 9.001 0 0\n2 0 48.0 9.002 0 1\n3 0 48.0 9.01 0 2\n"
    edges = ["0 1 1 3 50 -1 -1", "1 2 1 3 50 -1 -1", "2 3 1 12 50 -1 -1", "0 2 2 0 50 0 1", "0 3 3 0 50 3 2"]
    _, e, _, rec, _ = built(spark, written(nodes, edges, ["0 0 0", "1 0 0", "2 1 0", "3 1 1", "4 2 2"]))
    assert [r.style for r in e.orderBy("edge").collect()] == [3, 3, 12, 3, 12] and ids(cuts.intervals(rec, 2, 65534)) == {4: 1}


def test_walk_only_records(spark, written):
    """Six hundred shortcuts that are only walked through, on pages of their own, found by walks and never drawn."""
    nodes, edges, ranges = [], [], []
    for u in range(600):
        lat, lon, n, k = 48 + (u // 30) * 0.01, 9 + (u % 30) * 0.01, 4 * u, 5 * u
        nodes += [f"{n + i} 0 {lat + dy:.7f} {lon + dx:.7f} 0 {level}" for i, (dx, dy, level) in enumerate([(0, 0, 2), (0.001, 0.0005, 0), (0.002, 0, 1), (0.004, 0, 2)])]
        edges += [f"{n} {n + 1} 1 1 50 -1 -1", f"{n + 1} {n + 2} 1 1 50 -1 -1", f"{n + 2} {n + 3} 1 1 50 -1 -1", f"{n} {n + 2} 2 1 50 {k} {k + 1}", f"{n} {n + 3} 3 1 50 {k + 3} {k + 2}"]
        ranges += [f"{k} 0 0", f"{k + 1} 0 0", f"{k + 2} 0 0", f"{k + 3} -1 -1", f"{k + 4} 2 1"]
    _, e, ctx, rec, paged = paged_of(spark, written("".join(x + "\n" for x in nodes), edges, ranges))
    walk = rec.where("root_lo is null and child_lo is null")
    assert rec.count() == 3000 and walk.count() == 600 and walk.where("representative and parent_code = code").count() == 600
    pages = tables.stored(layout.directory(paged), "pages")
    empty = pages.where("min_level > max_level").collect()
    assert empty and all((p.min_level, p.max_level) == (65535, 0) for p in empty)
    assert not any(r.rows for r in checks.page_rules(pages, layout.vertex_counts(paged), 3000).collect())
    refs = layout.children(paged, e)
    assert not any(r.rows for r in checks.child_rules(refs, pages).collect())
    want = ids(cuts.breadth_first(e, 1, 0))
    assert want == ids(cuts.intervals(rec, 1, 0)) == ids(cuts.page_walk(paged, refs, 1, 0)) and sum(want.values()) == 1800


def test_random_hierarchies_give_one_cut(spark, written):
    """Random chains with shortcuts that live longer than they should: all ways to a cut agree, records hold the contexts."""
    rng = random.Random(7)
    nodes, edges, ranges = [], [], []
    for c in range(12):
        n0 = len(nodes)
        for i in range(17):
            level = next(k for k in range(5) if i % (2 << k)) if 0 < i < 16 else 5
            nodes.append(f"{n0 + i} 0 {48 + c * 0.01 + rng.uniform(0, 0.004):.6f} {9 + i * 0.002:.6f} 0 {level}")
        below = []
        for h in range(5):
            row = []
            for k in range(16 >> h):
                kids = f"{below[2 * k]} {below[2 * k + 1]}" if h else "-1 -1"
                row.append(len(edges))
                edges.append(f"{n0 + (k << h)} {n0 + ((k + 1) << h)} 1 {1 + rng.randrange(4)} 50 {kids}")
                high = h + rng.choice([0, 0, 0, 1, 2])
                ranges.append(f"{row[-1]} {high} {h}" if rng.random() < 0.9 else f"{row[-1]} -1 -1")
            below = row
    order = list(range(len(ranges)))
    rng.shuffle(order)
    _, e, ctx, rec, _ = built(spark, written("".join(x + "\n" for x in nodes), edges, [ranges[i] for i in order]))
    for level, t in ((1, 26000), (3, 0), (4, 27000)):
        first, *others = all_cuts(e, rec, level, t)
        assert all(first == x for x in others)
    # contexts, by carrying each edge's own list from parents to children in the order of levels
    of = {r.edge: r for r in e.collect()}
    found: dict[int, list] = {}
    for p in sorted((r for r in of.values() if r.child_a is not None), key=lambda r: (r.split_level, r.edge), reverse=True):
        spans = ([(p.death, p.birth)] if 0 <= p.death <= p.birth else []) + [x[:2] for x in found.get(p.edge, [])]
        for lo, hi in spans:
            for child in (p.child_a, p.child_b):
                mine = found.setdefault(child, [])
                if mine and mine[0][2] == p.code and (lo == mine[0][1] + 1 or hi + 1 == mine[0][0]):
                    mine[0] = (min(lo, mine[0][0]), max(hi, mine[0][1]), p.code)
                else:
                    mine.append((lo, hi, p.code))
    got: dict[int, list] = {}
    for r in ctx.orderBy("edge", "seq").collect():
        got.setdefault(r.edge, []).append((r.lo, r.hi, r.parent_code))
    assert got == found


def test_unrelated_children_are_refused(spark, written):
    edges = [*EDGES[:6], "0 4 40 1 50 2 0"]
    with pytest.raises(Exception, match="do not share a node"):
        graph_text.read_dataset(spark, *written(NODES, edges, RANGES))


def test_notation_of_sources(spark, written):
    other = "0 100 48 9 0 4 1 101 4.801e1 9.01000000000000 0 0 # a comment\n2 102 48.000 0.902E1\n0 2\n3 103 48.01 9.03 0 1 4 104 480e-1 9.0400 0 3\n"
    g, r = written(NODES, EDGES, RANGES)
    plain = graph_text.read_graph(spark, g).nodes.orderBy("node").collect()
    with open(g, "w") as f:
        f.write(f"5 7\n{other}" + "\n".join(EDGES) + "\n")
    assert graph_text.read_graph(spark, g).nodes.orderBy("node").collect() == plain
    with open(g, "w") as f:
        f.write("5 7\n" + NODES.replace("48.00 9.00", "50.98522568 -4.89999984e-05") + "\n".join(EDGES) + "\n")
    n = graph_text.read_graph(spark, g).nodes.where("node = 0").collect()[0]
    assert (n.lat, n.lon) == (50.98522568, -4.89999984e-05)
    with open(r, "a") as f:
        f.write("")
    with open(r, "w") as f:
        f.write("\n".join(["0 3 1", "1 -1 -1", "0 5 2", *RANGES[3:]]))
    levels = {x.edge: (x.birth, x.death) for x in graph_text.read_ranges(spark, r, 7).collect()}
    assert levels[0] == (5, 2) and levels[1] == (-1, -1) and 2 not in levels


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (("48.00 9.00", "48.0000000000000001 9.00"), "significant digits"), (("48.00 9.00", "181 9.00"), "coordinate"), (("48.00 9.00", "x 9.00"), "coordinate"), (("0 100", "1 100"), "node order"), (("9.00 0 4", "9.00 0 65536"), "node level"),
        (("0 1 10 1", "0 5 10 1"), "edge endpoint"), (("0 1 10 1", "0 1 1.5 1"), "edge weight"), (("0 1 10 1", "0 1 -1 1"), "edge weight"), (("0 1 10 1 50", "0 1 10 40000 50"), "edge type"), (("50 0 1", "50 0 7"), "child edge"), (("50 0 1", "50 0 -1"), "only one child"),
    ],
)
def test_broken_sources_are_refused(spark, written, change, rule):
    g, _ = written(NODES, EDGES, RANGES)
    with open(g) as f:
        text = f.read()
    with open(g, "w") as f:
        f.write(text.replace(*change, 1))
    with pytest.raises(graph_text.SourceError, match=rule):
        graph_text.read_graph(spark, g)
    loose = graph_text.read_graph(spark, g, strict=False)
    assert loose.rejects.count() == 1 and loose.nodes.count() + loose.edges.count() == 11


def test_short_files_are_refused(spark, written):
    g, r = written(NODES, EDGES[:-1], RANGES[:-1])
    with open(g) as f:
        text = f.read()
    for broken in (text.replace("5 6", "5 7", 1), text.replace("5 6", "0 6", 1), text.replace("5 6", "a 6", 1)):
        with open(g, "w") as f:
            f.write(broken)
        with pytest.raises(graph_text.SourceError):
            graph_text.read_graph(spark, g)
    with pytest.raises(graph_text.SourceError, match="a row for each of 7"):
        graph_text.read_ranges(spark, r, 7)


def test_weights_in_any_notation(spark, written):
    g, _ = written(NODES, ["0 1 10.0 1 50 -1 -1", *EDGES[1:]], RANGES)
    assert graph_text.read_graph(spark, g).edges.where("edge = 0").collect()[0].weight == 10


SHIPPED = """# Classes of roads and their looks
#   class  colour  width  types

motorway     #d04040   4.5   1 2               # both kinds
trunk        #e08030   4.0   9 10              # trunk
minor        #b0b0c080 1.7   11 12 13 14
other        #909090   1.0   *                 # all others
"""


def test_style_files(spark, tmp_path):
    path = str(tmp_path / "styles.cfg")

    def read(text):
        with open(path, "w") as f:
            f.write(text)
        return {r.type: r for r in graph_text.read_styles(spark, path).collect()}

    s = read(SHIPPED)
    assert len(s) == 64 and [s[t]["class"] for t in (1, 2, 10, 12, 0, 63)] == ["motorway", "motorway", "trunk", "minor", "other", "other"] and s[1].width == 4.5
    df = graph_text.read_styles(spark, path).where("type in (1, 12)").select("type", codes.hex_colour(F.col("colour")).alias("c"), codes.class_depth(F.col("index"), F.lit(4)).alias("d")).orderBy("type")
    (_, a, da), (_, b, db) = df.collect()
    assert abs(a[0] - 0xD0 / 255) < 1e-9 and a[3] == 1.0 and abs(b[3] - 0x80 / 255) < 1e-9 and 0 < da < db < 1
    broken = ["a #ff0000 1 1\n", "a #ff0000 1 1 *\nb #00ff00 1 1\n", "a red 1 *\n", "a #ff0000 0 *\n", "a #ff0000 33 *\n", "a #ff0000 1\n", "a #ff0000 1 63 *\n", "a #ff0000 1 x *\n", "a #ff0000 1 * \nb #00ff00 1 *\n"]
    for text in broken:
        with pytest.raises(graph_text.SourceError):
            read(text)
    # styles are read again once their file has changed
    read(SHIPPED)
    roads = spark.createDataFrame([(1,), (50,)], "type int")
    now, again = frames.styled(roads, lambda: graph_text.read_styles(spark, path), path)
    assert {r["class"] for r in now.collect()} == {"motorway", "other"}
    read(SHIPPED.replace("motorway ", "highway ", 1))
    os.utime(path, (1, 1))
    assert {r["class"] for r in again().collect()} == {"highway", "other"}


def test_codes_round_the_safe_way(spark):
    c = F.col("id").cast("int")
    d = codes.decode(c)
    rows = spark.range(0, 65535).select(c.alias("c"), codes.error_code(d).alias("e"), codes.tolerance_code(d).alias("t"), codes.bound(c).alias("b"), (d * (1 << 29)).alias("v"))
    bad = rows.where("c > 0 and (e < c or e > c + 1 or t > c or t < c - 1)").count()
    assert bad == 0 and rows.where("b < least(v, 1073741823) - 1e-6 * v or b > v * 1.0001 + 1").count() == 0
    steps = spark.createDataFrame([(1.0,), (2.0,), (8.0,), (100.0,)], "px double").select(codes.nearest_step(F.col("px")).alias("s"))
    assert [r.s for r in steps.collect()] == [0, 4, 12, 12]
    r = spark.range(1).select(codes.step_of_threshold(F.lit(1768), F.lit(1000)).alias("a"), codes.step_of_threshold(F.lit(744), F.lit(1000)).alias("b"), codes.step_pixels(F.lit(4)).alias("c"), codes.share(F.lit(1.0), F.lit(0.0)).alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == (3, -1, 2.0, 0.0)


def test_fitted_views(spark):
    """The steps that the search takes, against the same search over counts made one by one."""
    rng = random.Random(5)
    rows = [(i, 0, 0, 100, 100, rng.randint(0, 3), rng.randint(4, 9), rng.randint(0, 20000), 65535, [0] * 16, [255] * 16) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, min_x long, min_y long, max_x long, max_y long, min_level int, max_level int, min_error int, max_parent int, band_min array<int>, band_max array<int>")
    views = [((0, 0, 50, 50), min(9, 2 + s // 16), layout.coarser(3000, s)) for s in range(65)]
    count = lambda level, t: sum(r[5] <= level <= r[6] and r[7] <= t < r[8] for r in rows)
    for limit in (300, 120, 60, 20, 0):
        steps, level, t = layout.fit_view(pages, views, limit, 9)
        assert (level, t) == views[steps][1:] or level > views[steps][1]
        if count(*views[0][1:]) <= limit:
            assert steps == 0
        assert count(level, t) <= limit or level == 9


def test_tables(spark, tmp_path):
    d = f"file://{tmp_path}"
    a = spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as float) / 3 as v")
    tables.publish(a, f"{d}/t")
    tables.publish(a.limit(10), f"{d}/t")
    assert spark.read.parquet(f"{d}/t").count() == 10 and os.listdir(tmp_path) == ["t"]
    tables.publish(a, f"{d}/t")
    a.write.option("compression", "none").parquet(f"{d}/raw")
    before, after = tables.recompress(spark, f"{d}/raw", f"{d}/small")
    assert after < before and tables.checksum(spark.read.parquet(f"{d}/small")) == tables.checksum(a)
    assert {r.section: r.files > 0 and r.stored_bytes > 0 for r in tables.sections(spark, {"t": f"{d}/t", "small": f"{d}/small"}).collect()} == {"t": True, "small": True}
    for f in os.listdir(tmp_path / "raw"):
        if f.endswith(".parquet"):
            os.truncate(tmp_path / "raw" / f, 100)
            os.remove(tmp_path / "raw" / f".{f}.crc")
            break
    schema = "id long, k long, v double"
    assert tables.read_tables(spark, f"{d}/raw", schema, strict=False).count() < 1000
    with pytest.raises(Exception):  # noqa: B017
        tables.read_tables(spark, f"{d}/raw", schema).count()
    with pytest.raises(ValueError, match="2 rows break rule odd"):
        checks.require(checks.broken(a.limit(3), {"odd": F.col("id") < 2}), "t")
    checks.require(checks.broken(a, {"odd": F.col("id") < 0}), "t")


def test_catalog_and_freshness(spark, tmp_path):
    for f in ("a.sch", "a.sch.ranges", "b.sch", "c.sch.bz2", "d", "d.ranges", ".prismgraph/x.sch", ".prismgraph/x.sch.ranges"):
        os.makedirs((tmp_path / f).parent, exist_ok=True)
        (tmp_path / f).write_text("1 1\n")
    for t in ("a.prism", "gone.prism"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{t}")
    got = [(r.name, r.graph, r.tables) for r in catalog.catalog(catalog.list_folder(spark, f"file://{tmp_path}")).collect()]
    assert got == [("a.sch", "a.sch", "a.prism"), ("d", "d", "d.prism"), ("gone.prism", None, "gone.prism")]
    place = [f"file://{tmp_path}/{x}" for x in ("a.prism", "a.sch", "a.sch.ranges")]
    assert not catalog.matches(spark, *place)
    catalog.remember(spark, *place)
    assert catalog.matches(spark, *place)
    (tmp_path / "a.sch").write_text("2 2 2\n")
    assert not catalog.matches(spark, *place)
    (tmp_path / "a.prism" / "_source.json").write_text("{")
    assert not catalog.matches(spark, *place)


def test_report_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    assert [report.field(x) for x in ("a", "a,b", 'say "x"', "two\nlines", None, 3)] == ["a", '"a,b"', '"say ""x"""', '"two lines"', "", "3"]
    meter = report.StageMeter()
    meter.done("read")
    meter.done("write")
    report.write_build(spark, d, meter, {"edges": 7, "file": "a,b"})
    report.write_build(spark, d, meter, {"edges": 8, "file": "c"})
    history = (tmp_path / "preprocess_history.csv").read_text().splitlines()
    assert len(history) == 3 and '"a,b"' in history[1] and history[0].startswith("time_utc,seconds,peak_ram_mib,edges,file,s_read,s_write")
    assert len((tmp_path / "preprocess_stages.csv").read_text().splitlines()) == 3 and meter.peak_mib > 0
    values = spark.createDataFrame([("pass", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("draw", float(v)) for v in range(1, 101)], "metric string, ms double")
    t = {r.metric: r for r in report.timing(values, ["metric"], "ms").collect()}
    assert (t["pass"]["mean"], t["pass"]["median"], t["pass"].p95, t["pass"].stddev) == (2.5, 2.5, 4.0, 1.118034)
    assert (t["draw"].p95, t["draw"].p99, t["draw"].median) == (95.0, 99.0, 50.5)
    report.append_benchmark(spark, d, {"run": 1, "renderer": "x, y"}, report.timing(values, ["metric"], "ms"))
    report.append_benchmark(spark, d, {"run": 2, "renderer": "z"}, report.timing(values, ["metric"], "ms"))
    lines = (tmp_path / "benchmark.csv").read_text().splitlines()
    assert len(lines) == 5 and '"x, y"' in lines[1] and lines[0].endswith("min_ms,max_ms,stddev_ms")
    assert len(report.timestamp()) == 19 and len(report.timestamp(True)) == 15


def test_layout_reports_add_up(spark, tmp_path):
    from prismgraph import queries

    g = queries.graph(spark, "/root/testdata/sf0.001")
    report.write_layout(g, f"file://{tmp_path}")
    read = lambda name: pd.read_csv(tmp_path / f"{name}.csv")
    total = read("layout_summary").iloc[0]
    by_layer = read("layout_layers")
    assert by_layer.pages.sum() == total.pages == read("layout_page_fill").pages.sum() == g.pages.count()
    assert by_layer.records.sum() == total.records == g.paged.count() and by_layer.bytes.sum() == total.bytes
    assert (read("layout_sections").stored_bytes > 0).all() and read("layout_levels").pages.max() <= total.pages
    checks.require(checks.page_rules(g.pages, g.vertex_counts, g.paged.count()), "pages")
    checks.require(checks.group_rules(g.groups, g.pages), "groups")
    checks.require(checks.child_rules(g.refs, g.pages), "children")
    checks.require(checks.graph_rules(g.edges), "graph")


class Machine:
    """Each step draws a tenth less than the one before; steps below `hidden` take twice as long as counted."""

    def __init__(self, ms, hidden=-1, counted=True, lag=0, load=0):
        self.ms, self.hidden, self.counted, self.lag, self.load = ms, hidden, counted, lag, load
        self.counts = [int(100000 * 0.9**s) for s in range(13)]

    def segments(self, step):
        return self.counts[step] * (2 if step < self.hidden else 1)

    def frame(self, step, passed):
        n = self.segments(step) * self.ms
        return 2 + n + (1 + n if passed else 0)


class Viewer:
    def __init__(self, controller, machine, step):
        self.c, self.m, self.requested, self.drawn, self.loading, self.pending, self.history = controller, machine, step, step, 0, None, []

    def run(self, moving, count, watched=-1):
        changes = slow = tries = 0
        budget = 1000 / 60
        for _ in range(count):
            seen = self.history[-1 - min(self.m.lag, len(self.history) - 1)] if self.history else self.drawn
            n = self.m.segments(seen) * self.m.ms
            x = {"seconds": 1 / 60, "budget": budget, "moving": moving, "drawn": self.drawn, "requested": self.drawn == self.requested, "fixed": 1.0, "scaled": n, "draw": n, "counts": self.m.counts if self.m.counted else None}
            if self.pending:
                x |= dict(zip(("frame", "passed", "step"), self.pending, strict=True))
            wanted = self.c.update(x)
            if wanted != self.requested:
                changes += 1
                tries += wanted == watched and wanted < self.requested
                self.loading = self.m.load if wanted < self.drawn else 0
                self.requested = wanted
            passed = moving
            if self.drawn != self.requested:
                self.loading -= 1
                if self.loading < 0:
                    self.drawn, passed = self.requested, True
            ms = self.m.frame(self.drawn, passed)
            slow += ms > budget
            self.pending = (ms, passed, self.drawn)
            self.history.append(self.drawn)
        return self.requested, changes, slow, tries


def test_controllers_on_a_simulated_machine():
    v = Viewer(frames.Predictive(0), Machine(1e-5), 0)
    assert v.run(True, 120)[1] == 0 and v.run(False, 120)[:2] == (0, 0)
    for counted in (True, False):
        for lag in (0, 3):
            v = Viewer(frames.Predictive(0), Machine(13.5e-5, counted=counted, lag=lag), 0)
            v.run(False, 60)
            step, _, slow, _ = v.run(True, 240)
            assert 8 <= step <= (9 if counted else 10) and v.run(True, 60)[2] == 0 and slow <= (6 if counted else 30)
            v.run(False, 240)
            step, changes, slow, _ = v.run(False, 120)
            assert 1 <= step <= 3 and changes == 0 and slow == 0
    for load in (0, 40):
        step, _, slow, tries = Viewer(frames.Predictive(8), Machine(10e-5, hidden=4, load=load), 8).run(False, 1200, 3)
        assert tries <= 5 and slow <= 12 and step >= 3
    step, *_ = Viewer(frames.Feedback(0), Machine(13.5e-5), 0).run(True, 300)
    assert 5 <= step < 13
    assert [frames.half_up(x) for x in (0.5, 1.5, 2.5, -0.5, 2.4)] == [1, 2, 3, -1, 2]


def test_frame_folds(spark):
    df = spark.createDataFrame([(1, i, m, dt) for i, (m, dt) in enumerate([(False, 0.1), (True, 0.016), (False, 0.1), (False, 0.1)])], "run long, seq long, moving boolean, dt double")
    assert [r.coarse for r in frames.coarsened(df).orderBy("seq").collect()] == [False, True, True, False]
    touches = spark.createDataFrame([(1, i, p) for i, p in enumerate([1, 2, 1, 3, 2, 1])], "run long, seq long, page long")
    got = [(r.hit, r.evicted) for r in frames.lru_pool(touches, 2).orderBy("seq").collect()]
    assert got == [(False, None), (False, None), (True, None), (False, 2), (False, 1), (False, 3)]
    pinned = spark.createDataFrame([(1, i, p, f) for i, (p, f) in enumerate([(1, 0), (2, 0), (3, 0), (3, 1), (1, 1), (2, 1)])], "run long, seq long, page long, frame long")
    got = [(r.hit, r.evicted) for r in frames.lru_pool(pinned, 2).orderBy("seq").collect()]
    assert got == [(False, None), (False, None), (False, None), (False, 1), (False, 2), (False, None)]
    waits = spark.createDataFrame([(1, i, i >= 3, 0.5) for i in range(9)] + [(2, i, False, 11.0) for i in range(4)], "run long, seq long, settled boolean, dt double")
    got = {(r.run, r.seq): r.wait for r in frames.suite_waits(waits).collect()}
    assert [got[1, i] for i in range(9)] == ["waiting"] * 7 + ["ready", "waiting"] and [got[2, i] for i in range(4)] == ["waiting", "waiting", "timed out", "waiting"]
    sweep = spark.createDataFrame([(1, i, i > 1, 3.0) for i in range(16)], "run long, seq long, complete boolean, dt double")
    got = [r.phase for r in frames.sweep_phases(sweep).orderBy("seq").collect()]
    assert got == ["overview"] * 3 + ["zoom in"] * 4 + ["hold near"] + ["zoom out"] * 4 + ["hold far"] + ["idle"] * 3
    zoom = spark.createDataFrame([(1, i, 20.0, 0.05) for i in range(3)], "run long, seq long, target double, dt double")
    assert [round(r.zoom, 4) for r in frames.eased_zoom(zoom, 10.0).orderBy("seq").collect()] == [15.0341, 17.534, 18.7754]


def test_stream_of_frames(spark, tmp_path):
    rows = [(1, i, 40.0 if i < 6 else 4.0, 0.05) for i in range(30)] + [(2, i, 10.0, 0.05) for i in range(30)]
    for part in (rows[:10] + rows[30:40], rows[10:30] + rows[40:]):  # two batches of the same runs
        spark.createDataFrame(part, "run long, seq long, ms double, dt double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run long, seq long, ms double, dt double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frames.stream_tolerance(stream, "feedback", 16.0).writeStream.format("memory").queryName("steps").start()
    q.processAllAvailable()
    q.stop()
    whole = frames.tolerance(spark.createDataFrame(rows, "run long, seq long, ms double, dt double"), "feedback", 16.0)
    key = lambda df: sorted((r.run, r.seq, r.step) for r in df.collect())
    assert key(spark.table("steps")) == key(whole)


def test_view_functions(spark):
    curve = view.Curve(1.5, 0, 9)
    zooms = [1.0, 1.5, 3.0, 47.0, 500.0, 1000.0, 5000.0]
    got = spark.createDataFrame([(z,) for z in zooms], "z double").select(curve.column(F.col("z")).alias("v")).collect()
    assert all(abs(r.v - curve.level(z)) < 1e-5 for r, z in zip(got, zooms, strict=True)) and curve.level(1.5) == 8.0 and curve.level(1000) == 0.0
    at = curve.crossings()
    assert at[0] == float("inf") and all(a >= b for a, b in zip(at, at[1:], strict=False))
    for k, z in enumerate(at, -1):
        if 0 < z < float("inf"):
            assert curve.level(z) < k + 0.5 <= curve.level(z * 0.9999)
    assert view.fit_zoom(1.0) == view.LARGEST_ZOOM and view.fit_zoom(1e12) == float(__import__("numpy").float32(0.01))
    modes = spark.range(1).select(*[view.threshold(m, F.lit(7)).alias(m) for m in ("none", "full", "adaptive")]).collect()[0]
    assert (modes.none, modes.full, modes.adaptive) == (65534, 0, 7)
