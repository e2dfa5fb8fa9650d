"""Plans and results that hold on tables larger than the planner's estimates of them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid import session as sn
from parcelgrid.operators import arrangement as ar, bucket as bu, edits as ed, generate as ge, network as nw, pairs as pr, raster as ra, rules as ru


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_generated_rows_are_not_gathered_on_the_driver(spark):
    few = spark.range(50).select(F.col("id").alias("site_id"))
    points = few.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(
        "site_id", "node", (F.col("node") * 7 % 101).cast("double").alias("px"), (F.col("node") * 13 % 89).cast("double").alias("py")
    )
    edges = nw.candidate_edges(points, 10.0)
    assert "BroadcastHashJoin" not in physical(edges) and "SortMergeJoin" in physical(edges)
    rows = [(r.px, r.py, r.node) for r in points.filter("site_id = 3").collect()]
    near = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < 100}
    assert {(r.u, r.v) for r in edges.filter("site_id = 3").collect()} == near


def test_sites_of_one_file_are_spread_before_they_are_cut_into_cells(spark):
    ring = g.ring_of((0, 0), (F.lit(90.0), 0), (F.lit(90.0), F.lit(90.0)), (0, F.lit(90.0)))
    sites = spark.range(64, numPartitions=1).select(F.col("id").alias("site_id"), ring.alias("ring"))
    tasks = ra.site_cells(sites, 30.0).select(F.spark_partition_id().alias("p"), "site_id").groupBy("p").count().collect()
    assert len(tasks) > 4 and sum(t["count"] for t in tasks) == 64 * 9


def test_dead_area_of_options_against_single_cells(spark):
    ell = g.ring_of((0, 0), (F.lit(200.0), 0), (F.lit(200.0), F.lit(80.0)), (F.lit(90.0), F.lit(80.0)), (F.lit(90.0), F.lit(160.0)), (0, F.lit(160.0)))
    sites = spark.range(1).select(F.lit(5).cast("long").alias("site_id"), ell.alias("ring"))
    options = spark.createDataFrame([(5, 0), (5, 1), (5, 2)], "site_id long, step int")
    paths = {0: ((0.0, 40.0), (60.0, 40.0)), 1: ((0.0, 0.0), (200.0, 160.0))}  # the third option has no road
    lines = spark.createDataFrame(
        [(5, k, [dict(x=x, y=y) for x, y in p]) for k, p in paths.items()], "site_id long, step int, path array<struct<x:double,y:double>>"
    )
    got = {r.step: r.dead_sqm for r in ra.dead_area(sites, lines, 30.0, 10.0, options).collect()}

    def gap(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5

    land = [(i * 10 + 5, j * 10 + 5) for i in range(20) for j in range(16) if j < 8 or i < 9]
    want = {k: 100.0 * sum(gap(x, y, *p) > 30 for x, y in land) for k, p in paths.items()} | {2: 100.0 * len(land)}
    assert got == want


def test_joins_on_points_and_edges_are_not_gathered_on_the_driver(spark, monkeypatch):
    written = []
    monkeypatch.setattr(nw, "cut_lineage", lambda df: written.append(physical(df)) or sn.cut_lineage(df))
    points = spark.createDataFrame([(1, k, 10.0 * k, 0.0) for k in range(5)], "site_id long, node long, px double, py double")
    edges = sn.cut_lineage(spark.createDataFrame([(1, k, k + 1, 10.0) for k in (0, 1, 3)], "site_id long, u long, v long, weight double"))
    points = sn.cut_lineage(points)
    assert {(r.node, r.comp) for r in nw.components(points, edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}
    paths = nw.shortest_paths(edges, points.filter("node = 0").select("site_id", "node"))
    assert {(r.node, r.dist) for r in paths.collect()} == {(0, 0.0), (1, 10.0), (2, 20.0)}
    way = nw.path_to(paths, points.filter("node = 2").select("site_id", "node"))
    assert {(r.node, r.step) for r in way.collect()} == {(2, 0), (1, 1), (0, 2)}
    assert {(r.u, r.v) for r in nw.mst(points, edges).collect()} == {(0, 1), (1, 2), (3, 4)}
    assert written and not any("BroadcastHashJoin" in plan for plan in written)
    walls = spark.createDataFrame([(1, 12.0, -5.0, 4.0, 10.0)], "site_id long, x double, y double, w double, h double")
    clear = nw.visibility_edges(edges, points, walls)
    assert {(r.u, r.v) for r in clear.collect()} == {(0, 1), (3, 4)}
    assert physical(clear).count("SortMergeJoin") >= 3


def test_sides_are_split_by_plain_columns(spark):
    side = "site_id long, side long, poly string, role string, x1 double, y1 double, x2 double, y2 double"
    sides = spark.createDataFrame(
        [(1, 1, "a", "part", 0.0, 0.0, 10.0, 0.0), (1, 2, "a", "part", 10.0, 0.0, 10.0, 8.0), (1, 3, "b", "part", 4.0, -3.0, 4.0, 5.0),
         (1, 4, "c", "part", 6.0, 0.0, 6.0, 9.0), (1, 5, "d", "part", 2.0, 0.0, 14.0, 0.0)], side
    )
    points = ar._split_points(sides, ["site_id"], ar.SNAP, 100.0)
    got = {(r.side, r.px, r.py) for r in points.collect()}
    assert {p for p in got if p[0] == 1} == {(1, x, 0.0) for x in (0.0, 2.0, 4.0, 6.0, 10.0)}
    assert {p for p in got if p[0] == 5} == {(5, x, 0.0) for x in (2.0, 4.0, 6.0, 10.0, 14.0)}
    assert {p for p in got if p[0] == 3} == {(3, 4.0, y) for y in (-3.0, 0.0, 5.0)}
    assert "lambdafunction" not in physical(points)


def test_blocks_are_spread_before_lots_are_cut(spark):
    ring = g.rect_ring(0.0, 0.0, F.lit(200.0), F.lit(120.0))
    sites = spark.range(40, numPartitions=1).select(F.col("id").alias("site_id"), ring.alias("ring"))
    roads = sites.select(
        "site_id", F.lit(1).alias("road_no"), F.lit(90.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(90.0).alias("x2"),
        F.lit(120.0).alias("y2"), F.lit(10.0).alias("width_m"),
    )
    blocks = ar.extract_blocks(sites, roads)
    tasks = blocks.select(F.spark_partition_id().alias("p"), "block_no", "area_sqm").collect()
    assert {(t.block_no, round(t.area_sqm, 6)) for t in tasks} == {(1, 10200.0), (2, 12600.0)}
    assert len(tasks) == 80 and len({t.p for t in tasks}) > 4


def test_blocks_are_measured_and_cut_in_one_pass(spark):
    ring = lambda w, h: g.rotate_cs(g.rect_ring(F.lit(5.0), F.lit(7.0), w, h), 0.8, 0.6, g.pt(0, 0))
    ell = [(0, 0), (200, 0), (200, 80), (60, 80), (60, 160), (0, 160)]
    blocks = spark.range(3).select(
        F.col("id").alias("block_id"), F.when(F.col("id") == 0, ring(F.lit(50.0), F.lit(40.0))).when(F.col("id") == 1, ring(F.lit(90.0), F.lit(200.0))).alias("ring")
    ).unionByName(spark.createDataFrame([(3, [dict(x=float(x), y=float(y)) for x, y in ell])], f"block_id long, ring {g.RING}"))
    lots = ge.subdivide_blocks(blocks.repartition(2), 120.0, 30.0, 120.0, 60.0, min_area=1500.0)
    plan = lots.groupBy("block_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition ") == 1
    rows = sorted((r.block_id, r.lot_no, r.kind, round(r.area_sqm, 6), round(r.width_m, 6), round(r.buildable_sqm or 0.0, 6)) for r in lots.collect())
    assert rows[:5] == [(0, 0, "park", 2000.0, 0.0, 0.0)] + [(1, k, "lot", 4500.0, 90.0, 38.0 * 78.0) for k in range(4)]
    assert [r[0] for r in rows[5:]] == [3] * len(rows[5:]) and sum(r[3] for r in rows[5:]) == 200 * 80 + 60 * 80


def test_slices_of_odd_rows(spark):
    square = [dict(x=float(x), y=float(y)) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]
    rows = [(0, square, [3.0, 1.0]), (1, square, []), (2, square, None), (3, None, [1.0]), (4, square, [1.0, None]), (5, square + [dict(x=None, y=1.0)], [1.0]), (6, square, [2.0])]
    df = spark.createDataFrame(rows, f"k int, ring {g.RING}, widths array<double>").coalesce(1)
    got = {r.k: r.lots for r in df.select("k", g.slices(F.col("ring"), F.lit(1.0), F.lit(0.0), F.col("widths")).alias("lots")).collect()}
    assert [[(round(lot.sqm, 9), len(lot.ring)) for lot in got[k]] for k in (0, 1, 6)] == [[(75.0, 4), (25.0, 4)], [], [(100.0, 4)]]
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4
    lots = ge.orthogonal_slice(df.select("k", "ring", "widths")).collect()
    assert sorted((r.k, r.lot_no, round(r.lot_sqm, 9)) for r in lots) == [(0, 0, 75.0), (0, 1, 25.0), (6, 0, 100.0)]


def boxes(spark, name, rows, types="double"):
    return spark.createDataFrame(rows, f"site_id long, {name} long, x {types}, y {types}, w {types}, h {types}")


def gap(a, b):
    return math.hypot(max(0, a[0] - b[0] - b[2], b[0] - a[0] - a[2]), max(0, a[1] - b[1] - b[3], b[1] - a[1] - a[3]))


def test_plots_are_not_multiplied_to_find_their_roads(spark, monkeypatch):
    rng = random.Random(3)
    side = lambda: rng.choice([0.0, 5.0, 60.0, 250.0, 251.0, 1000.0, 4000.0, 16000.0, 90_000.0])
    place = lambda: rng.choice([rng.uniform(-3000, 3000), rng.choice([-250.0, 0.0, 250.0, 1000.0])])
    plots = [(k % 3, k, place(), place(), side(), side()) for k in range(400)] + [(0, 500, None, 1.0, 2.0, 2.0), (9, 501, 0.0, 0.0, 1.0, 1.0)]
    roads = [(k % 3, k, *(rng.choice([(x, y, x + n, y), (x, y + n, x, y)]) if n else (x, y, x, y)))
             for k, (x, y, n) in enumerate((place(), place(), side()) for _ in range(40))] + [(0, 90, None, 0.0, None, 9.0)]
    p = boxes(spark, "plot_no", plots).withColumn("layout_id", F.col("site_id"))
    r = spark.createDataFrame(roads, "site_id long, road_no long, x1 double, y1 double, x2 double, y2 double")
    joins = []
    monkeypatch.setattr(bu, "_at_home", lambda df, cell_m, f=bu._at_home: joins.append((df.count(), f(df, cell_m).count())) or f(df, cell_m))
    got = {x.plot_no: (x.road_m, x.has_road_access) for x in pr.road_access(p, r, 60.0).collect()}
    line = lambda c: (min(c[0], c[2]), min(c[1], c[3]), abs(c[2] - c[0]), abs(c[3] - c[1]))
    want = {}
    for s, k, *box in plots:
        near = [d for d in (gap(box, line(c)) for t, _, *c in roads if t == s and None not in (*box, *c)) if d <= 60]
        want[k] = (min(near), True) if near else (None, False)
    assert {k: (v[0] if v[0] is None else pytest.approx(v[0]), v[1]) for k, v in want.items()} == got
    assert sum(v[1] for v in want.values()) > 50 and joins == [(402, 402)]


def test_pairs_of_small_groups_meet_in_lists_and_those_of_large_ones_over_cells(spark):
    rng = random.Random(5)
    box = lambda wide: (rng.uniform(-wide, wide), rng.choice([-40.0, 0.0, 100.0, rng.uniform(-wide, wide)]), rng.choice([0.0, 7.0, 40.0, 130.0]), rng.uniform(0, 90))
    rows = [(k % 30, k, *box(250)) for k in range(150)] + [(100, k, *box(600)) for k in range(300)]
    rows += [(None, 1000, 0.0, 0.0, 9.0, 9.0), (None, 1001, 0.0, 0.0, 9.0, 9.0), (5, 1002, None, 0.0, 9.0, 9.0)]
    items = boxes(spark, "node", rows)
    later = F.col("node") < F.col("node_b")
    want = {(s, i, j): gap(a, b) for s, i, *a in rows for t, j, *b in rows
            if s is not None and s == t and i < j and None not in a + b and gap(a, b) <= 20}
    for how in ({}, {"few": 0}, {"cell_m": 100.0, "few": 7}, {"few": 10_000}):
        pairs = bu.own_pairs(items, ["site_id"], 20.0, later, **how)
        assert set(pairs.columns) == set(bu.near_pairs(items, items, ["site_id"], 20.0, 100.0, later).columns)
        got = [(r.site_id, r.node, r.node_b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == set(want)
    assert len(want) > 1000


REG = dict(setback_m=10.0, fire_m=5.0, plot_min_sqm=2500.0, plot_min_width_m=50.0, road_max_m=60.0, far_max=0.7, far_min=0.3, green_min=0.15)


def some_layouts(spark):
    ring = g.ring_of((0, 0), (F.lit(400.0), 0), (F.lit(400.0), F.lit(300.0)), (0, F.lit(300.0)))
    sites = pr.with_planes(spark.range(3).select(F.col("id").alias("site_id"), ring.alias("ring"), F.lit(120_000.0).alias("site_sqm")))
    layouts = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 77)], "layout_id long, site_id long")
    plots = [(1, 1, "industrial", 50.0, 50.0, 100.0, 100.0), (1, 2, "industrial", 152.0, 50.0, 100.0, 100.0), (1, 3, "green_space", 100.0, 40.0, 100.0, 200.0),
             (2, 1, "industrial", 5.0, 5.0, 40.0, 40.0), (2, 2, "industrial", 380.0, 250.0, 60.0, 60.0), (4, 1, "industrial", 0.0, 0.0, 1.0, 1.0)]
    plots = spark.createDataFrame(plots, "layout_id long, plot_no long, type string, x double, y double, w double, h double")
    roads = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0)], "site_id long, road_no long, x1 double, y1 double, x2 double, y2 double")
    return layouts, sites, plots, roads


def shuffled_by_layout(df):
    """Columns of the rows that are shuffled by the number of their layout alone."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(layout_id#\d+L?, ", text)


def test_findings_copy_no_outline_for_a_layout_and_make_the_plots_once(spark, monkeypatch):
    layouts, sites, plots, roads = some_layouts(spark)
    made = []
    monkeypatch.setattr(ru, "cut_lineage", lambda df: made.append(df) or sn.cut_lineage(df))
    found = ru.findings(layouts, sites, plots, roads, REG)
    assert {(r.layout_id, r.rule, r.plot_no, r.other_no): r.measured for r in found.collect()} == {
        (1, "fire", 1, 2): 2.0, (1, "overlap", 1, 3): 5000.0, (1, "overlap", 2, 3): 4800.0, (2, "setback", 1, None): 5.0,
        (2, "setback", 2, None): 0.0, (2, "area", 1, None): 1600.0, (2, "width", 1, None): 40.0, (2, "access", 2, None): None,
        (2, "green", None, None): 0.0, (3, "green", None, None): 0.0, (4, "area", 1, None): 1.0, (4, "width", 1, None): 1.0,
    }
    shuffles = shuffled_by_layout(found)
    assert shuffles and not any("ring#" in x or "planes#" in x for x in shuffles) and len(made) == 1


def test_flags_copy_no_outline_for_a_layout(spark):
    layouts, sites, plots, roads = some_layouts(spark)
    flags = ru.compliance_flags(layouts, sites, plots, roads, REG)
    got = {r.layout_id: r for r in flags.collect()}
    seen = {k: (r.sellable_sqm, r.green_sqm, r.first_setback, r.n_dimension, r.first_dimension, r.has_roads, r.n_no_access, r.first_no_access,
                r.n_fire, r.n_overlap) for k, r in got.items()}
    assert seen == {
        1: (20_000.0, 20_000.0, None, 0, None, False, 2, 1, 1, 2), 2: (5200.0, 0.0, 1, 2, 1, True, 1, 2, None, None),
        3: (0.0, 0.0, None, 0, None, True, 0, None, None, None),
    }
    assert (got[1].fire.a, got[1].fire.b, got[1].overlap.a, got[1].overlap.overlap_sqm) == (1, 2, 1, 5000.0)
    shuffles = shuffled_by_layout(flags)
    assert shuffles and not any("ring#" in x or "planes#" in x for x in shuffles)


def test_report_puts_a_plot_into_few_cells(spark, monkeypatch):
    layouts, sites, _, roads = some_layouts(spark)
    plots = [(1, k, "industrial", 30.0 + 17 * k, 20.0 + 11 * k, 130.0, 120.0) for k in range(12)]
    plots = spark.createDataFrame(plots, "layout_id long, plot_no long, type string, x double, y double, w double, h double")
    rows = []
    monkeypatch.setattr(bu, "_cells", lambda df, *a, f=bu._cells: rows.append(f(df, *a).count()) or f(df, *a))
    flags = ru.compliance_flags(layouts, sites, plots, roads, REG)
    report = {r.layout_id: r for r in ru.compliance_report(flags, REG).collect()}
    assert sum(rows) <= 2 * 12 and report.keys() == {1, 2, 3}
    # above the floor area ratio, no green, first fire pair, first overlap; the site has no roads
    assert (report[1].n_violations, report[1].warnings, report[1].checks_passed) == (4, ["no_roads"], ["setback", "dimensions"])
    assert [(v.rule, v.plot_no, v.other_no) for v in report[1].violations] == [
        ("far", None, None), ("green", None, None), ("fire", 0, 1), ("overlap", 0, 1)]


def cut(lo, hi, strips):
    """What sorted intervals leave of another one."""
    out = []
    for a, b in sorted(strips):
        if a > lo:
            out.append((lo, min(a, hi)))
        lo = max(lo, b)
    return out + [(lo, hi)] * (lo < hi)


def test_lots_meet_all_strips_of_widened_roads_in_one_join(spark):
    rng = random.Random(11)
    place = lambda: rng.choice([rng.randint(-2000, 2000) * 1.0, rng.choice([-250.0, 0.0, 250.0, 1000.0])])
    side = lambda: rng.choice([1.0, 30.0, 250.0, 260.0, 1000.0, 4100.0, 70_000.0])
    lots = [(k % 3, k, place(), place(), side(), side()) for k in range(300)] + [(0, 800, None, 0.0, 5.0, 5.0), (8, 801, 0.0, 0.0, 9.0, 9.0)]
    roads = []
    for k in range(36):
        x, y, n = place(), place(), side()
        roads.append((k % 3, *((x, y, x, y + n) if k % 2 else (x, y, x + n, y)), 8.0, rng.choice([8.0, 12.0, 20.0])))
    l = boxes(spark, "plot_no", lots).withColumn("layout_id", F.col("plot_no") % 7)  # noqa: E741
    r = spark.createDataFrame(roads, "site_id long, x1 double, y1 double, x2 double, y2 double, width_m double, new_width_m double")
    got = ed.widen_roads(l, r)
    want = set()
    for s, k, x, y, w, h in lots:
        mine = [] if x is None else [(a, b, c, d, g2 - g1) for t, a, b, c, d, g1, g2 in roads if t == s and g2 > g1]
        strips = [(a - n / 2, b, c + n / 2, d, True) if a == c else (a, b - n / 2, c, d + n / 2, False) for a, b, c, d, n in mine]
        strips = [q for q in strips if min(x + w, q[2]) > max(x, q[0]) and min(y + h, q[3]) > max(y, q[1])]
        if not strips:
            want.add((k, 0, x, y, w, h))
            continue
        across, along = cut(x, x + w, [(q[0], q[2]) for q in strips if q[4]]), cut(y, y + h, [(q[1], q[3]) for q in strips if not q[4]])
        left = [(a, c, b - a, d - c) for a, b in across for c, d in along if (b - a) * (d - c) > 50]
        want |= {(k, n + 1, *p) for n, p in enumerate(left)}
    rows = [(q.plot_no, q.piece, q.x, q.y, q.w, q.h) for q in got.collect()]
    assert len(rows) == len(want) and set(rows) == want and len({q[0] for q in want if q[1] > 1}) > 30
    assert physical(got).count("SortMergeJoin") == 1
    slanted = spark.createDataFrame([(0, 0.0, 0.0, 9.0, 9.0, 1.0, 2.0)], r.schema)
    with pytest.raises(Exception, match="not axis-parallel"):
        ed.widen_roads(l, slanted).collect()
