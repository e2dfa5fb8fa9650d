"""Run-length rasters against cell-by-cell search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.operators import network as nw, raster as ra, runs as rn

RING = "array<struct<x:double,y:double>>"
SIZE = 2.0


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def distance(x, y, ax, ay, bx, by):
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if n == 0 else min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n))
    return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))


def sides(points):
    return list(zip(points, points[1:] + points[:1]))


def inside(points, x, y):
    odd = False
    for (ax, ay), (bx, by) in sides(points):
        if distance(x, y, ax, ay, bx, by) <= 1e-9:
            return True
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def parts(cells):
    left, out = set(cells), {}
    while left:
        todo, found = [left.pop()], []
        while todo:
            i, j = todo.pop()
            found.append(i * rn.COLUMN + j)
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out[min(found)] = len(found) * SIZE * SIZE
    return out


OUTLINES = [
    [(0, 0), (60, 0), (60, 40), (0, 40)],
    [(0, 0), (60, 0), (60, 21), (31, 21), (31, 50), (0, 50)],
    [(3, 1), (55, 9), (70, 45), (30, 61), (1, 33)],
    [(0, 0), (80, 0), (80, 7), (9, 7), (9, 15), (80, 15), (80, 23), (0, 23)],
    [(-21, -31), (41, -11), (20, 30), (-9, 9)],
    [(1, 1), (11, 21), (21, 1), (21, 41), (1, 41)],
]


def cells(outline):
    xs, ys = zip(*outline)
    span = lambda v: range(math.floor(min(v) / SIZE) - 1, math.ceil(max(v) / SIZE) + 1)
    return {(i, j) for i in span(xs) for j in span(ys) if inside(outline, (i + 0.5) * SIZE, (j + 0.5) * SIZE)}


def test_dead_zones_of_any_outline_and_road(spark):
    rng = random.Random(7)
    sites, roads = [], []
    for k in range(36):
        outline = OUTLINES[k % len(OUTLINES)]
        sites.append((k, ring(outline)))
        for _ in range(k % 4):
            roads.append((k, *[rng.uniform(-20, 80) for _ in range(4)]))
    roads += [(0, None, 1.0, 2.0, 3.0), (99, 0.0, 0.0, 1.0, 1.0), (5, 8.0, 8.0, 8.0, 8.0), (4, 1.0, 1.0, 21.0, 1.0)]
    table = spark.createDataFrame(roads, "site_id long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {}
    for r in ra.dead_zones(spark.createDataFrame(sites, f"site_id long, ring {RING}"), table, 9.0, size=SIZE, min_area=0.0).collect():
        got.setdefault(r.site_id, {})[r.part] = r.area_sqm
    for k, points in sites:
        mine = [r[1:] for r in roads if r[0] == k and None not in r]
        outline = [(p["x"], p["y"]) for p in points]
        far = {c for c in cells(outline) if all(distance((c[0] + 0.5) * SIZE, (c[1] + 0.5) * SIZE, *r) > 9.0 + 1e-9 for r in mine)}
        assert got.get(k, {}) == parts(far), k
    assert sum(len(p) for p in got.values()) > 36


def test_green_remainder_inside_the_setback_beside_slanted_strips(spark):
    sites = [(k, ring(o)) for k, o in enumerate(OUTLINES)]
    boxes = [(k, 5.3 + 3 * k, 4.1, 7.0, 11.0) for k in range(6)] + [(1, 5.0, 4.0, 7.0, 11.0)]
    strip = [(20.0, 2.0), (44.0, 34.0), (40.0, 37.0), (16.0, 5.0)]  # 40 by 5, along (3, 4) / 5
    got = ra.green_remainder(
        spark.createDataFrame(sites, f"site_id long, ring {RING}"),
        spark.createDataFrame(boxes, "site_id long, x double, y double, w double, h double"),
        spark.createDataFrame([(k, ring(strip)) for k in range(6)], f"site_id long, ring {RING}"),
        size=SIZE, clearance=1.0, min_area=0.0, setback=3.7,
    ).groupBy("site_id").agg(F.sum("area_sqm").alias("a")).collect()
    got = {r.site_id: r.a for r in got}
    for k, outline in enumerate(OUTLINES):
        n = 0
        for i, j in cells(outline):
            x, y = (i + 0.5) * SIZE, (j + 0.5) * SIZE
            along, across = (x - 20) * 0.6 + (y - 2) * 0.8, -(x - 20) * 0.8 + (y - 2) * 0.6
            taken = (-1 - 1e-9 <= along <= 41 + 1e-9 and -1 - 1e-9 <= across <= 6 + 1e-9) or any(b[0] == k and b[1] <= x <= b[1] + b[3] and b[2] <= y <= b[2] + b[4] for b in boxes)
            n += not taken and min(distance(x, y, *a, *b) for a, b in sides(outline)) >= 3.7 - 1e-9
        assert got.get(k, 0.0) == n * SIZE * SIZE, k


def test_nodes_are_runs_and_seeds_without_a_place_end(spark):
    square = ring([(0, 0), (1000, 0), (1000, 1000), (0, 1000)])
    sites = spark.createDataFrame([(1, square)], f"site_id long, ring {RING}")
    rows = rn.site_rows(sites, 5.0)
    free = rn.free_runs(rn.site_runs(rows, 5.0), rn.site_runs(rows.limit(0), 5.0))
    assert free.count() == 200 and free.filter("lo = 0 AND hi = 199").count() == 200
    cells_ = ra.site_cells(sites, 100.0)
    seeds = spark.createDataFrame([(1, 7, None, 3.0), (1, 8, float("nan"), 3.0)], "site_id long, node long, px double, py double")
    assert [r.seed for r in ra.nearest_seed_regions(cells_, seeds, 50.0).select("seed").distinct().collect()] == [None]


def test_edges_without_a_length_are_no_way(spark):
    edges = spark.createDataFrame(
        [(1, 1, 2, 3.0), (1, 2, 3, None), (1, 3, 4, 1.0), (1, 2, 4, float("nan")), (1, 1, 4, -5.0), (1, 2, 5, 0.0)],
        "site_id long, u long, v long, weight double")
    source = spark.createDataFrame([(1, 1)], "site_id long, node long")
    assert {r.node: r.dist for r in nw.shortest_paths(edges, source).collect()} == {1: 0.0, 2: 3.0, 5: 3.0}


@pytest.mark.parametrize("closed", [True, False])
def test_reach_of_a_point_is_a_disc(spark, closed):
    p = F.struct(F.lit(10.0).alias("x"), F.lit(11.0).alias("y"))
    shape = spark.range(1).select(F.lit(1).alias("site_id"), F.array(F.struct(p.alias("p"), p.alias("q"))).alias("sides"), F.lit(4.0).alias("reach"))
    rows = spark.range(1).select(F.lit(1).alias("site_id"), F.lit(0).alias("j0"), F.lit(30).alias("j1"))
    got = {(i, r.j) for r in rn.shape_runs(shape, rows, SIZE, closed).collect() for i in range(r.lo, r.hi + 1)}
    reach = 4.0 + 1e-9 if closed else 4.0 - 1e-6
    assert got == {(i, j) for i in range(12) for j in range(12) if math.hypot(i * 2 + 1 - 10, j * 2 + 1 - 11) <= reach}
