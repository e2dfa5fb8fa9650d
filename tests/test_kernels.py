"""Batched ring measures against literal values and plain loops, over rings of mixed lengths in one batch."""

import math
import random

from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g, kernels
from parcelgrid.operators import generate as ge, raster as ra

RING = "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>"


def rows_of(*pairs):
    ring = lambda r: None if r is None else [dict(x=float(x), y=float(y)) for x, y in r]
    return [(i, ring(a), ring(b)) for i, (a, b) in enumerate(pairs)]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
ELL = [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]
STAR = [(math.cos(k * 4 * math.pi / 5), math.sin(k * 4 * math.pi / 5)) for k in range(5)]  # turns left everywhere, crosses itself


def test_measures_work_on_batches(spark):
    df = spark.createDataFrame(rows_of((SQUARE, ELL)), RING)
    a, b = F.col("a"), F.col("b")
    for column in (g.obb(a), g.inset(a, 1.0), g.clip_convex(a, g.rect_planes(0, 0, 5, 5)), g.ring_contains(b, a),
                   g.ring_distance(a, b), g.ring_path_distance(a, b), g.intersection_area(a, b), g.is_simple(a)):
        plan = df.select(column.alias("v"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambda" not in plan.lower()


def test_mixed_and_odd_rings(spark):
    clockwise = SQUARE[::-1]
    bow = [(0, 0), (10, 10), (10, 0), (0, 10)]
    df = spark.createDataFrame(rows_of(
        (SQUARE, [(2, 2), (4, 2), (4, 4)]), (ELL, [(12, 12), (14, 12), (14, 14)]), (None, SQUARE), (clockwise, SQUARE), (bow, SQUARE),
        (SQUARE + [(0, 5)], [(20, 0), (30, 0)]), (STAR, SQUARE), (SQUARE, None),
    ), RING)
    a, b = F.col("a"), F.col("b")
    got = {r.k: r for r in df.select(
        "k", g.obb(a).alias("box"), g.inset(a, 2.0).alias("inset"), g.ring_contains(a, b).alias("holds"), g.ring_distance(a, b).alias("gap"),
        g.intersection_area(a, b).alias("both"), g.is_simple(a).alias("simple"), g.is_convex(a).alias("convex"),
    ).collect()}
    assert [got[k].box and round(got[k].box.length, 9) for k in (0, 1, 2, 3, 5)] == [10, 20, None, 10, 10]
    assert got[6].box.width < 1.91  # the hull of the star, not its sides
    assert [(p.x, p.y) for p in got[0].inset] == [(2, 2), (8, 2), (8, 8), (2, 8)] and got[1].inset is None
    assert [got[k].holds for k in (0, 1, 2, 7)] == [True, False, None, None]
    assert got[0].gap == 0 and got[1].gap == 2 and got[5].gap == 10 and got[7].gap is None
    assert got[0].both == 2 and got[1].both == 0 and got[2].both is None
    assert [got[k].simple for k in (0, 2, 4, 6)] == [True, None, False, False] and [got[k].convex for k in (0, 1)] == [True, False]


def test_long_rings_are_worked_through_in_parts(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 50)
    rng = random.Random(4)
    rows = []
    for n in (40, 7):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        rows.append(([(50 * math.cos(t), 50 * math.sin(t)) for t in angles], [(90, 0), (95, 0), (95, 5)]))
    df = spark.createDataFrame(rows_of(*rows), RING)
    for r in df.select("a", g.ring_distance(F.col("a"), F.col("b")).alias("gap"), g.obb(F.col("a")).alias("box")).collect():
        points = [(p.x, p.y) for p in r.a]
        best = float("inf")
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            n = math.hypot(bx - ax, by - ay)
            ux, uy = (bx - ax) / n, (by - ay) / n
            s, t = [x * ux + y * uy for x, y in points], [y * ux - x * uy for x, y in points]
            best = min(best, (max(s) - min(s)) * (max(t) - min(t)))
        gap = min(abs(math.dist((90, 0), (ax + t * (bx - ax), ay + t * (by - ay))))
                  for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]) for t in [k / 2000 for k in range(2001)])
        assert abs(r.box.box_area - best) < 1e-5 and abs(r.gap - gap) < 1e-2


def test_rectangles_and_other_blocks_give_their_lots(spark):
    blocks = spark.createDataFrame(
        rows_of(([(0, 0), (80, 0), (80, 120), (0, 120)], None), ([(0, 0), (80, 0), (80, 80), (40, 120), (0, 120)], None)), RING
    ).select("k", F.col("a").alias("ring"))
    lots = ge.obb_grid_lots(blocks, 40.0, 60.0, 1.0)
    cut = [p for p in lots._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython [clip_convex" in p]
    assert cut and "CASE" not in cut[0]
    assert {(r.k, round(r.n), round(r.a, 6)) for r in lots.groupBy("k").agg(F.count("*").alias("n"), F.sum("lot_sqm").alias("a")).collect()} == {
        (0, 4, 9600.0), (1, 4, 8800.0)}


def test_union_area_counts_rows_of_words(spark):
    rows = [(1, 0.0, 0.0, 10.0, 2000.0), (1, 5.0, 630.0, 20.0, 20.0), (1, -30.0, -700.0, 10.0, 10.0), (2, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double, w double, h double")
    got = {r.k: r.area_sqm for r in ra.union_area(df, ["k"], 5.0).collect()}
    cells = {(i, j) for _, x, y, w, h in rows[:3] for i in range(int(x // 5), int((x + w) // 5)) for j in range(int(y // 5), int((y + h) // 5))}
    assert got == {1: 25.0 * len(cells)}


def test_nearest_point_is_found_in_batches(spark):
    path = [dict(x=x, y=y) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (10.0, 10.0), (0.0, 10.0))]
    rows = [(1, path, 4.0, 3.0), (2, path, 10.0, 12.0), (3, path, 5.0, 5.0), (4, path[:1], 1.0, 1.0), (5, None, 1.0, 1.0), (6, path, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, path array<struct<x:double,y:double>>, x double, y double")
    out = df.select("id", g.nearest_point(F.col("path"), g.pt(F.col("x"), F.col("y"))).alias("n"))
    got = {r.id: r.n and tuple(r.n) for r in out.collect()}
    assert got == {1: (3.0, 0, 4.0, 0.0), 2: (2.0, 1, 10.0, 10.0), 3: (5.0, 0, 5.0, 0.0), 4: None, 5: None, 6: None}
    assert "ArrowEvalPython" in out._jdf.queryExecution().sparkPlan().toString()
