"""Brute-force and literal checks of the geometry expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators import generate as ge


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def star(rng, n, cx, cy):
    """Random simple ring: sorted angles about a centre."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + rng.uniform(20, 60) * math.cos(a), cy + rng.uniform(20, 60) * math.sin(a)) for a in angles]


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intersection_area_of_concave_rings_against_a_fine_grid(spark, seed):
    rng = random.Random(seed)
    a, b = star(rng, 9, 0, 0), star(rng, 7, 15, 10)
    got = one(spark, g.intersection_area(g.ring_of(*a), g.ring_of(*b)))[0]
    step, n = 0.5, 0
    for i in range(-140, 180):
        for j in range(-140, 180):
            x, y = i * step + 0.25, j * step + 0.25
            n += inside(a, x, y) and inside(b, x, y)
    assert got == pytest.approx(n * step * step, rel=0.02, abs=10)


def test_shape_cases(spark):
    def quality(ring, **kw):
        b = g.obb(ring)
        return g.shape_quality(g.area(ring), b.width, b.length, **kw)

    good = g.ring_of((0, 0), (50, 0), (50, 40), (0, 40))
    tri = g.ring_of((0, 0), (60, 0), (30, 50))
    long = g.ring_of((0, 0), (200, 0), (200, 10), (0, 10))
    q1, q2, q3 = one(spark, quality(good), quality(tri), quality(long))
    assert q1.is_valid and q1.score > 0.8
    assert not q2.is_valid and not q3.is_valid
    assert one(spark, g.classify_lot(g.area(tri), F.lit(False)))[0] == "green_space"


def test_convex_hull_drops_inner_points(spark):
    hull = one(spark, g.convex_hull(g.ring_of((0, 0), (5, 5), (10, 0), (10, 10), (5, 8), (0, 10))))[0]
    assert {(p.x, p.y) for p in hull} == {(0, 0), (10, 0), (10, 10), (0, 10)}


def test_clip_two_half_planes(spark):
    ring = g.clip_convex(g.ring_of((0, 0), (100, 0), (100, 50), (0, 50)), F.array(g.half_plane(1, 0, 80), g.half_plane(-1, 0, -24)))
    assert one(spark, g.area(ring))[0] == pytest.approx(2800)


def test_lot_widths_are_optimal(spark):
    """Cost |L - n t| + (M - n) t over feasible n, as the width optimisation defines it."""
    lo, hi, t = 5.0, 8.0, 6.0
    for length in (23.0, 31.0, 44.0, 50.0, 61.5):
        ws = one(spark, ge.lot_widths(F.lit(length), lo, hi, t))[0]
        m = int(length / lo) + 1
        cost = {n: abs(length - n * t) + (m - n) * t for n in range(1, m + 1) if lo <= length / n <= hi}
        assert sum(ws) == pytest.approx(length)
        if cost:
            assert cost[len(ws)] == pytest.approx(min(cost.values()))


def test_orthogonal_slice_keeps_the_area(spark):
    block = spark.range(1).select(
        F.lit(1).alias("block_id"), g.ring_of((0, 0), (100, 0), (100, 50), (0, 50)).alias("ring"),
        F.array(*[F.lit(25.0)] * 4).alias("widths"),
    )
    lots = ge.orthogonal_slice(block).collect()
    assert len(lots) == 4 and sum(r.lot_sqm for r in lots) == pytest.approx(5000)


def test_sampled_layouts_do_not_overlap_and_stay_inside(spark):
    sites = spark.range(1).select(
        F.lit(7).cast("long").alias("site_id"), g.ring_of((0, 0), (500, 0), (500, 400), (300, 500), (0, 400)).alias("ring")
    )
    rows = ge.sample_layouts(sites, 4, 15).collect()
    again = ge.sample_layouts(sites.repartition(5), 4, 15).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and rows
    for a in rows:
        assert a.x >= 10 and a.y >= 10 and a.x + a.w <= 490
        for b in rows:
            if a.candidate_no == b.candidate_no and a.plot_no < b.plot_no:
                assert not (a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)


def test_area_in_a_rectangle_equals_the_clipped_area(spark):
    """Star-shaped rings either way round, with upright, level and slanted sides, against the clipped ring."""
    rng, rows = random.Random(11), []
    for k in range(300):
        n = rng.randint(3, 9)
        turns = sorted(rng.sample(range(24), n))
        if max((b - a) % 24 for a, b in zip(turns, turns[1:] + turns[:1])) >= 12:
            continue  # not around the centre
        points = [(50 + rng.randint(10, 45) * math.cos(t * math.pi / 12), 50 + rng.randint(10, 45) * math.sin(t * math.pi / 12)) for t in turns]
        points = [(float(round(x)), float(round(y))) for x, y in points] if k % 2 else points
        ring = [{"x": x, "y": y} for x, y in (points if k % 3 else points[::-1])]
        rows.append((ring, *[float(rng.choice([rng.randint(0, 80), rng.uniform(0, 80)])) for _ in range(2)], *[float(rng.randint(1, 60)) for _ in range(2)]))
    rows += [([], 0.0, 0.0, 5.0, 5.0), (None, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>, x double, y double, w double, h double")
    x, y, w, h = (F.col(c) for c in "xywh")
    clipped = g.area(g.clip_convex(F.col("ring"), g.rect_planes(x, y, x + w, y + h)))
    got = df.select(g.area_in_rect(F.col("ring"), x, y, w, h).alias("a"), clipped.alias("b")).collect()
    assert len(got) > 100 and sum(r.a is None for r in got) == 1
    assert all(abs(r.a - r.b) < 1e-5 for r in got if r.a is not None)
