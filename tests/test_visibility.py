"""Edges between obstacles of any shape."""

import random

from pyspark.sql import functions as F

from parcelgrid.operators import network as nw


def test_cells_along_a_segment(spark):
    rng = random.Random(5)
    rows = [(i, *[float(rng.randint(-500, 500)) for _ in range(4)]) for i in range(60)] + [(60, 0.0, 0.0, 10_000.0, 9_000.0), (61, 3.0, -7.0, 3.0, 90.0)]
    seg = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double")
    got = {}
    for r in nw._walked_cells(seg, 50.0).collect():
        got.setdefault(r.id, set()).add((r.cx, r.cy))
    for i, ax, ay, bx, by in rows:
        for k in range(1001):
            t = k / 1000
            assert (int((ax + t * (bx - ax)) // 50), int((ay + t * (by - ay)) // 50)) in got[i]
    assert len(got[60]) < 2 * (10_000 + 9_000) / 50


def test_obstacles_of_any_shape_and_their_buffers(spark):
    points = spark.createDataFrame(
        [(1, 1, 0.0, 50.0), (1, 2, 300.0, 50.0), (1, 3, 0.0, 130.0), (1, 4, 300.0, 130.0), (1, 5, None, 1.0), (1, 6, 150.0, 50.0)],
        "site_id long, node long, px double, py double",
    )
    edges = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 1, 3), (1, 1, 5), (1, 1, 6)], "site_id long, u long, v long")
    # a U whose inside is open at the top: 1-2 runs through both arms, 3-4 passes 30 m above them
    u = [(100.0, 0.0), (200.0, 0.0), (200.0, 100.0), (180.0, 100.0), (180.0, 20.0), (120.0, 20.0), (120.0, 100.0), (100.0, 100.0)]
    shapes = spark.createDataFrame([(1, u, 29.0), (1, u, None), (2, u, 500.0)], "site_id long, ring array<struct<x:double,y:double>>, keep_m double")

    def kept(frame, **more):
        return {(r.u, r.v) for r in nw.visibility_edges(edges, points, frame, 40.0, **more).collect()}

    assert kept(shapes) == kept(shapes, buffer="keep_m") == {(3, 4), (1, 3), (1, 5)}
    assert kept(shapes.withColumn("keep_m", F.lit(31.0)), buffer="keep_m") == {(1, 3), (1, 5)}
    # along the outer side of an arm is no way through it
    flush = spark.createDataFrame([(1, 50.0, 50.0, 20.0, 30.0)], "site_id long, x double, y double, w double, h double")
    assert kept(flush) == {(1, 2), (3, 4), (1, 3), (1, 5), (1, 6)}
    assert kept(flush.limit(0)) == {(1, 2), (3, 4), (1, 3), (1, 5), (1, 6)}
