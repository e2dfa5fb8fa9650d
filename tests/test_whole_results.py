"""Nothing is cut off or lost: long chains, far parts, holes, many line parts, curves, empty groups."""

import json
import math

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators import arrangement as ar, network as nw, raster as ra, templates as te
from parcelgrid.sources import geojson
from parcelgrid.sources.regulations import load_regulations


def test_far_points_are_connected(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 300_000.0, 0.0), (2, 7, 5.0, 5.0)], "site_id long, node long, px double, py double")
    assert [(r.u, r.v, r.weight) for r in nw.euclidean_mst(df, 100.0).collect()] == [(1, 2, 300_000.0)]
    with pytest.raises(ValueError):
        nw.euclidean_mst(df.withColumn("px", F.lit(None).cast("double")), 100.0)


def test_large_ids_are_ranked_by_both_ends(spark):
    big = (1 << 40) + 3
    rows = [(1, big, big + 5, 2.0), (1, big, big + 4, 2.0), (1, 5, big, 2.0)]
    edges = spark.createDataFrame(rows, "site_id long, u long, v long, weight double")
    limits = spark.createDataFrame([(1, 2)], "site_id long, k long")
    assert sorted((r.u, r.v) for r in nw.shortest_per_site(edges, limits).collect()) == [(5, big), (big, big + 4)]


def test_cells_of_a_site_without_seeds_stay(spark):
    square = g.ring_of((0, 0), (F.lit(40.0), 0), (F.lit(40.0), F.lit(40.0)), (0, F.lit(40.0)))
    sites = spark.range(2).select((F.col("id") + 1).alias("site_id"), square.alias("ring"))
    seeds = spark.createDataFrame([(1, 9, 5_000.0, 0.0)], "site_id long, node long, px double, py double")
    got = ra.nearest_seed_regions(ra.site_cells(sites, 20.0), seeds, 10.0).collect()
    assert len(got) == 8 and {(r.site_id, r.seed) for r in got} == {(1, 9), (2, None)}


def test_curve_and_concave_ring(spark):
    n = 600
    circle = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: g.pt(100 * F.cos(2 * math.pi * k / n), 100 * F.sin(2 * math.pi * k / n)))
    ell = g.ring_of((0, 0), (F.lit(9.0), 0), (F.lit(9.0), F.lit(4.0)), (F.lit(4.0), F.lit(4.0)), (F.lit(4.0), F.lit(9.0)), (0, F.lit(9.0)))
    r = spark.range(1).select(g.area(g.drop_collinear(circle)).alias("a"), F.size(g.drop_collinear(circle)).alias("n"), g.inset(ell, 1.0).alias("i")).first()
    assert 3 <= r.n < n and abs(r.a - math.pi * 1e4) < 0.01 * math.pi * 1e4 and r.i is None


def test_holes_and_line_parts(spark):
    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [box(0, 10), box(2, 8)]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [10, 0]], [[0, 5], [30, 5]]]}},
    ]}
    rows = geojson.parse_geojson(spark.createDataFrame([("p", json.dumps(doc)), ("q", "{}")], "path string, value string"))
    areas = rows.select("feature_no", geojson.net_area(F.col("ring"), F.col("holes")).alias("a")).filter("a IS NOT NULL").collect()
    assert [(r.feature_no, r.a) for r in areas] == [(0, 64.0)]
    lengths = [r.m for r in rows.filter("role = 'road'").select(g.path_length(F.col("line")).alias("m")).collect()]
    assert sorted(lengths) == [10.0, 30.0] and rows.filter("error IS NOT NULL").count() == 1


def test_unknown_template_and_several_rule_documents(spark, tmp_path):
    sites = spark.createDataFrame([(1, "star"), (2, None), (3, "grid")], "site_id long, template string")
    assert [r.site_id for r in te.template_errors(sites).collect()] == [1, 2]
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"far_max": 0.5}))
    with pytest.raises(ValueError):
        load_regulations(spark, str(tmp_path))
    assert load_regulations(spark, str(tmp_path / "1.json")).first().far_max == 0.5


def test_third_road_splits_and_buffers_block(spark):
    square = g.ring_of((0, 0), (F.lit(90.0), 0), (F.lit(90.0), F.lit(90.0)), (0, F.lit(90.0)))
    sites = spark.range(1, 2).select(F.col("id").alias("site_id"), square.alias("ring"))
    roads = [(1, k, float(x), 0.0, float(x), 90.0, 2.0) for k, x in ((1, 20), (2, 40), (3, 60))]
    table = spark.createDataFrame(roads, "site_id long, road_no long, x1 double, y1 double, x2 double, y2 double, width_m double")
    assert ar.extract_blocks(sites, table).count() == 4
    stone = spark.createDataFrame([(1, 40.0, 40.0, 10.0, 10.0, 20.0, True)], "site_id long, x double, y double, w double, h double, buffer_m double, is_hard boolean")
    blocked = ra.buildable_area(sites, stone, size=1.0).first().blocked_sqm
    assert abs(blocked - (100 + 4 * 10 * 20 + math.pi * 400)) < 40
