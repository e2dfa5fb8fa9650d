"""DXF text in batches: numbers as the engine formats and reads them, entities of odd drawings."""

from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g, text_kernels as tk
from parcelgrid.sources import dxf, geojson


def test_entities_are_read_in_batches(spark, monkeypatch):
    monkeypatch.setattr(tk, "PART", 40)
    docs = {
        "line": "0\nLINE\n8\nA\n10\n1\n20\n2\n11\n3\n21\n4",
        "poly": "0\r\nPOLYLINE\r\n8\r\nB\r\n70\r\n1\r\n10\r\n0\r\n20\r\n0\r\n0\r\nVERTEX\r\n10\r\n5\r\n20\r\n6\r\n0\r\nSEQEND\r\n",
        "odd": "9\nx\n 0 \n LWPOLYLINE\n70\n129\n10\n+1d\n20\nx\n10\n 2.5 \n0\nTEXT\n10\n9\n0\nLINE\n70\n1\n10",
        "shift": "x\n0\nLINE\n10\n1", "stray": "0\nVERTEX\n10\n1\n20\n1", "empty": "", "none": None,
    }
    d = spark.createDataFrame(list(docs.items()), "path string, value string").coalesce(1)
    e = dxf.parse_dxf(d)
    assert "lambda" not in e._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r.path, r.entity_no, r.kind, r.layer, r.is_closed, [tuple(p) for p in r.points]) for r in e.collect())
    assert got == [
        ("line", 0, "LINE", "A", False, [(1.0, 2.0), (3.0, 4.0)]),
        ("odd", 0, "LWPOLYLINE", None, True, [(1.0, None), (2.5, None)]),
        ("odd", 2, "LINE", None, False, []),
        ("poly", 0, "POLYLINE", "B", True, [(5.0, 6.0)]),
    ]


def test_six_decimals_are_those_of_the_engine(spark):
    values = [0.0, -0.0, -1e-9, 5e-7, 4.9999999e-7, 1.5e-6, 0.1234565, 2.0000015, 999999.9999995, 4649776.2246775, 1e14 + 0.5, float("nan"), float("-inf"), None]
    values += [k / 7e3 - 400 for k in range(4000)] + [k / 1e7 for k in range(4000)]
    rows = [(k, [dict(x=values[k], y=values[-1 - k])]) for k in range(len(values))] + [(-1, None), (-2, [])]
    text = F.concat(*[F.array_join(F.transform("ring", lambda p: F.format_string("10\n%.6f\n20\n%.6f\n", p.x, p.y)), "")])
    want = F.concat(F.lit("0\nLWPOLYLINE\n8\nQ\n90\n"), F.size("ring").cast("string"), F.lit("\n70\n1\n"), text)
    df = spark.createDataFrame(rows, f"k int, ring {g.RING}").coalesce(1)
    df = df.select("k", want.alias("want"), dxf.polyline_text(F.lit("Q"), F.col("ring")).alias("got"))
    assert df.filter("NOT want <=> got").collect() == []


def test_area_builds_no_list_of_sides(spark):
    ring = [dict(x=float(x), y=float(y)) for x, y in ((0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20))]
    df = spark.createDataFrame([(0, ring), (1, ring[::-1]), (2, []), (3, None), (4, ring[:1])], f"k int, ring {g.RING}")
    a = df.select("k", g.signed_area(F.col("ring")).alias("s"), g.area_of_column(F.col("ring")).alias("a")).orderBy("k")
    assert "zip_with" not in a._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.s, r.a) for r in a.collect()] == [(300.0, 300.0), (-300.0, 300.0), (0.0, 0.0), (None, None), (0.0, 0.0)]


def test_points_of_a_geojson_ring_are_made_once(spark):
    rows = [(0, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]), (1, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]]), (2, []), (3, [[1.0, 1.0]]), (4, None)]
    df = spark.createDataFrame(rows, "k int, raw array<array<double>>").select("k", geojson._opened(F.col("raw")).alias("ring"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("struct(x, lambda") == 1
    got = [r.ring and [tuple(p) for p in r.ring] for r in df.orderBy("k").collect()]
    triangle = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    assert got == [triangle, triangle, [], [(1.0, 1.0)], None]
