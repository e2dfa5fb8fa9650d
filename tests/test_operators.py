"""Networks, prefixes, joins, files and streams against brute force on small tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators import network as nw, pairs as pr, sweeps as sw, windows as wi
from parcelgrid.operators.prefix import PLACE_BITS, ordered_ranges, ranked
from parcelgrid.sources import dxf, geojson
from parcelgrid.sources.regulations import load_regulations


def test_ranked_equals_a_plain_window_with_ties_and_one_hot_group(spark):
    rng = random.Random(5)
    rows = [(0 if i % 3 else i % 7, float(rng.choice([1, 1, 1, 2, 5, 9])), i, float(i % 11)) for i in range(600)]
    got = ranked(spark.createDataFrame(rows, "k long, v double, id long, a double"), ["k"], "v", "id", ["a"]).collect()
    assert len(got) == 600
    for k in {r[0] for r in rows}:
        want, run = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 0.0
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.rn)
        for i, (w, m) in enumerate(zip(want, mine)):
            assert (m.rn, m.id, m.n) == (i + 1, w[2], len(want)) and m.a_before == pytest.approx(run)
            run += w[3]


def test_ranges_are_even_with_a_dominant_value_and_far_outliers(spark):
    """95 % equal values, the rest at two scales; names as keys, one of them null."""
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 'north' ELSE 'hot' END AS name", "id AS lot",
        "CASE WHEN id % 20 > 0 THEN 5.0 WHEN id % 40 = 0 THEN id * 1e9 ELSE id * 1e-9 END AS z",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ordered_ranges(rows, ["name", "z", "lot"])
        sizes = [r[1] for r in ranges.groupBy(F.shiftright("_at", PLACE_BITS)).count().collect()]
        plan = ranges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert plan.count("Exchange") == 1
    got = ranked(rows, ["name"], "z", "lot", ["z"])
    want = rows.selectExpr(
        "name", "lot", "row_number() OVER (PARTITION BY name ORDER BY z, lot) AS rn", "count(*) OVER (PARTITION BY name) AS n"
    )
    assert got.select("name", "lot", "rn", "n").exceptAll(want).isEmpty() and got.count() == 60_000


def test_running_sums_across_ranges_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).selectExpr("id % 3 AS site_id", "id AS lot", "id % 10 AS z", "IF(id % 9 = 0, NULL, CAST(id AS DOUBLE)) AS a")
        got = ranked(rows, ["site_id"], "z", "lot", ["a"]).select("lot", "a_before", "a_total").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.lot: (r.b or 0.0, r.t) for r in rows.selectExpr(
        "lot", "sum(a) OVER (PARTITION BY site_id ORDER BY z, lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b",
        "sum(a) OVER (PARTITION BY site_id) AS t").collect()}
    assert {r.lot: (r.a_before, r.a_total) for r in got} == want


@pytest.mark.parametrize("order", ["CAST(id AS DOUBLE)", "IF(id < 95, 3.0, id * 1e6)", "5.0", "IF(id % 2 = 0, NULL, 1.0)"])
def test_the_oldest_tenth_goes(spark, order):
    rows = spark.range(230).selectExpr("id AS session_id", f"{order} AS t")
    stay = {r.session_id for r in wi.evict_oldest(rows, "t", "session_id", limit=200).collect()}
    ids = [r.session_id for r in rows.orderBy(F.asc_nulls_first("t"), "session_id").collect()]
    assert stay == set(ids[23:])
    assert wi.evict_oldest(rows, "t", "session_id").count() == 230


def test_euclidean_mst_with_copies_and_far_clusters(spark):
    rng = random.Random(3)
    pts = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(20)] + [(900, 900)] * 5 + [(905, 900), (300, 40)]
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "site_id long, node long, px double, py double")
    tree = nw.euclidean_mst(df, 20.0).collect()
    seen, total = {0}, 0.0
    while len(seen) < len(pts):
        d, j = min((math.dist(pts[i], pts[j]), j) for i in seen for j in range(len(pts)) if j not in seen)
        seen.add(j)
        total += d
    assert len(tree) == len(pts) - 1 and sum(r.weight for r in tree) == pytest.approx(total)


def test_cone_edges_hold_the_tree_and_stay_linear(spark):
    rng = random.Random(6)
    sites = {
        1: [(rng.random() * 900, rng.random() * 300) for _ in range(150)], 2: [(float(k), 5.0) for k in range(40)],
        3: [(float(i), float(j)) for i in range(8) for j in range(8)], 4: [(7.0, 7.0)],
        5: [(rng.random(), rng.random()) for _ in range(60)] + [(1e5 + rng.random(), rng.random()) for _ in range(60)],
        6: [(math.cos(k / 9), math.sin(k / 9)) for k in range(56)],
    }
    rows = [(s, 100 * s + i, x, y) for s, pts in sites.items() for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "site_id long, node long, px double, py double")
    edges = nw.cone_edges(df).collect()
    assert len(edges) <= nw.SECTORS * len(rows)
    tree = {}
    for r in nw.euclidean_mst(df).collect():
        tree.setdefault(r.site_id, set()).add((r.u, r.v))
    for s, pts in sites.items():
        root = list(range(len(pts)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        want = set()
        pairs = ((math.dist(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(pts), 2))
        for _, i, j in sorted(pairs, key=lambda e: (round(e[0], 9), *e[1:])):
            if find(i) != find(j):
                root[find(i)] = find(j)
                want.add((100 * s + i, 100 * s + j))
        assert tree.get(s, set()) == want, s


def test_pareto_members_do_not_dominate_each_other(spark):
    rng = random.Random(9)
    rows = [(i % 2, i, *[float(rng.randint(0, 6)) for _ in range(3)]) for i in range(80)]
    front = sw.pareto_front(spark.createDataFrame(rows, "site_id long, layout_id long, f1 double, f2 double, f3 double"), 3)

    def dominated(r):
        return any(q[0] == r[0] and all(a <= b for a, b in zip(q[2:], r[2:])) and q[2:] != r[2:] for q in rows)

    assert {r.layout_id for r in front.collect()} == {r[1] for r in rows if not dominated(r)}


@pytest.mark.parametrize("block", [4, 512])
def test_pareto_front_over_blocks(spark, monkeypatch, block):
    """A flat front, a random cloud, ties and nulls, against all pairs."""
    monkeypatch.setattr(sw, "BLOCK_VECTORS", block)
    rng = random.Random(block)
    rows = [(1, i, float(i), float(60 - i), 1.0) for i in range(60)] + [(1, 100 + i, i + 0.5, 60.5 - i, 1.0) for i in range(60)]
    rows += [(2, i, *[rng.random() for _ in range(3)]) for i in range(120)] + [(None, i, 1.0, float(i % 3), 2.0) for i in range(9)]
    rows += [(3, i, None if i % 4 else 5.0, float(i), float(-i)) for i in range(20)]
    front = sw.pareto_front(spark.createDataFrame(rows, "site_id long, layout_id long, f1 double, f2 double, f3 double"), 3)
    low = [(*r[:2], *[-math.inf if x is None else x for x in r[2:]]) for r in rows]

    def dominated(r):
        return any(q[0] == r[0] and all(a <= b for a, b in zip(q[2:], r[2:])) and q[2:] != r[2:] for q in low)

    assert {(r.site_id, r.layout_id) for r in front.collect()} == {r[:2] for r in low if not dominated(r)}


def test_a_front_of_many_incomparable_candidates(spark):
    rows = spark.range(100_000).selectExpr("1 AS site_id", "id AS layout_id", "id AS f1", "100000 - id AS f2", "0 AS f3")
    assert sw.pareto_front(rows, 3).count() == 100_000


def test_pair_joins_are_bucketed_and_independent_of_partitioning(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, *[float(rng.randint(0, 300)) for _ in range(2)], float(rng.randint(20, 250)), float(rng.randint(20, 90))) for i in range(60)]
    df = spark.createDataFrame(rows, "layout_id long, plot_no long, x double, y double, w double, h double")
    pairs = pr.overlap_pairs(df, cell_m=40.0)
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = {
        (a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2)
        if a[0] == b[0] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    }
    for n in (1, 16):
        got = pr.overlap_pairs(df.repartition(n), cell_m=40.0).collect()
        assert len(got) == len(want) and {(r.layout_id, r.a, r.b) for r in got} == want
    ringed = df.withColumn("ring", g.rect_ring(*(F.col(k) for k in "xywh")))
    assert {(r.layout_id, r.a, r.b) for r in pr.overlap_pairs_ring(ringed, ["layout_id"], "plot_no").collect()} == want


def test_dxf_files_round_trip(spark, tmp_path):
    features = spark.range(20).select(
        (F.col("id") % 2).alias("site_id"), F.col("id").alias("feature_no"), F.lit("block").alias("kind"),
        g.rect_ring(F.col("id") * 10.0, F.lit(0.0), F.lit(8.0), F.lit(5.0)).alias("ring"),
        F.format_string("P%d", F.col("id")).alias("label"),
    )
    dxf.write_dxf(features, str(tmp_path / "out"))
    entities = dxf.parse_dxf(geojson.read_documents(spark, str(tmp_path / "out" / "*" / "*.txt")))
    rows = entities.select("layer", "is_closed", g.area(F.col("points")).alias("a")).collect()
    assert len(rows) == 20 and all(r.layer == "BLOCKS" and r.is_closed and r.a == pytest.approx(40) for r in rows)


def test_geojson_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,0]]]}')
    (tmp_path / "b.json").write_text('{"type":"FeatureCollection","features":[]}')
    rows = geojson.parse_geojson(geojson.read_documents(spark, str(tmp_path))).orderBy("path").collect()
    assert rows[0].role == "boundary" and len(rows[0].ring) == 3 and rows[1].error == "empty document"


def test_regulations_file_overrides_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"setback_m": 20}')
    row = load_regulations(spark, str(tmp_path / "r.json")).first()
    assert (row.setback_m, row.far_max) == (20.0, 0.7)
