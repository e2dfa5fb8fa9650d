"""Edit logs in log order: table, split table and stream against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators import design_fold as df
from parcelgrid.streaming import jobs

SCHEMA = (
    "design_id long, edit_no long, action string, target string, dx double, dy double, factor double, "
    "x1 double, y1 double, x2 double, y2 double"
)
CENTRE = {0: (50.0, 40.0), 1: (50.0, 40.0), 2: (50.0, 40.0)}


def log(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for no in range(n):
        action = rng.choice(["move"] * 6 + ["scale"] * 3 + ["delete", "convert_to_green", "add_road", "select"])
        factor = rng.choice([1.1, 0.8, 1.3, 0.0, None]) if action == "scale" else None
        target = None if action in ("scale", "add_road") else rng.choice([f"L{i}" for i in range(6)] + ["R7", "R40", "X"])
        road = [float(rng.randint(-30, 130)) for _ in range(4)] if action == "add_road" else [None] * 4
        rows.append((rng.randint(0, 2), no, action, target, float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), factor, *road))
    return rows


def replay(rows):
    """Position of lots by applying one edit after the other."""
    lots = {(d, f"L{i}"): [10.0 * i, 5.0 * i, 8.0, 6.0, "lot"] for d in CENTRE for i in range(5)}
    for d, no, action, target, dx, dy, factor, *_ in sorted(rows, key=lambda r: r[1]):
        at = lots.get((d, target))
        if action == "scale" and factor:
            cx, cy = CENTRE[d]
            for key, e in lots.items():
                if key[0] == d:
                    e[:4] = cx + factor * (e[0] - cx), cy + factor * (e[1] - cy), factor * e[2], factor * e[3]
        elif action == "move" and at:
            at[0] += dx
            at[1] += dy
        elif action == "delete" and at:
            del lots[d, target]
        elif action == "convert_to_green" and at:
            at[4] = "green"
    return lots


@pytest.fixture(scope="module")
def base(spark):
    lots = spark.createDataFrame(
        [(d, f"L{i}", "lot", 10.0 * i, 5.0 * i, 8.0, 6.0) for d in CENTRE for i in range(5)],
        "design_id long, target string, kind string, x double, y double, w double, h double",
    )
    outline = spark.range(3).select(F.col("id").alias("design_id"), g.rect_ring(*map(F.lit, (0.0, 0.0, 100.0, 80.0))).alias("ring"))
    centres = spark.createDataFrame([(d, *c) for d, c in CENTRE.items()], "design_id long, cx double, cy double")
    return lots, outline, centres


def positions(frame):
    return {(r.design_id, r.target): (r.x, r.y, r.w, r.h, r.kind) for r in frame.collect()}


def state(fold):
    return [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in part.collect()) for part in fold]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_a_replay(spark, base, seed):
    lots, _, centres = base
    rows = log(seed)
    got = positions(df.final_elements(lots, centres, df.fold_log(spark.createDataFrame(rows, SCHEMA))))
    want = replay(rows)
    assert got.keys() == want.keys()
    for key, e in want.items():
        assert got[key][:4] == pytest.approx(e[:4]) and got[key][4] == e[4]


def test_the_order_of_a_move_and_a_scale_matters(spark, base):
    lots, _, centres = base
    move, scale = ("move", "L1", 10.0, 0.0, None), ("scale", None, None, None, 2.0)
    one = [(0, no, *e, *[None] * 4) for no, e in enumerate([move, scale])]
    two = [(0, no, *e, *[None] * 4) for no, e in enumerate([scale, move])]
    at = lambda rows: positions(df.final_elements(lots, centres, df.fold_log(spark.createDataFrame(rows, SCHEMA))))[0, "L1"][:2]
    assert at(one) == (-10.0, -30.0) and at(two) == (-20.0, -30.0)


@pytest.mark.parametrize("cut", [0, 37, 119])
def test_parts_of_a_log_in_any_grouping(spark, cut):
    rows = log(3)
    fold = lambda r: df.fold_log(spark.createDataFrame(r, SCHEMA))
    whole = state(fold(rows))
    assert state(df.then(fold(rows[:cut]), fold(rows[cut:]))) == whole
    a, b, c = fold(rows[: cut // 2]), fold(rows[cut // 2 : cut]), fold(rows[cut:])
    assert state(df.then(a, df.then(b, c))) == state(df.then(df.then(a, b), c)) == whole


def test_roads_are_clipped_and_follow_the_design(spark, base):
    lots, outline, _ = base
    rows = [
        (0, 1, "add_road", None, None, None, None, -20.0, 40.0, 60.0, 40.0),
        (0, 2, "add_road", None, None, None, None, -20.0, 90.0, 60.0, 90.0),
        (0, 3, "move", "R1", 5.0, 0.0, None, *[None] * 4),
        (0, 4, "scale", None, None, None, 2.0, *[None] * 4),
        (0, 5, "add_road", None, None, None, None, 10.0, 10.0, 10.0, 30.0),
        (0, 6, "scale", None, None, None, -1.0, *[None] * 4),
        (0, 7, "add_road", None, None, None, None, 20.0, 10.0, 20.0, 30.0),
        (0, 8, "delete", "R7", None, None, None, *[None] * 4),
        (0, 9, "move", "R7", 1.0, 1.0, None, *[None] * 4),
        (0, 10, "move", "Q", 1.0, 1.0, None, *[None] * 4),
        (0, 11, "move", None, 1.0, 1.0, None, *[None] * 4),
    ]
    edits = spark.createDataFrame(rows, SCHEMA)
    fold = df.fold_log(edits)
    roads = {tuple(r)[1:] for r in df.final_roads(edits, outline, fold).collect()}
    assert roads == {("R1", 1, -40.0, 40.0, 80.0, 40.0), ("R5", 1, 10.0, 10.0, 10.0, 30.0)}
    refused = {(r.target, r.reason, r.n) for r in df.refused_edits(edits, lots, outline, fold).collect()}
    assert refused == {("R2", "outside", 1), (None, "bad_factor", 1), ("R7", "late", 1), ("Q", "unknown", 1)}


def test_an_empty_log(spark, base):
    lots, outline, centres = base
    edits = spark.createDataFrame([], SCHEMA)
    fold = df.fold_log(edits)
    assert df.final_elements(lots, centres, fold).count() == lots.count()
    assert df.final_roads(edits, outline, fold).count() == df.refused_edits(edits, lots, outline, fold).count() == 0


def test_stream_equals_the_table(spark, tmp_path):
    """Three batches in log order, one of them sent twice in part."""
    rows = log(4)
    parts = [rows[:50], rows[40:90], rows[90:]]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        q = jobs.start_design_fold(stream, str(tmp_path / "state"), str(tmp_path / "cp"), buckets=4)
        assert q.awaitTermination(120)
    assert state(jobs.current_design_fold(spark, str(tmp_path / "state"), 4)) == state(df.fold_log(spark.createDataFrame(rows, SCHEMA)))
    again = spark.read.parquet(str(tmp_path / "state" / "repeated")).select("edit_no").collect()
    assert sorted(r[0] for r in again) == list(range(40, 50))


def test_asset_gate_over_two_batches(spark, tmp_path):
    cols = "site_id long, asset_id long, type string, x double, y double, w double, h double"
    sites = spark.range(3).select(F.col("id").alias("site_id"), g.rect_ring(*map(F.lit, (0.0, 0.0, 100.0, 100.0))).alias("ring"))
    paths = [str(tmp_path / d) for d in ("store", "bad", "cp")]
    jobs.seed_assets(spark, spark.createDataFrame([(0, 1, "factory", 10.0, 10.0, 20.0, 20.0)], cols), paths[0], 4)
    arriving = spark.readStream.schema(cols).parquet(str(tmp_path / "in" / "*"))
    batches = [
        # one overlaps a stored asset, one is clipped at the outline, one has no site
        [(0, 2, "factory", 15.0, 15.0, 20.0, 20.0), (1, 3, "factory", 90.0, 15.0, 20.0, 20.0), (9, 4, "factory", 1.0, 1.0, 5.0, 5.0)],
        # what was clipped away of 3 is no obstacle, what is left of it is one
        [(1, 5, "factory", 91.0, 30.0, 5.0, 9.0), (2, 6, "factory", 5.0, 5.0, 9.0, 9.0)],
        [(1, 7, "factory", 50.0, 50.0, 9.0, 9.0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        assert jobs.start_asset_gate(arriving, sites, *paths, buckets=4).awaitTermination(120)
    kept = {r.asset_id: r.kept_sqm for r in jobs.current_assets(spark, paths[0], 4).collect()}
    assert kept == {1: 400.0, 3: 200.0, 6: 81.0, 7: 81.0}
    assert sorted(r.asset_id for r in spark.read.parquet(paths[1]).collect()) == [2, 4, 5]
