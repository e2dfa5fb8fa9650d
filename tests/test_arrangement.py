"""Overlays, blocks, merged outlines and rings of loose lines against exhaustive search on small drawings."""

import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as g
from parcelgrid import session as sn
from parcelgrid.operators import arrangement as ar
from parcelgrid.sources import dxf

RING = "array<struct<x:double,y:double>>"
SIZE = 12
# quarters of a unit cell: every drawn edge runs along their sides
QUARTERS = [(i, j, q) for i in range(SIZE) for j in range(SIZE) for q in range(4)]
CENTRE = [(0.5, 1 / 6), (5 / 6, 0.5), (0.5, 5 / 6), (1 / 6, 0.5)]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def some_shape(rng):
    x, y = rng.randint(0, SIZE - 4), rng.randint(0, SIZE - 4)
    s = rng.randint(1, 2) * 2
    w, h = rng.randint(1, min(6, SIZE - x)), rng.randint(1, min(6, SIZE - y))
    shapes = [
        [(x, y), (x + w, y), (x + w, y + h), (x, y + h)],
        [(x, y), (x, y + h), (x + w, y + h), (x + w, y)],
        [(x, y), (x + s, y), (x, y + s)],
        [(x + s // 2, y), (x + s, y + s // 2), (x + s // 2, y + s), (x, y + s // 2)],
        [(x, y), (x + 4, y), (x + 4, y + 2), (x + 2, y + 2), (x + 2, y + 4), (x, y + 4)],
    ]
    return rng.choice(shapes)


def inside(shape, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(shape, shape[1:] + shape[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def areas(covered):
    """Sizes of the parts of a set of quarters that share sides."""
    left, out = set(covered), []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            i, j, q = todo.pop()
            size += 1
            across = [(i, j - 1, 2), (i + 1, j, 3), (i, j + 1, 0), (i - 1, j, 1)][q]
            for n in ((i, j, (q + 1) % 4), (i, j, (q + 3) % 4), across):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(size / 4)
    return sorted(out)


def quarters_in(shapes):
    return {(i, j, q) for i, j, q in QUARTERS if any(inside(s, i + CENTRE[q][0], j + CENTRE[q][1]) for s in shapes)}


def test_merged_outlines_and_overlays(spark):
    rng = random.Random(2)
    cases = [([some_shape(rng) for _ in range(rng.randint(1, 6))], [some_shape(rng) for _ in range(rng.randint(0, 4))]) for _ in range(60)]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    # a hole that touches the outline in a point, and a frame with an island in it
    cases += [([box(0, 0, 12, 12)], [[(2, 0), (4, 2), (2, 4), (0, 2)], box(6, 6, 2, 2), box(8, 8, 1, 1)])]
    cases += [([box(0, 0, 12, 12)], [box(2, 2, 8, 1), box(2, 9, 8, 1), box(2, 2, 1, 8), box(9, 2, 1, 8), box(5, 5, 2, 2)])]
    rows = [(k, n, "site", ring(*s)) for k, (a, b) in enumerate(cases) for n, s in enumerate(a)]
    rows += [(k, 100 + n, "road", ring(*s)) for k, (a, b) in enumerate(cases) for n, s in enumerate(b)]
    shapes = spark.createDataFrame(rows, f"site_id long, part_no int, role string, ring {RING}").repartition(5)
    merged = ar.dissolve(shapes.filter("role = 'site'"), ["site_id"], cell_m=5.0).collect()
    polygons = shapes.withColumn("poly", F.col("part_no").cast("string"))
    edges = ar.boundary_edges(polygons, ["site_id"], lambda n: (n["site"] > 0) & (n["road"] == 0), ["site", "road"], cell_m=3.0)
    land = ar.land_parts(edges, ["site_id"], cell_m=4.0).collect()
    for k, (a, b) in enumerate(cases):
        whole = quarters_in(a)
        assert sorted(round(r.area_sqm, 6) for r in merged if r.site_id == k) == areas(whole)
        assert sorted(r.merged_no for r in merged if r.site_id == k) == list(range(1, len(areas(whole)) + 1))
        assert sorted(round(r.area_sqm, 6) for r in land if r.site_id == k) == areas(whole - quarters_in(b))
    assert any(r.holes for r in land)
    for r in land:  # the outline itself, not only its size
        outer, holes = [(p.x, p.y) for p in r.ring], [[(p.x, p.y) for p in h] for h in r.holes]
        mine = quarters_in([outer]) - quarters_in(holes)
        assert len(mine) / 4 == pytest.approx(r.area_sqm)


def test_blocks_around_a_closed_road_a_dead_end_and_a_bend(spark):
    sites = spark.createDataFrame(
        [(1, ring((0, 0), (100, 0), (100, 100), (0, 100))), (2, ring((0, 0), (0, 60), (60, 60), (60, 0))), (3, None), (4, ring((0, 0), (1, 1)))],
        f"site_id long, ring {RING}")
    loop = ring((20, 20), (80, 20), (80, 80), (20, 80), (20, 20))
    paths = [(1, 1, loop, 4.0), (1, 2, ring((-10, 50), (10, 50)), 10.0), (2, 1, ring((30, -5), (30, 30), (65, 30)), 10.0),
             (2, 2, ring((500, 0), (600, 0)), 10.0), (2, 3, ring((5, 5), (5, 5)), 10.0), (2, 4, None, 10.0), (7, 1, loop, 4.0)]
    roads = spark.createDataFrame(paths, f"site_id long, road_no long, path {RING}, width_m double")
    got = {(r.site_id, r.block_no): r for r in ar.extract_blocks(sites, roads, min_area=0.0).collect()}
    assert {k: round(r.area_sqm, 6) for k, r in got.items()} == {
        (1, 1): 10_000 - 100 - (64 * 64 - 16), (1, 2): 56 * 56, (2, 1): 60 * 60 - (300 + 300 - 25) - 25 * 25, (2, 2): 25 * 25}
    assert [len(got[1, n].holes) for n in (1, 2)] == [1, 0]
    assert ar.extract_blocks(sites, roads.limit(0), min_area=0.0).count() == 2
    assert ar.extract_blocks(sites.limit(0), roads).count() == 0


def line(path, no, ax, ay, bx, by):
    return (path, no, "LINE", "LOTS", False, ring((ax, ay), (bx, by)))


def test_rings_of_loose_lines(spark):
    rows = []
    # a ring of a thousand lines, shuffled and turned at random, ends off by less than the snap distance
    rng = random.Random(4)
    corners = [(float(k), 0.0) for k in range(500)] + [(500.0 - k, 40.0) for k in range(500)]
    for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])):
        p, q = [(x + rng.choice([0, 0.002]), y + rng.choice([0, -0.002])) for x, y in (a, b)]
        rows.append(line("long", k, *(p + q if rng.random() < 0.5 else q + p)))
    rows += [line("open", k, k, 0, k + 1, 0) for k in range(5)]
    square = [(0, 0), (9, 0), (9, 9), (0, 9)]
    rows += [line("tail", k, *square[k], *square[(k + 1) % 4]) for k in range(4)] + [line("tail", 4, 9, 9, 12, 12)]
    rows += [line("two", k, 0, 0, 5, 5) for k in range(2)] + [line("dot", 0, 3, 3, 3.001, 3)]
    rows += [("bad", 0, "LINE", "LOTS", False, ring((1, 1))), ("bad", 1, "LINE", "LOTS", False, [{"x": None, "y": 1.0}, {"x": 2.0, "y": 2.0}])]
    rng.shuffle(rows)
    entities = spark.createDataFrame(rows, f"path string, entity_no int, kind string, layer string, is_closed boolean, points {RING}")
    rings = dxf.assemble_rings(entities)
    assert "Pandas" not in rings._jdf.queryExecution().executedPlan().toString()
    got = {(r.path, r.status): r for r in rings.withColumn("a", g.signed_area(F.col("ring"))).collect()}
    assert set(got) == {("long", "ring"), ("open", "open"), ("tail", "open"), ("two", "open")}
    assert [got[k].n_lines for k in sorted(got)] == [1000, 5, 5, 2]
    long = got["long", "ring"]
    assert len(long.ring) == 1000 and long.a == pytest.approx(500 * 40 - 40 / 2 - 40 / 2 + 40, abs=40) and long.a > 0
    assert long.comp == 0
    where = [min(range(1000), key=lambda k: (corners[k][0] - p.x) ** 2 + (corners[k][1] - p.y) ** 2) for p in long.ring]
    assert all((b - a) % 1000 == 1 for a, b in zip(where, where[1:]))
    assert dxf.assemble_rings(entities.limit(0)).count() == 0


def test_points_meet_across_cells_and_in_chains(spark):
    points = [(1, 0.0), (1, 0.004), (1, 0.008), (1, 99.998), (1, 100.002), (2, 0.004), (2, 7.0), (1, 50.0)]
    df = spark.createDataFrame([(s, x, 3.0) for s, x in points], "site_id long, px double, py double")
    moved = {(r.site_id, r.px): r.nx for r in ar.snapped(df, ["site_id"], 0.005).collect()}
    assert moved == {(1, 0.0): 0.0, (1, 0.004): 0.0, (1, 0.008): 0.0, (1, 99.998): 99.998, (1, 100.002): 99.998}


def test_keys_of_few_sides_are_merged_in_a_row_as_the_large_ones_over_cells(spark, monkeypatch):
    rng = random.Random(7)
    cases = [[some_shape(rng) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    # slanted outlines, corners that miss each other by less than the snap distance, and one without an area
    cases += [[[(0, 0), (9, 1), (8, 7), (1, 6)], [(4, -3), (7, 9), (3, 9.5)], [(-2, 2), (11, 3), (11, 4), (-2, 3)]],
              [[(0, 0), (4, 0), (4, 4), (0, 4)], [(4 + 2e-7, 0), (8, 0), (8, 4), (4, 4 + 3e-7)], [(2, 2), (2, 2), (6, 2), (6, 3), (2, 3)], [(1, 1), (3, 1), (5, 1)]]]
    rows = [(k, n, ring(*s)) for k, shapes in enumerate(cases) for n, s in enumerate(shapes)]
    rows += [(900, 0, None), (900, 1, ring((0, 0), (1, 1))), (None, 0, ring((0, 0), (1, 0), (1, 1)))]
    rows += [(901, n, ring((n, 0), (n + 1, 0), (n + 1, 2), (n, 2))) for n in range(70)]  # more sides than a row takes
    parts = spark.createDataFrame(rows, f"site_id long, part_no int, ring {RING}").repartition(3)
    written = []
    monkeypatch.setattr(ar, "cut_lineage", lambda df: written.append(df.columns) or sn.cut_lineage(df))

    def result(**how):
        got = ar.dissolve(parts, ["site_id"], cell_m=5.0, **how)
        assert dict(got.dtypes)["merged_no"] == "bigint"
        turned = lambda r: min(tuple(r[k:] + r[:k]) for k in range(len(r)))
        plain = lambda r: turned([(round(p.x, 5), round(p.y, 5)) for p in r])
        return {(r.site_id, r.merged_no): (round(r.area_sqm, 5), plain(r.ring), sorted(plain(h) for h in r.holes)) for r in got.collect()}

    few = ar.dissolve(parts.filter("site_id < 900"), ["site_id"])
    assert few.count() > 40 and len(written) == 1  # nothing but the large keys, of which there are none
    mixed, spread_out, rowwise = result(), result(few_sides=0), result(few_sides=10_000)
    assert mixed == spread_out == rowwise
    assert mixed[901, 1] == (140.0, ((0.0, 0.0), (70.0, 0.0), (70.0, 2.0), (0.0, 2.0)), [])
    assert {k for k, _ in mixed} >= set(range(len(cases))) and not {k for k, _ in mixed} & {900, None}
