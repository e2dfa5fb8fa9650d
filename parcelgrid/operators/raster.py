"""Cell rasters: areas of shapes that have no closed form here.  Results carry the resolution they were made at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators import runs as rn
from parcelgrid.operators.bucket import near_pairs, spread
from parcelgrid.session import cut_lineage


def site_cells(sites: DataFrame, size: float) -> DataFrame:
    """Cells of side ``size`` whose centre lies inside the site: ``site_id, i, j, x, y, w, h`` of the cell."""
    s = g.materialize(spread(sites.select("site_id", "ring"), "site_id"), _m=g.bounds(F.col("ring")))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size).cast("int"), F.ceil(F.col(hi) / size).cast("int") - 1)

    c = s.withColumn("i", F.explode(span("_m.minx", "_m.maxx"))).withColumn("j", F.explode(span("_m.miny", "_m.maxy")))
    centre = g.pt((F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size)
    return c.filter(g.point_in_ring(F.col("ring"), centre)).select(
        "site_id", "i", "j", (F.col("i") * size).alias("x"), (F.col("j") * size).alias("y"), F.lit(float(size)).alias("w"),
        F.lit(float(size)).alias("h"),
    )


def centres(cells: DataFrame) -> DataFrame:
    """Cells shrunk to their centre points, for distance tests."""
    return cells.select(
        "site_id", "i", "j", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"),
        F.lit(0.0).alias("w"), F.lit(0.0).alias("h"),
    )


def dead_zones(sites: DataFrame, roads: DataFrame, max_d: float, size: float = 10.0, min_area: float = 100.0) -> DataFrame:
    """Parts of a site farther than ``max_d`` from all roads, straight ones of any direction; a site without roads is one
    dead zone.  Roads without a place are ignored."""
    rows = rn.site_rows(sites, size)
    line = F.struct(g.pt(F.col("x1"), F.col("y1")).alias("p"), g.pt(F.col("x2"), F.col("y2")).alias("q"))
    shapes = roads.select("site_id", F.array(line).alias("sides"), F.lit(float(max_d)).alias("reach"))
    far = rn.free_runs(rn.site_runs(rows, size), rn.shape_runs(shapes, rows, size))
    return rn.part_areas(rn.label_runs(far), size, min_area + g.EPS)


def dead_area(sites: DataFrame, lines: DataFrame, max_d: float, size: float, options: DataFrame) -> DataFrame:
    """Dead area of each site under each of its options, without labelling parts.

    ``options(site_id, step)``; ``lines(site_id, step, path)`` are straight roads between two points.  Land is cut into
    runs once for each site.
    """
    key = F.struct("site_id", "step").alias("site_id")
    rows = rn.site_rows(sites, size)
    land = rn.site_runs(rows, size).join(options, "site_id").select(key, "j", "lo", "hi")
    line = F.struct(F.col("path")[0].alias("p"), F.col("path")[1].alias("q"))
    shapes = lines.select(key, F.array(line).alias("sides"), F.lit(float(max_d)).alias("reach"))
    span = rows.join(options, "site_id").select(key, "j0", "j1")
    far = rn.free_runs(land, rn.shape_runs(shapes, span, size))
    return far.groupBy("site_id").agg(rn.run_area(size).alias("dead_sqm")).select("site_id.site_id", "site_id.step", "dead_sqm")


def _box_sides(box: dict[str, Column]) -> Column:
    return g.edges(g.rect_ring(box["x"], box["y"], box["w"], box["h"]))


def buildable_area(sites: DataFrame, constraints: DataFrame, size: float = 5.0) -> DataFrame:
    """Site area less its hard constraints and their buffers, each place counted once.

    A cell is lost if its centre lies within ``buffer_m`` of a hard constraint.
    """
    hard = constraints.filter("is_hard").select(
        "site_id", _box_sides(g.rect_of()).alias("sides"), F.coalesce("buffer_m", F.lit(0.0)).alias("reach")
    )
    rows = rn.site_rows(sites, size)
    land = rn.site_runs(rows, size)
    free = rn.free_runs(land, rn.shape_runs(hard, rows, size)).groupBy("site_id").agg(rn.run_area(size).alias("_free"))
    none = rn.shape_runs(hard.limit(0), rows, size)
    every = rn.free_runs(land, none).groupBy("site_id").agg(rn.run_area(size).alias("_every"))
    lost = every.join(free, "site_id", "left").select(
        "site_id", (F.col("_every") - F.coalesce("_free", F.lit(0.0))).alias("blocked_sqm")
    )
    s = g.materialize(sites.select("site_id", "ring"), site_sqm=g.area(F.col("ring")))
    return s.join(lost, "site_id", "left").select(
        "site_id", "site_sqm", F.coalesce("blocked_sqm", F.lit(0.0)).alias("blocked_sqm"),
        (F.col("site_sqm") - F.coalesce("blocked_sqm", F.lit(0.0))).alias("buildable_sqm"),
    )


def green_remainder(
    sites: DataFrame, plots: DataFrame, strips: DataFrame, size: float = 10.0, clearance: float = 2.0, min_area: float = 50.0,
    setback: float = 0.0,
) -> DataFrame:
    """Parts of the land inside the setback left over by plots and road strips widened by ``clearance``.

    ``plots(site_id, x, y, w, h)``; ``strips(site_id, ring)``, convex and of any direction.  Land nearer to the outline
    than ``setback`` is not counted, for concave outlines too.
    """
    zero = F.lit(0.0).alias("reach")
    boxes = plots.select("site_id", _box_sides(g.rect_of()).alias("sides"), zero)
    grown = g.materialize(strips, _w=g.obb(F.col("ring")))
    ux, uy, w, c = F.col("_w.ux"), F.col("_w.uy"), F.col("_w.width") / 2 + clearance, F.col("_w")
    half = F.col("_w.length") / 2 + clearance
    wide = g.ring_of(*[
        (c.cx + a * half * ux - b * w * uy, c.cy + a * half * uy + b * w * ux) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))
    ])
    rows = rn.site_rows(sites, size)
    taken = rn.shape_runs(boxes.unionByName(grown.select("site_id", g.edges(wide).alias("sides"), zero)), rows, size)
    if setback:
        edge = sites.select("site_id", F.explode(g.edges(F.col("ring"))).alias("_e"))
        rim = edge.select("site_id", F.array("_e").alias("sides"), F.lit(float(setback)).alias("reach"))
        taken = taken.unionByName(rn.shape_runs(rim, rows, size, closed=False))
    return rn.part_areas(rn.label_runs(rn.free_runs(rn.site_runs(rows, size), taken)), size, min_area)


def union_area(parts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Area covered by overlapping rectangles, every cell once.  Exact for corners on the raster."""
    def span(lo: str, side: str) -> Column:
        first = F.floor(F.col(lo) / size + 0.5)
        return F.when(
            F.floor((F.col(lo) + F.col(side)) / size + 0.5) > first,
            F.sequence(first, F.floor((F.col(lo) + F.col(side)) / size + 0.5) - 1),
        )

    rows = parts.select(*keys, F.explode(span("x", "w")).alias("i"), span("y", "h").alias("_j")).filter("_j IS NOT NULL")
    rows = rows.select(*keys, "i", F.col("_j")[0].alias("lo"), F.col("_j")[F.size("_j") - 1].alias("hi"))
    # a row of cells is marked in words of 64 bits, so a rectangle costs its rows and not its cells
    word = F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))).alias("word")
    rows = rows.select(*keys, "i", word, "lo", "hi")
    first, last = (F.col("word") * 64).cast("long"), (F.col("word") * 64 + 63).cast("long")
    rows = rows.withColumns({"_a": F.greatest("lo", first) - first, "_z": F.least("hi", last) - first})
    marks = F.expr("shiftleft(shiftrightunsigned(-1L, CAST(63 - _z + _a AS INT)), CAST(_a AS INT))")
    words = rows.groupBy(*keys, "i", "word").agg(F.bit_or(marks).alias("_bits"))
    return words.groupBy(*keys).agg((F.sum(F.bit_count("_bits")) * float(size * size)).alias("area_sqm"))


def nearest_seed_regions(cells: DataFrame, seeds: DataFrame, start_m: float) -> DataFrame:
    """Nearest seed of every cell, searched in rings that double until each cell has one.

    Seeds without a place are none; cells of a site without seeds have a null seed.
    """
    s = seeds.select(
        "site_id", "node", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h")
    ).filter(F.abs("x") + F.abs("y") < float("inf"))
    every = cut_lineage(centres(cells))
    todo = every.join(s.select("site_id"), "site_id", "left_semi")
    none = F.lit(None)
    done = every.join(s.select("site_id"), "site_id", "left_anti").select(
        "site_id", "i", "j", none.cast(s.schema["node"].dataType).alias("seed"), none.cast("double").alias("d")
    )
    radius = float(start_m)
    while True:
        # seeds are grown over cells of the grid, as they are fewer than the cells of the raster
        hit = near_pairs(s, todo, ["site_id"], radius, radius).groupBy("site_id", "i_b", "j_b").agg(
            F.min(F.struct(F.round("gap_m", 6).alias("d"), F.col("node").alias("seed"))).alias("_m")
        )
        hit = cut_lineage(hit.select("site_id", F.col("i_b").alias("i"), F.col("j_b").alias("j"), "_m.seed", "_m.d"))
        done = done.unionByName(hit)
        todo = cut_lineage(todo.join(hit.select("site_id", "i", "j"), ["site_id", "i", "j"], "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 2


def region_borders(regions: DataFrame) -> DataFrame:
    """Neighbouring cells that belong to different seeds."""
    b = regions.select("site_id", "i", "j", F.col("seed").alias("other"))
    right = regions.select("site_id", (F.col("i") + 1).alias("i"), "j", "seed", F.lit("x").alias("axis"))
    up = regions.select("site_id", "i", (F.col("j") + 1).alias("j"), "seed", F.lit("y").alias("axis"))
    return right.unionByName(up).join(b, ["site_id", "i", "j"]).filter("seed <> other")
