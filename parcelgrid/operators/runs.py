"""Run-length rasters: rows of cells as intervals.

A cell belongs to a shape if its centre does.  A scan line through the centres of a row meets an outline in intervals, and
a convex shape, grown by any reach, in one; so a row costs its crossings instead of its cells, and connected parts are
found over runs of cells instead of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.network import components
from parcelgrid.session import cut_lineage

#: Cells of a block in which runs of neighbouring rows meet.
BLOCK_CELLS = 64
#: Number of the cells of a column, so that a cell has one number.
COLUMN = 1 << 20


def _first(lo: Column, size: float) -> Column:
    """First row or column whose centre is not below ``lo``."""
    return F.ceil(lo / size - 0.5 - g.EPS).cast("int")


def _last(hi: Column, size: float) -> Column:
    return F.floor(hi / size - 0.5 + g.EPS).cast("int")


def _sequence(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def site_rows(sites: DataFrame, size: float) -> DataFrame:
    """``site_id, ring, j0, j1``: rows whose scan line can meet the site."""
    s = g.materialize(sites.select("site_id", "ring"), _m=g.bounds(F.col("ring")))
    return s.select("site_id", "ring", _first(F.col("_m.miny"), size).alias("j0"), _last(F.col("_m.maxy"), size).alias("j1"))


def site_runs(rows: DataFrame, size: float) -> DataFrame:
    """Runs ``site_id, j, lo, hi`` of cells whose centre lies inside or on the outline; runs of a row may touch."""
    r = rows.select("site_id", "ring", F.explode(_sequence(F.col("j0"), F.col("j1"))).alias("j"))
    r = r.withColumn("_y", (F.col("j") + 0.5) * size)
    y = F.col("_y")

    def spans(edges: Column) -> Column:
        crossed = F.filter(edges, lambda e: (e.p.y > y) != (e.q.y > y))
        xs = F.array_sort(F.transform(crossed, lambda e: e.p.x + (y - e.p.y) * (e.q.x - e.p.x) / (e.q.y - e.p.y)))
        pairs = F.transform(
            F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2))).otherwise(F.array().cast("array<int>")),
            lambda k: F.struct(xs[k].alias("a"), xs[k + 1].alias("b")),
        )
        # what only touches the scan line: sides along it, corners on it
        flat = F.filter(edges, lambda e: F.abs(e.p.y - y) <= g.EPS)
        touched = F.transform(flat, lambda e: F.when(
            F.abs(e.q.y - y) <= g.EPS, F.struct(F.least(e.p.x, e.q.x).alias("a"), F.greatest(e.p.x, e.q.x).alias("b"))
        ).otherwise(F.struct(e.p.x.alias("a"), e.p.x.alias("b"))))
        return F.concat(pairs, touched)

    r = g.materialize(r.select("site_id", "j", "ring", "_y"), _s=g.let(g.edges(F.col("ring")), spans))
    r = r.select("site_id", "j", F.explode("_s").alias("_s"))
    return r.select("site_id", "j", _first(F.col("_s.a"), size).alias("lo"), _last(F.col("_s.b"), size).alias("hi")).filter("lo <= hi")


def _reached(e: Column, reach: Column, y: Column) -> Column:
    """Places of the line at ``y`` that bound what lies within ``reach`` of a segment."""
    n = g.seg_len(e)
    nx, ny = F.coalesce(F.try_divide(e.p.y - e.q.y, n) * reach, F.lit(0.0)), F.coalesce(F.try_divide(e.q.x - e.p.x, n) * reach, F.lit(0.0))

    def disc(c: Column) -> Column:
        d = y - c.y
        half = F.sqrt(F.greatest(reach * reach - d * d, F.lit(0.0)))
        return F.when(F.abs(d) <= reach + g.EPS, F.array(c.x - half, c.x + half)).otherwise(F.array().cast("array<double>"))

    strip = g.ring_of((e.p.x - nx, e.p.y - ny), (e.q.x - nx, e.q.y - ny), (e.q.x + nx, e.q.y + ny), (e.p.x + nx, e.p.y + ny))
    on = F.filter(g.edges(strip), lambda s: (F.least(s.p.y, s.q.y) <= y + g.EPS) & (F.greatest(s.p.y, s.q.y) >= y - g.EPS))
    xs = F.flatten(F.transform(on, lambda s: F.when(F.abs(s.q.y - s.p.y) <= g.EPS, F.array(s.p.x, s.q.x)).otherwise(
        F.array(s.p.x + F.least(F.greatest((y - s.p.y) / (s.q.y - s.p.y), F.lit(0.0)), F.lit(1.0)) * (s.q.x - s.p.x)))))
    return F.concat(disc(e.p), disc(e.q), xs)


def shape_runs(shapes: DataFrame, rows: DataFrame, size: float, closed: bool = True) -> DataFrame:
    """Runs ``site_id, j, lo, hi`` of cells whose centre lies within ``reach`` of a convex shape, or nearer if not ``closed``.

    ``shapes(site_id, sides ARRAY<STRUCT<p, q>>, reach)``: a segment, or the sides of a convex ring.  Rows beyond the site
    are left out; shapes without a place or a reach are ignored.
    """
    ok = F.forall("sides", lambda e: (e.p.x + e.p.y + e.q.x + e.q.y).isNotNull()) & (F.size("sides") > 0) & (F.col("reach") >= 0)
    s = shapes.filter(ok).join(rows.select("site_id", "j0", "j1"), "site_id")
    ys = F.concat(F.transform("sides", lambda e: e.p.y), F.transform("sides", lambda e: e.q.y))
    s = g.materialize(s.select("site_id", "sides", "reach", "j0", "j1"), _y0=F.array_min(ys), _y1=F.array_max(ys))
    a = F.greatest(F.col("j0"), _first(F.col("_y0") - F.col("reach"), size))
    b = F.least(F.col("j1"), _last(F.col("_y1") + F.col("reach"), size))
    s = s.select("site_id", "sides", "reach", F.explode(_sequence(a, b)).alias("j"))
    y = (F.col("j") + 0.5) * size
    s = g.materialize(s, _x=F.flatten(F.transform("sides", lambda e: _reached(e, F.col("reach"), y))))
    s = s.filter(F.size("_x") > 0)
    inner = 0.0 if closed else 2 * g.EPS * size
    return s.select(
        "site_id", "j", _first(F.array_min("_x") + inner, size).alias("lo"), _last(F.array_max("_x") - inner, size).alias("hi")
    ).filter("lo <= hi")


def free_runs(land: DataFrame, taken: DataFrame) -> DataFrame:
    """Longest runs of cells of ``land`` outside of ``taken``, overlaps in either counted once.

    The runs of a row are cut at all ends, a running sum tells what covers each piece, and neighbouring pieces join.
    """
    def ends(df: DataFrame, name: str, other: str) -> DataFrame:
        change = F.explode(F.array(
            F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d"))
        )).alias("_e")
        return df.select("site_id", "j", change).select("site_id", "j", "_e.at", F.col("_e.d").alias(name), F.lit(0).alias(other))

    events = ends(land, "land", "taken").unionByName(ends(taken, "taken", "land"))
    events = events.groupBy("site_id", "j", "at").agg(F.sum("land").alias("land"), F.sum("taken").alias("taken"))
    row = Window.partitionBy("site_id", "j").orderBy("at")
    wanted = (F.sum("land").over(row) > 0) & (F.sum("taken").over(row) == 0)
    pieces = events.select("site_id", "j", "at", wanted.alias("free"))
    before = F.coalesce(F.lag("free").over(row), F.lit(False))
    turns = pieces.select("site_id", "j", "at", "free", before.alias("_was")).filter("free <> _was")
    return turns.select("site_id", "j", F.col("at").alias("lo"), (F.lead("at").over(row) - 1).alias("hi"), "free").filter("free").drop("free")


def label_runs(runs: DataFrame) -> DataFrame:
    """Runs with ``part``, the smallest cell number of their part; cells with a common side are connected."""
    n = cut_lineage(runs.withColumn("node", F.col("lo").cast("long") * COLUMN + F.col("j")))
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK_CELLS), F.floor(F.col("hi") / BLOCK_CELLS))).alias("block")
    here = n.select("site_id", "j", blocks, "lo", "hi", F.col("node").alias("v"))
    below = n.select("site_id", (F.col("j") + 1).alias("j"), blocks, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("u"))
    meet = (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))
    # two runs meet in several blocks, but first in one only
    once = F.floor(F.greatest("lo", "lo2") / BLOCK_CELLS) == F.col("block")
    edges = here.join(below, ["site_id", "j", "block"]).filter(meet & once).select("site_id", "u", "v")
    return n.join(components(n, edges), ["site_id", "node"]).select("site_id", "j", "lo", "hi", F.col("comp").alias("part"))


def run_area(size: float) -> Column:
    return F.sum((F.col("hi") - F.col("lo") + 1) * float(size * size))


def part_areas(labelled: DataFrame, size: float, min_area: float) -> DataFrame:
    parts = labelled.groupBy("site_id", "part").agg(
        run_area(size).alias("area_sqm"), F.min("lo").alias("i0"), F.min("j").alias("j0")
    )
    return parts.filter(F.col("area_sqm") >= min_area).withColumn("cell_m", F.lit(float(size)))
