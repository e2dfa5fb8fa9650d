"""Planar geometry as column expressions.

A ring is an open, counter-clockwise ``array<struct<x:double,y:double>>``; a path is the same type read as
a polyline.  Most of it is built from Spark's own functions, so Catalyst can prune and push around it.  Higher-order
functions leave whole-stage codegen, therefore axis-parallel rectangles have scalar counterparts (``rect_*``) that stay
inside it.  Measures that take thousands of such steps a row (``kernels``: box, inset, clipping, containment, distance) work on
whole Arrow batches; they stand on columns, not inside of lambdas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from parcelgrid.functions import kernels, overlay_kernels, text_kernels

EPS = 1e-9
POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"

Num = Column | float | int


# executors need not have this package
register_pickle_by_value(kernels)
register_pickle_by_value(text_kernels)
register_pickle_by_value(overlay_kernels)

_POINTS = ArrayType(StructType([StructField(k, DoubleType()) for k in "xy"]))
_NEAREST = StructType([StructField("dist", DoubleType()), StructField("seg", IntegerType()), *[StructField(k, DoubleType()) for k in "xy"]])
_LOTS = ArrayType(StructType([StructField("ring", _POINTS), StructField("sqm", DoubleType())]))
_PARTS = ArrayType(StructType([StructField("ring", _POINTS), StructField("holes", ArrayType(_POINTS)), StructField("area_sqm", DoubleType())]))
_ENTITIES = ArrayType(StructType([
    StructField("entity_no", IntegerType()), *[StructField(k, StringType()) for k in ("kind", "layer", "flag")], StructField("points", _POINTS),
]))
_BOX = StructType([StructField(k, DoubleType()) for k in kernels.BOX])


def _batched(kernel: Callable, result: DataType, *columns: Column) -> Column:
    """Column of a kernel over Arrow batches."""
    return F.arrow_udf(kernel, result)(*columns)


def num(value: Num) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def materialize(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` the optimizer does not see through.

    A filter on a derived column is pushed below its projection as a copy of the whole expression, and copies of
    copies add up for nested geometry.  Going through a one-element ``explode`` keeps one evaluation per row;
    predicates and pruning on all other columns still pass.
    """
    one = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    keep = [c for c in df.columns if c not in columns]
    return df.withColumn("_one", F.explode(one)).select(*keep, *[F.col(f"_one.{k}").alias(k) for k in columns])


def empty_ring() -> Column:
    return F.array().cast(RING)


def pt(x: Num, y: Num) -> Column:
    return F.struct(num(x).cast("double").alias("x"), num(y).cast("double").alias("y"))


def ring_of(*points: tuple[Num, Num]) -> Column:
    return F.array(*[pt(x, y) for x, y in points])


def rect_ring(x: Num, y: Num, w: Num, h: Num) -> Column:
    x, y, w, h = num(x), num(y), num(w), num(h)
    return ring_of((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def shift_left(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    return F.zip_with(ring, shift_left(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def segments(path: Column) -> Column:
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(
        F.slice(path, 1, n), F.slice(path, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    )


def _sum(array: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)


def seg_len(e: Column) -> Column:
    return F.hypot(e.q.x - e.p.x, e.q.y - e.p.y)


# ---------------------------------------------------------------- measures


def signed_area(ring: Column) -> Column:
    """Sides are added in their order while the last point is carried along, so no list of sides is built."""

    def side(acc: Column, p: Column) -> Column:
        term = acc.x * p.y - p.x * acc.y
        return F.struct(p.x.alias("x"), p.y.alias("y"), acc.fx.alias("fx"), acc.fy.alias("fy"), (acc.s + term).alias("s"))

    # the first step is the side from the first point to itself, the closing side comes last
    first = F.get(ring, F.lit(0))
    start = F.struct(*[first[k[-1]].alias(k) for k in ("x", "y", "fx", "fy")], F.lit(0.0).alias("s"))
    total = F.aggregate(ring, start, side, lambda acc: acc.s + (acc.x * acc.fy - acc.fx * acc.y))
    return F.when(F.size(ring) == 0, 0.0).otherwise(total) * 0.5


def area(ring: Column, holes: Column | None = None) -> Column:
    outer = F.abs(signed_area(ring))
    if holes is None:
        return outer
    inner = F.aggregate(holes, F.lit(0.0), lambda acc, h: acc + F.abs(signed_area(h)))
    return outer - F.coalesce(inner, F.lit(0.0))


def area_of_column(ring: Column) -> Column:
    """``area`` over Arrow batches, for a column that goes through other kernels anyway."""
    return _batched(kernels.area, DoubleType(), ring)


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), seg_len)


def path_length(path: Column) -> Column:
    return _sum(segments(path), seg_len)


def vertex_count(ring: Column) -> Column:
    return F.size(ring)


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def centroid(ring: Column) -> Column:
    """Area-weighted centroid; a ring without area falls back to its vertex mean."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        k = e.p.x * e.q.y - e.q.x * e.p.y
        return F.struct(
            (acc.a + k).alias("a"),
            (acc.x + (e.p.x + e.q.x) * k).alias("x"),
            (acc.y + (e.p.y + e.q.y) * k).alias("y"),
        )

    n = F.size(ring)
    mean = pt(
        F.try_divide(_sum(ring, lambda p: p.x), n), F.try_divide(_sum(ring, lambda p: p.y), n)
    )
    return F.aggregate(
        edges(ring),
        zero,
        step,
        lambda acc: F.when(F.abs(acc.a) < EPS, mean).otherwise(
            pt(acc.x / (acc.a * 3.0), acc.y / (acc.a * 3.0))
        ),
    )


def elevation(x: Num, y: Num) -> Column:
    return F.lit(50.0) - F.lit(0.02) * num(x) - F.lit(0.03) * num(y)


def legal_params(area_m2: Column) -> Column:
    density = F.when(area_m2 < 3000, 0.70).when(area_m2 < 10000, 0.65).otherwise(0.60)
    return F.struct(density.alias("density"), (area_m2 * density).alias("max_build_m2"))


# ---------------------------------------------------------------- clean-up and validity


def normalize_ring(ring: Column, tol: float = 0.1) -> Column:
    """Counter-clockwise, no closing point, no vertex closer than ``tol`` to the last kept one."""

    def keep(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = F.hypot(p.x - last.x, p.y - last.y) >= tol
        return F.when((F.size(acc) == 0) | far, F.concat(acc, F.array(p))).otherwise(acc)

    def unclosed(r: Column) -> Column:
        first, last = F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(-1))
        closed = (F.size(r) > 1) & (F.hypot(first.x - last.x, first.y - last.y) < tol)
        return F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)

    kept = F.aggregate(ring, empty_ring(), keep, unclosed)
    return let(kept, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def _proper_cross(e: Column, f: Column) -> Column:
    a, b = cross(e.p, e.q, f.p), cross(e.p, e.q, f.q)
    c, d = cross(f.p, f.q, e.p), cross(f.p, f.q, e.q)
    return (
        (((a > EPS) & (b < -EPS)) | ((a < -EPS) & (b > EPS)))
        & (((c > EPS) & (d < -EPS)) | ((c < -EPS) & (d > EPS)))
    )


def is_simple(ring: Column) -> Column:
    """At least three vertices, some area, and no two sides crossing."""
    return _batched(kernels.is_simple, BooleanType(), ring)


def is_convex(ring: Column) -> Column:
    """All turns to the same side, straight ones included."""
    return _batched(kernels.is_convex, BooleanType(), ring)


def drop_collinear(ring: Column, tol: float = 0.1) -> Column:
    """Drop vertices lying within ``tol`` of the line from the last kept vertex to the next one.

    A finely drawn curve keeps a vertex wherever it has left the line by more than ``tol``; a ring of which fewer than
    three vertices would stay is kept as it is.
    """

    def offset(prev: Column, here: Column, nxt: Column) -> Column:
        return F.try_divide(F.abs(cross(prev, nxt, here)), F.hypot(nxt.x - prev.x, nxt.y - prev.y))

    def shrink(r: Column) -> Column:
        steps = F.zip_with(r, shift_left(r), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        before = F.try_element_at(r, F.lit(-1))

        def step(kept: Column, s: Column) -> Column:
            last = F.coalesce(F.try_element_at(kept, F.lit(-1)), before)
            stays = F.coalesce(offset(last, s.p, s.q) > tol, F.lit(True))
            return F.when(stays, F.concat(kept, F.array(s.p))).otherwise(kept)

        fewer = F.aggregate(steps, F.slice(r, 1, 0), step)
        return let(fewer, lambda k: F.when(F.size(k) >= 3, k).otherwise(r))

    return let(ring, shrink)


# ---------------------------------------------------------------- affine maps


def translate(ring: Column, dx: Num, dy: Num) -> Column:
    return F.transform(ring, lambda p: pt(p.x + num(dx), p.y + num(dy)))


def rotate_cs(ring: Column, cos: Num, sin: Num, origin: Column) -> Column:
    c, s = num(cos), num(sin)
    return F.transform(
        ring,
        lambda p: pt(
            origin.x + (p.x - origin.x) * c - (p.y - origin.y) * s,
            origin.y + (p.x - origin.x) * s + (p.y - origin.y) * c,
        ),
    )


def rotate(ring: Column, degrees: Num, origin: Column) -> Column:
    a = F.radians(num(degrees))
    return rotate_cs(ring, F.cos(a), F.sin(a), origin)


def scale(ring: Column, factor: Num, origin: Column) -> Column:
    k = num(factor)
    return F.transform(
        ring, lambda p: pt(origin.x + (p.x - origin.x) * k, origin.y + (p.y - origin.y) * k)
    )


def snap_to_grid(ring: Column, size: Num) -> Column:
    """Half-even rounding, as Python's ``round`` does."""
    g = num(size)
    return F.transform(ring, lambda p: pt(F.rint(p.x / g) * g, F.rint(p.y / g) * g))


# ---------------------------------------------------------------- hull and oriented box


def convex_hull(ring: Column) -> Column:
    """Monotone chain.  The turn test against a convex chain is monotone, so popping is a prefix count."""

    def push(chain: Column, p: Column) -> Column:
        good = F.size(
            F.filter(segments(chain), lambda e: cross(e.p, e.q, p) > EPS)
        )
        return F.concat(F.slice(chain, 1, F.least(good + 1, F.size(chain))), F.array(p))

    def half(points: Column) -> Column:
        chain = F.aggregate(points, empty_ring(), push)
        return let(chain, lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))

    ordered = F.array_sort(F.array_distinct(ring))
    return let(ordered, lambda ps: F.concat(half(ps), half(F.reverse(ps))))


def obb(ring: Column) -> Column:
    """Minimum-area oriented box: width <= length, angle of the longer side in [0, 180).

    Equal areas are broken by the smallest angle, so the answer is unique.
    """
    return _batched(kernels.obb, _BOX, ring)


def shape_quality(
    area_m2: Column, width: Column, length: Column, min_rect: float = 0.75, max_aspect: float = 4.0,
    min_area: float = 1000.0,
) -> Column:
    box = width * length
    rect = F.coalesce(F.try_divide(area_m2, box), F.lit(0.0))
    aspect = F.coalesce(F.try_divide(length, width), F.lit(float("inf")))
    return F.struct(
        rect.alias("rectangularity"),
        aspect.alias("aspect"),
        (rect * 0.7 + F.lit(0.3) / aspect).alias("score"),
        ((rect >= min_rect - EPS) & (aspect <= max_aspect + EPS) & (area_m2 >= min_area)).alias("is_valid"),
    )


def classify_lot(area_m2: Column, is_valid: Column, min_area: float = 1000.0) -> Column:
    return (
        F.when(area_m2 < min_area, "unusable").when(is_valid, "commercial").otherwise("green_space")
    )


# ---------------------------------------------------------------- clipping


def half_plane(a: Num, b: Num, c: Num) -> Column:
    """Points with a*x + b*y <= c."""
    return F.struct(num(a).alias("a"), num(b).alias("b"), num(c).alias("c"))


def planes_of(ring: Column, inset: Num = 0.0) -> Column:
    """Half-planes of a convex counter-clockwise ring, moved inwards by ``inset``."""
    d = num(inset)

    def plane(e: Column) -> Column:
        n = seg_len(e)
        a, b = (e.q.y - e.p.y) / n, (e.p.x - e.q.x) / n
        return half_plane(a, b, a * e.p.x + b * e.p.y - d)

    return F.transform(F.filter(edges(ring), lambda e: seg_len(e) > EPS), plane)


def rect_planes(minx: Num, miny: Num, maxx: Num, maxy: Num) -> Column:
    minx, miny, maxx, maxy = num(minx), num(miny), num(maxx), num(maxy)
    return F.array(
        half_plane(1, 0, maxx), half_plane(-1, 0, -minx), half_plane(0, 1, maxy), half_plane(0, -1, -miny)
    )


def clip_convex(ring: Column, planes: Column) -> Column:
    """Ring cut by a set of half-planes, one after the other."""
    return _batched(kernels.clip_convex, _POINTS, ring, planes)


def clip_to_ring(ring: Column, window: Column) -> Column:
    return clip_convex(ring, planes_of(window))


def slices(ring: Column, ux: Column, uy: Column, widths: Column) -> Column:
    """``array<struct<ring,sqm>>``: a convex ring cut across a direction, one lot for each width."""
    return _batched(kernels.slices, _LOTS, ring, ux, uy, widths)


def dissolve(polys: Column) -> Column:
    """``array<struct<ring,holes,area_sqm>>``: an ``array<struct<poly,ring>>`` merged, parts in the order of their numbers."""
    return _batched(overlay_kernels.dissolve, _PARTS, polys)


def inset(ring: Column, distance: Num) -> Column:
    """Setback polygon of a convex ring: its half-planes moved inwards.  Null for a concave ring."""
    return _batched(kernels.inset, _POINTS, ring, num(distance).cast("double"))


def intersection_area(a: Column, b: Column) -> Column:
    """Overlap of two simple rings: ``b`` as a signed triangle fan, ``a`` cut by each triangle."""
    return _batched(kernels.intersection_area, DoubleType(), a, b)


# ---------------------------------------------------------------- distance and containment


def point_segment_distance(p: Column, e: Column) -> Column:
    dx, dy = e.q.x - e.p.x, e.q.y - e.p.y
    n2 = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((p.x - e.p.x) * dx + (p.y - e.p.y) * dy, n2), F.lit(0.0))
    return let(
        F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)),
        lambda k: F.hypot(p.x - (e.p.x + k * dx), p.y - (e.p.y + k * dy)),
    )


def _vertices_to_edges(points: Column, segs: Column) -> Column:
    return F.array_min(
        F.transform(points, lambda p: F.array_min(F.transform(segs, lambda e: point_segment_distance(p, e))))
    )


def point_in_ring(ring: Column, p: Column, boundary: bool = True) -> Column:
    def test(es: Column) -> Column:
        crossings = F.size(
            F.filter(
                es,
                lambda e: ((e.p.y > p.y) != (e.q.y > p.y))
                & ((cross(e.p, e.q, p) > 0) == (e.q.y > e.p.y)),
            )
        )
        inside = F.pmod(crossings, F.lit(2)) == 1
        on_edge = F.exists(es, lambda e: point_segment_distance(p, e) <= EPS)
        return (on_edge | inside) if boundary else (inside & ~on_edge)

    return let(edges(ring), test)


def _any_cross(a: Column, b: Column) -> Column:
    return F.exists(a, lambda e: F.exists(b, lambda f: _proper_cross(e, f)))


def contains_point(ring: Column, x: Column, y: Column, boundary: bool = True) -> Column:
    """``point_in_ring`` for whole columns."""
    return _batched(kernels.point_in_ring if boundary else kernels.point_within_ring, BooleanType(), ring, x, y)


def ring_contains(ring: Column, other: Column) -> Column:
    """Every vertex of ``other`` inside or on ``ring`` and no side leaving it.

    Side midpoints are tested too, which catches a side spanning a notch between two boundary points.
    """
    return _batched(kernels.ring_contains, BooleanType(), ring, other)


def ring_distance(a: Column, b: Column) -> Column:
    return _batched(kernels.ring_distance, DoubleType(), a, b)


def ring_path_distance(ring: Column, path: Column) -> Column:
    return _batched(kernels.ring_path_distance, DoubleType(), ring, path)


def boundary_distance(ring: Column, other: Column) -> Column:
    """Distance of ``other`` to the outline of ``ring`` (0 when it crosses the outline)."""
    gap = F.least(_vertices_to_edges(ring, edges(other)), _vertices_to_edges(other, edges(ring)))
    return F.when(_any_cross(edges(ring), edges(other)), 0.0).otherwise(gap)


def rect_clear_of_outline(ring: Column, x: Column, y: Column, w: Column, h: Column, d: float = 0.0) -> Column:
    """Rectangle inside any simple ring with clearance ``d``: its centre is inside and no side of the ring
    enters it or comes closer than ``d``."""
    x2, y2 = x + w, y + h
    corners = ((x, y), (x2, y), (x2, y2), (x, y2))

    def clear(e: Column) -> Column:
        turns = [(e.q.x - e.p.x) * (cy - e.p.y) - (e.q.y - e.p.y) * (cx - e.p.x) for cx, cy in corners]
        enters = (
            (F.least(e.p.x, e.q.x) < x2 - EPS) & (F.greatest(e.p.x, e.q.x) > x + EPS)
            & (F.least(e.p.y, e.q.y) < y2 - EPS) & (F.greatest(e.p.y, e.q.y) > y + EPS)
            & (F.least(*turns) < -EPS) & (F.greatest(*turns) > EPS)
        )
        if d <= 0:
            return ~enters
        zero = F.lit(0.0)
        vertex = F.hypot(F.greatest(zero, x - e.p.x, e.p.x - x2), F.greatest(zero, y - e.p.y, e.p.y - y2))
        near = F.least(vertex, *[point_segment_distance(pt(cx, cy), e) for cx, cy in corners])
        return ~enters & (near >= d - EPS)

    return point_in_ring(ring, pt(x + w / 2, y + h / 2)) & F.forall(edges(ring), clear)


def area_in_rect(ring: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Area of any simple ring inside a rectangle, six decimals.

    Nothing is clipped: every side adds the area under it, with its height held between the rectangle's sides, over the
    columns it shares with the rectangle; sides that run back take it away again.
    """
    def held(v: Column, lo: Column, hi: Column) -> Column:
        return F.least(F.greatest(v, lo), hi)

    zero = F.lit(0.0)

    def under(e: Column) -> Column:
        xa, xb = held(e.p.x, x, x + w), held(e.q.x, x, x + w)
        slope = (e.q.y - e.p.y) / (e.q.x - e.p.x)
        ya, yb = (e.p.y - y + (v - e.p.x) * slope for v in (xa, xb))
        ca, cb = held(ya, zero, h), held(yb, zero, h)
        # integral of the held height; its mean over the side is a difference quotient where the side leaves the range
        ga, gb = (c * c / 2 + h * F.greatest(v - h, zero) for c, v in ((ca, ya), (cb, yb)))
        straight = ((ya <= 0) & (yb <= 0)) | ((ya >= h) & (yb >= h)) | ((ca == ya) & (cb == yb)) | (F.abs(yb - ya) < 1e-6)
        mean = F.when(straight, (ca + cb) / 2).otherwise((gb - ga) / (yb - ya))
        return F.when(xa == xb, 0.0).otherwise((xb - xa) * mean)

    return F.round(F.abs(_sum(edges(ring), under)), 6)


# ---------------------------------------------------------------- lines


def clip_segment(a: Column, b: Column, ring: Column) -> Column:
    """Parts of the segment a-b inside the ring, as an array of two-point paths."""

    def crossing(e: Column) -> Column:
        rx, ry, sx, sy = b.x - a.x, b.y - a.y, e.q.x - e.p.x, e.q.y - e.p.y
        den = rx * sy - ry * sx
        t = F.try_divide((e.p.x - a.x) * sy - (e.p.y - a.y) * sx, den)
        u = F.try_divide((e.p.x - a.x) * ry - (e.p.y - a.y) * rx, den)
        # relative test: a side nearly parallel to the line is no crossing
        skew = F.abs(den) > EPS * F.hypot(rx, ry) * F.hypot(sx, sy)
        ok = skew & (t > 0) & (t < 1) & (u >= -EPS) & (u <= 1 + EPS)
        return F.when(ok, F.round(t, 12))

    cuts = F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.lit(0.0), F.lit(1.0)),
                F.filter(F.transform(edges(ring), crossing), lambda t: t.isNotNull()),
            )
        )
    )

    def at(t: Column) -> Column:
        return pt(a.x + t * (b.x - a.x), a.y + t * (b.y - a.y))

    def spans(ts: Column) -> Column:
        pairs = F.zip_with(
            F.slice(ts, 1, F.size(ts) - 1),
            F.slice(ts, 2, F.size(ts) - 1),
            lambda s, t: F.struct(s.alias("s"), t.alias("t")),
        )
        inside = F.filter(pairs, lambda k: point_in_ring(ring, at((k.s + k.t) / 2)))
        return F.transform(inside, lambda k: F.array(at(k.s), at(k.t)))

    return let(cuts, spans)


def longest_part(parts: Column) -> Column:
    ranked = F.transform(
        parts, lambda p, i: F.struct(path_length(p).alias("len"), (-i).alias("ord"), p.alias("path"))
    )
    return F.array_max(ranked).path


def interpolate(path: Column, distance: Num) -> Column:
    """Point at ``distance`` along the path, clamped to its ends."""
    d = F.least(F.greatest(num(distance), F.lit(0.0)), path_length(path))
    start = F.struct(
        d.alias("rest"), path[0].x.alias("x"), path[0].y.alias("y"), F.lit(False).alias("done")
    )

    def step(acc: Column, e: Column) -> Column:
        n = seg_len(e)
        t = F.coalesce(F.try_divide(F.least(acc.rest, n), n), F.lit(0.0))
        moved = F.struct(
            F.greatest(acc.rest - n, F.lit(0.0)).alias("rest"),
            (e.p.x + t * (e.q.x - e.p.x)).alias("x"),
            (e.p.y + t * (e.q.y - e.p.y)).alias("y"),
            (acc.rest <= n).alias("done"),
        )
        return F.when(acc.done, acc).otherwise(moved)

    return F.aggregate(segments(path), start, step, lambda acc: pt(acc.x, acc.y))


def closed(ring: Column) -> Column:
    """Outline of a ring as a path that returns to its first vertex."""
    return F.concat(ring, F.slice(ring, 1, 1))


def nearest_point(path: Column, p: Column) -> Column:
    """Closest point ``dist, seg, x, y`` of a path; the earliest segment wins a tie."""
    return _batched(kernels.nearest_point, _NEAREST, path, p.x, p.y)


def strip_of_segment(e: Column, width: Num) -> Column:
    """Flat-capped strip around one segment, counter-clockwise."""
    h = num(width) / 2
    n = seg_len(e)
    nx, ny = F.try_divide(e.p.y - e.q.y, n) * h, F.try_divide(e.q.x - e.p.x, n) * h
    return F.array(
        pt(e.p.x - nx, e.p.y - ny),
        pt(e.q.x - nx, e.q.y - ny),
        pt(e.q.x + nx, e.q.y + ny),
        pt(e.p.x + nx, e.p.y + ny),
    )


def road_strips(path: Column, width: Num) -> Column:
    return F.transform(F.filter(segments(path), lambda e: seg_len(e) > EPS), lambda e: strip_of_segment(e, width))


def _bend(path: Column, corner: Callable[[Column, Column, Column], Column], min_angle: float) -> Column:
    """Replace the interior vertices of a path that turn by more than ``min_angle``."""

    def at(i: Column) -> Column:
        p, v, q = path[i - 1], path[i], path[i + 1]
        l1, l2 = F.hypot(p.x - v.x, p.y - v.y), F.hypot(q.x - v.x, q.y - v.y)
        dot = F.try_divide((p.x - v.x) * (q.x - v.x) + (p.y - v.y) * (q.y - v.y), l1 * l2)
        opening = F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
        return F.when(opening < 180.0 - min_angle, corner(p, v, q)).otherwise(F.array(v))

    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(path) - 2, F.lit(1))), at))
    bent = F.concat(F.slice(path, 1, 1), inner, F.slice(path, F.size(path), 1))
    return F.when(F.size(path) < 3, path).otherwise(bent)


def _toward(v: Column, to: Column, r: Column) -> Column:
    n = F.hypot(to.x - v.x, to.y - v.y)
    return pt(v.x + F.try_divide(to.x - v.x, n) * r, v.y + F.try_divide(to.y - v.y, n) * r)


def fillet(path: Column, radius: float = 10.0, min_angle: float = 30.0, points: int = 8) -> Column:
    def corner(p: Column, v: Column, q: Column) -> Column:
        shorter = F.least(F.hypot(p.x - v.x, p.y - v.y), F.hypot(q.x - v.x, q.y - v.y))
        r = F.least(F.lit(float(radius)), shorter * 0.4)

        def blend(ends: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(points - 1)),
                lambda k: let(
                    k / float(points - 1),
                    lambda t: pt(
                        ends.s.x + t * (ends.e.x - ends.s.x), ends.s.y + t * (ends.e.y - ends.s.y)
                    ),
                ),
            )

        arc = let(F.struct(_toward(v, p, r).alias("s"), _toward(v, q, r).alias("e")), blend)
        return F.when(r < 1.0, F.array(v)).otherwise(arc)

    return drop_close(_bend(path, corner, min_angle))


def chamfer(path: Column, length: float = 5.0, min_angle: float = 45.0) -> Column:
    def corner(p: Column, v: Column, q: Column) -> Column:
        r = F.least(
            F.lit(float(length)),
            F.hypot(p.x - v.x, p.y - v.y) * 0.4,
            F.hypot(q.x - v.x, q.y - v.y) * 0.4,
        )
        return F.array(_toward(v, p, r), _toward(v, q, r))

    return _bend(path, corner, min_angle)


def drop_close(path: Column, tol: float = 0.1) -> Column:
    """Drop path vertices closer than ``tol`` to the last kept one."""

    def keep(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = F.hypot(p.x - last.x, p.y - last.y) >= tol
        return F.when((F.size(acc) == 0) | far, F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(path, empty_ring(), keep)


# ---------------------------------------------------------------- rectangles (scalar, inside codegen)


def rect_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    dx = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    dy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def rect_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    dx = F.greatest(F.lit(0.0), a["x"] - b["x"] - b["w"], b["x"] - a["x"] - a["w"])
    dy = F.greatest(F.lit(0.0), a["y"] - b["y"] - b["h"], b["y"] - a["y"] - a["h"])
    return F.sqrt(dx * dx + dy * dy)


def rect_of(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x", "y", "w", "h")}


def wkt(ring: Column, digits: int = 4) -> Column:
    """Text form with fixed decimals, one blank between points; handy for comparing and exporting."""
    fmt = f"%.{digits}f %.{digits}f"
    return F.array_join(
        F.transform(ring, lambda p: F.format_string(fmt, F.round(p.x, digits) + 0.0, F.round(p.y, digits) + 0.0)), ","
    )


def dxf_polyline(layer: Column, ring: Column) -> Column:
    """Closed LWPOLYLINE as group-code lines."""
    return _batched(text_kernels.polyline_text, StringType(), layer, ring)


def dxf_entities(text: Column) -> Column:
    """LWPOLYLINE, POLYLINE and LINE entities of a drawing, with their layer, their flag and their points."""
    return _batched(text_kernels.entities, _ENTITIES, text)
