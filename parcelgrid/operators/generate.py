"""Row-expanding generators: grids, road networks, blocks, lots and candidate layouts.

One input row holds everything its output needs, so a generator is a projection and an ``explode``: no shuffle,
and a site with a hundred times the cells only makes its own task longer by the cells it emits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import near_pairs, spread
from parcelgrid.operators.pairs import rect_in_site


def _span(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _steps(first: Column, last: Column, step: g.Num) -> Column:
    """first, first+step, .. strictly below last."""
    n = F.ceil((last - first) / g.num(step)).cast("int")
    return F.transform(_span(n), lambda k: first + k * g.num(step))


# ---------------------------------------------------------------- site grids


def grid_candidates(sites: DataFrame, spacing: g.Num, cos: g.Num = 1.0, sin: g.Num = 0.0) -> DataFrame:
    """Square cells of side ``spacing``, turned about the centroid, with their usable area on the site.

    Works in the turned frame, where cells are axis-parallel; only indices inside the turned bounding box are
    expanded.  Cells wholly inside a convex site skip the clipping.
    """
    s, c, n = g.num(spacing), g.num(cos), g.num(sin)
    ring = F.col("ring")
    base = g.materialize(spread(sites, "site_id"), _o=g.centroid(ring), _m=g.bounds(ring), _s=s, _cos=c, _sin=n)
    diameter = F.hypot(F.col("_m.maxx") - F.col("_m.minx"), F.col("_m.maxy") - F.col("_m.miny"))
    base = g.materialize(
        base,
        _x0=F.col("_m.minx") - diameter,
        _y0=F.col("_m.miny") - diameter,
        _ring=g.rotate_cs(ring, F.col("_cos"), -F.col("_sin"), F.col("_o")),
    )
    turned = F.col("_ring")
    base = g.materialize(base, _t=g.bounds(turned), convex=g.is_convex(turned), planes=g.planes_of(turned))
    s = F.col("_s")

    def indices(lo: str, hi: str, origin: str) -> Column:
        return F.sequence(
            F.floor((F.col(lo) - F.col(origin)) / s - 0.5).cast("int"),
            F.ceil((F.col(hi) - F.col(origin)) / s + 0.5).cast("int"),
        )

    cells = base.withColumn("i", F.explode(indices("_t.minx", "_t.maxx", "_x0"))).withColumn(
        "j", F.explode(indices("_t.miny", "_t.maxy", "_y0"))
    )
    cells = (
        cells.withColumn("x", F.col("_x0") + F.col("i") * s - s / 2)
        .withColumn("y", F.col("_y0") + F.col("j") * s - s / 2)
        .withColumn("w", s)
        .withColumn("h", s)
    )
    inside = F.col("convex") & rect_in_site("_ring", 0.0, prepared=True)
    usable = F.when(inside, s * s).otherwise(
        g.area_in_rect(F.col("_ring"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    )
    cells = g.materialize(cells, usable_sqm=usable).filter(F.col("usable_sqm") > 0)
    dx, dy = F.col("x") + s / 2 - F.col("_o.x"), F.col("y") + s / 2 - F.col("_o.y")
    return cells.select(
        *[k for k in sites.columns if k not in ("ring", "convex", "planes")],
        "i",
        "j",
        (F.col("_o.x") + dx * F.col("_cos") - dy * F.col("_sin")).alias("cx"),
        (F.col("_o.y") + dx * F.col("_sin") + dy * F.col("_cos")).alias("cy"),
        "usable_sqm",
        (F.col("usable_sqm") / (s * s)).alias("ratio"),
    )


def tile_grid(sites: DataFrame) -> DataFrame:
    """Tiles of side clip(sqrt(area/200), 5, 50); tiles off the site are marked empty."""
    ring = F.col("ring")
    side = F.least(F.greatest(F.sqrt(g.area(ring) / 200.0), F.lit(5.0)), F.lit(50.0))
    b = g.materialize(spread(sites, "site_id"), _m=g.bounds(ring), tile_m=side)

    def count(lo: str, hi: str) -> Column:
        return F.greatest(F.lit(1), F.floor((F.col(hi) - F.col(lo)) / F.col("tile_m")).cast("int"))

    t = b.withColumn("row", F.explode(_span(count("_m.miny", "_m.maxy")))).withColumn(
        "col", F.explode(_span(count("_m.minx", "_m.maxx")))
    )
    t = (
        t.withColumn("x", F.col("_m.minx") + F.col("col") * F.col("tile_m"))
        .withColumn("y", F.col("_m.miny") + F.col("row") * F.col("tile_m"))
        .withColumn("w", F.col("tile_m"))
        .withColumn("h", F.col("tile_m"))
    )
    centre = g.contains_point(ring, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    touch = centre | (g.ring_distance(ring, g.rect_ring(*(F.col(k) for k in "xywh"))) <= g.EPS)
    return t.select("site_id", "row", "col", "x", "y", "tile_m", (~touch).alias("is_empty"))


# ---------------------------------------------------------------- road networks


def _network(sites: DataFrame, setback: float) -> DataFrame:
    ring = F.col("ring")
    return g.materialize(sites, _m=g.bounds(ring), _in=g.inset(ring, setback))


def _clip_axis(horizontal: bool, at: Column, lo: Column, hi: Column, window: Column) -> Column:
    a, b = (g.pt(lo, at), g.pt(hi, at)) if horizontal else (g.pt(at, lo), g.pt(at, hi))
    return g.longest_part(g.clip_segment(a, b, window))


def _axis_lines(horizontal: bool, cls: str, ats: Column, lo: Column, hi: Column) -> Column:
    return F.filter(
        F.transform(
            ats,
            lambda v: F.struct(
                F.lit(cls).alias("road_class"), F.lit("h" if horizontal else "v").alias("axis"), v.alias("at"),
                _clip_axis(horizontal, v, lo, hi, F.col("_in")).alias("path"),
            ),
        ),
        lambda r: r.path.isNotNull(),
    )


def _with_lengths(net: DataFrame, extra: list[str]) -> DataFrame:
    width = F.when(F.col("r.road_class") == "primary", 24.0).otherwise(16.0)
    return net.select(
        "site_id", *extra, F.col("r.road_class").alias("road_class"), F.col("r.axis").alias("axis"),
        F.col("r.at").alias("at"), F.col("r.path").alias("path"), g.path_length(F.col("r.path")).alias("length_m"),
        width.alias("width_m"),
    )


def grid_network(
    sites: DataFrame, primary: g.Num = 200.0, secondary: g.Num = 100.0, setback: float = 50.0,
    extra: list[str] | None = None,
) -> DataFrame:
    """Primary and secondary grid roads inside the setback of convex sites.

    A secondary line is skipped when it is nearer than half its spacing to the mean coordinate of *any* primary
    line, whichever way that one runs.
    """
    p, s = g.num(primary), g.num(secondary)
    net = _network(sites, setback)
    x0, x1 = F.col("_m.minx") + setback, F.col("_m.maxx") - setback
    y0, y1 = F.col("_m.miny") + setback, F.col("_m.maxy") - setback
    net = g.materialize(
        net,
        _p=F.concat(
            _axis_lines(True, "primary", _steps(y0 + p / 2, y1, p), x0, x1),
            _axis_lines(False, "primary", _steps(x0 + p / 2, x1, p), y0, y1),
        ),
    )

    def free(ats: Column, coord: str) -> Column:
        means = F.transform(
            F.col("_p"), lambda r: (r.path[0].getField(coord) + r.path[1].getField(coord)) / 2
        )
        return g.let(means, lambda ms: F.filter(ats, lambda v: ~F.exists(ms, lambda m: F.abs(v - m) < s / 2)))

    net = g.materialize(
        net,
        _q=F.concat(
            _axis_lines(True, "secondary", free(_steps(y0 + s, y1, s), "y"), x0, x1),
            _axis_lines(False, "secondary", free(_steps(x0 + s, x1, s), "x"), y0, y1),
        ),
    )
    keep = extra or []
    return _with_lengths(net.select("site_id", *keep, F.explode(F.concat("_p", "_q")).alias("r")), keep)


def spine_network(sites: DataFrame, max_distance: float = 200.0, setback: float = 50.0) -> DataFrame:
    """Spine on the long axis of the bounding box and branches every 1.5 times the access distance."""
    net = _network(sites, setback)
    x0, x1 = F.col("_m.minx") + setback, F.col("_m.maxx") - setback
    y0, y1 = F.col("_m.miny") + setback, F.col("_m.maxy") - setback
    cx, cy = (F.col("_m.minx") + F.col("_m.maxx")) / 2, (F.col("_m.miny") + F.col("_m.maxy")) / 2
    step = 1.5 * max_distance
    wide = F.concat(
        _axis_lines(True, "primary", F.array(cy), x0, x1),
        _axis_lines(False, "secondary", _steps(x0 + step / 2, x1, step), y0, y1),
    )
    tall = F.concat(
        _axis_lines(False, "primary", F.array(cx), y0, y1),
        _axis_lines(True, "secondary", _steps(y0 + step / 2, y1, step), x0, x1),
    )
    is_wide = (F.col("_m.maxx") - F.col("_m.minx")) >= (F.col("_m.maxy") - F.col("_m.miny"))
    return _with_lengths(net.select("site_id", F.explode(F.when(is_wide, wide).otherwise(tall)).alias("r")), [])


def branches_along(
    sites: DataFrame, num_branches: int = 5, spacing: float = 100.0, min_length: float = 20.0
) -> DataFrame:
    """Middle line of the bounding box, perpendicular branches at equal shares of it, short stubs pruned."""
    ring = F.col("ring")
    s = g.materialize(sites, _m=g.bounds(ring))
    wide = (F.col("_m.maxx") - F.col("_m.minx")) >= (F.col("_m.maxy") - F.col("_m.miny"))
    cx, cy = (F.col("_m.minx") + F.col("_m.maxx")) / 2, (F.col("_m.miny") + F.col("_m.maxy")) / 2
    a = F.when(wide, g.pt(F.col("_m.minx"), cy)).otherwise(g.pt(cx, F.col("_m.miny")))
    z = F.when(wide, g.pt(F.col("_m.maxx"), cy)).otherwise(g.pt(cx, F.col("_m.maxy")))
    s = g.materialize(s, _a=a, _z=z)
    s = g.materialize(s, _main=g.longest_part(g.clip_segment(F.col("_a"), F.col("_z"), ring)))
    s = g.materialize(s.filter(F.col("_main").isNotNull()), _len=g.path_length(F.col("_main")))
    n = F.least(F.lit(num_branches), F.floor(F.col("_len") / spacing).cast("int"))
    diagonal = F.hypot(F.col("_m.maxx") - F.col("_m.minx"), F.col("_m.maxy") - F.col("_m.miny"))
    first, last = F.col("_main")[0], F.col("_main")[1]
    s = g.materialize(
        s, _n=n, _d=diagonal, _dx=(last.x - first.x) / F.col("_len"), _dy=(last.y - first.y) / F.col("_len")
    )
    dx, dy = F.col("_dx"), F.col("_dy")

    def branch(k: Column) -> Column:
        at = g.interpolate(F.col("_main"), F.col("_len") * (k + 1) / (F.col("_n") + 1))
        far = g.let(
            at,
            lambda p: F.struct(
                g.pt(p.x + dy * F.col("_d"), p.y - dx * F.col("_d")).alias("s"),
                g.pt(p.x - dy * F.col("_d"), p.y + dx * F.col("_d")).alias("e"),
            ),
        )
        return g.let(far, lambda f: g.clip_segment(f.s, f.e, ring))

    paths = F.concat(
        F.array(F.col("_main")),
        F.filter(F.flatten(F.transform(_span(F.col("_n")), branch)), lambda p: g.path_length(p) >= min_length),
    )
    kept = g.materialize(s, _p=paths)
    kept = g.materialize(kept, _top=F.array_max(F.transform(F.col("_p"), g.path_length)))
    kept = g.materialize(kept, _p=F.filter(F.col("_p"), lambda p: g.path_length(p) >= F.col("_top") * 0.1))
    return kept.select("site_id", F.posexplode("_p").alias("road_no", "path")).withColumn(
        "length_m", g.path_length(F.col("path"))
    )


def classify_road(centre_distance: Column, length: Column) -> Column:
    return F.when((centre_distance < 100) | (length > 400), "main").otherwise("internal")


def boundary_candidates(sites: DataFrame, n: int = 20) -> DataFrame:
    outline = g.closed(F.col("ring"))
    s = g.materialize(sites, _o=outline, _len=g.perimeter(F.col("ring")))
    s = s.withColumn("point_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    s = s.withColumn("_p", g.interpolate(F.col("_o"), F.col("_len") * F.col("point_no") / n))
    return s.select("site_id", "point_no", F.col("_p.x").alias("px"), F.col("_p.y").alias("py"))


# ---------------------------------------------------------------- lots


def lot_widths(length: Column, lo: float, hi: float, target: float) -> Column:
    """Equal widths of the fewest lots that meet the target; the rule n = least(ceil(L/t), int(L/min))."""
    t = target if lo <= target <= hi else (lo + hi) / 2.0
    n = F.least(F.ceil(length / t - g.EPS), F.floor(length / lo + g.EPS))  # measured lengths carry noise
    fits = (n >= 1) & (length / F.greatest(n, F.lit(1)) <= hi) & (length / F.greatest(n, F.lit(1)) >= lo)
    count = F.when(fits, n).otherwise(F.greatest(F.lit(1), F.floor(length / t))).cast("int")
    return F.when(length < lo, F.array().cast("array<double>")).otherwise(F.array_repeat(length / count, count))


def uniform_widths(length: Column, lo: float, hi: float, target: float) -> Column:
    n = F.greatest(F.rint(length / target), F.lit(1.0))
    n = F.when(length / n < lo, F.floor(length / lo)).when(length / n > hi, F.floor(length / hi) + 1).otherwise(n)
    count = F.greatest(n.cast("int"), F.lit(1))
    return F.when(length < lo, F.array().cast("array<double>")).otherwise(F.array_repeat(length / count, count))


def orthogonal_slice(blocks: DataFrame, widths: str = "widths") -> DataFrame:
    """Cut a block across its dominant edge; widths are rescaled to fill the extent.

    Cutting by two half-planes needs no turning back and forth.
    """
    b = g.materialize(blocks.filter(F.size(widths) > 0), _b=g.obb(F.col("ring")))
    b = g.materialize(b, _lots=g.slices(F.col("ring"), F.col("_b.ux"), F.col("_b.uy"), F.col(widths)))
    lots = b.select(*blocks.columns, F.posexplode("_lots").alias("lot_no", "_lot"))
    return lots.select(*blocks.columns, "lot_no", F.col("_lot.ring").alias("lot_ring"), F.col("_lot.sqm").alias("lot_sqm")).filter(
        F.col("lot_sqm") > g.EPS
    )


def obb_grid_lots(blocks: DataFrame, lot_w: g.Num, lot_d: g.Num, min_area: g.Num) -> DataFrame:
    """Cells of the oriented box, clipped to the block; rectangular blocks need no clipping."""
    b = g.materialize(blocks, _b=g.obb(F.col("ring")))
    cols = F.greatest(F.lit(1), F.floor(F.col("_b.width") / g.num(lot_w) + g.EPS).cast("int"))
    rows = F.greatest(F.lit(1), F.floor(F.col("_b.length") / g.num(lot_d) + g.EPS).cast("int"))
    b = g.materialize(b, _c=cols, _r=rows, _rect=g.area(F.col("ring")) >= F.col("_b.box_area") - 1e-6)
    b = b.withColumn("row", F.explode(_span(F.col("_r")))).withColumn("col", F.explode(_span(F.col("_c"))))
    w, h = F.col("_b.width") / F.col("_c"), F.col("_b.length") / F.col("_r")
    ux, uy = F.col("_b.ux"), F.col("_b.uy")

    def corner(di: int, dj: int) -> Column:
        t = (F.col("row") + di) * h - F.col("_b.length") / 2
        s = (F.col("col") + dj) * w - F.col("_b.width") / 2
        return g.pt(F.col("_b.cx") + t * ux - s * uy, F.col("_b.cy") + t * uy + s * ux)

    b = g.materialize(b, _cell=F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))
    # cells of a rectangle are lots as they are; only the others go through the clipping
    whole = b.filter("_rect").select(*blocks.columns, "row", "col", F.col("_cell").alias("lot_ring"), (w * h).alias("lot_sqm"))
    cut = b.filter("NOT _rect").select(
        *blocks.columns, "row", "col", g.clip_convex(F.col("ring"), g.planes_of(F.col("_cell"))).alias("lot_ring")
    )
    lots = whole.unionByName(g.materialize(cut, lot_sqm=g.area(F.col("lot_ring"))))
    return lots.filter((F.col("lot_sqm") > g.EPS) & (F.col("lot_sqm") >= g.num(min_area)))


def subdivide_blocks(
    blocks: DataFrame, spacing: float, lo: float = 20.0, hi: float = 80.0, target: float = 40.0,
    setback: float = 6.0, min_rect: float = 0.65, max_aspect: float = 4.0, min_area: float = 250.0,
) -> DataFrame:
    """Fragments become parks, other blocks are sliced into lots that are kept, turned green, or dropped.

    A block is measured once and leaves as one list of its park or its lots, so blocks are neither read nor dealt twice.
    """
    ring = F.col("ring")
    b = g.materialize(blocks, _a=g.area_of_column(ring), _b=g.obb(ring)).filter("_a IS NOT NULL")
    b = g.materialize(b, _park=F.col("_a") / (spacing * spacing) < 0.6)
    b = g.materialize(b, _widths=F.when(~F.col("_park"), lot_widths(F.col("_b.length"), lo, hi, target)))
    b = g.materialize(b, _lots=g.slices(ring, F.col("_b.ux"), F.col("_b.uy"), F.col("_widths")))
    whole = F.array(F.struct(ring.alias("ring"), F.col("_a").alias("sqm")))
    lots = b.select(
        *blocks.columns, "_park", F.col("_b.length").alias("_len"), F.size("_widths").alias("_n"),
        F.posexplode(F.when(F.col("_park"), whole).otherwise(F.col("_lots"))).alias("lot_no", "_lot"),
    ).filter(F.col("_park") | (F.col("_lot.sqm") > g.EPS))
    sqm, park, cut = F.col("_lot.sqm"), F.col("_park"), F.when(~F.col("_park"), F.col("_lot.ring"))
    lots = g.materialize(lots, _box=g.obb(cut))
    lots = g.materialize(lots, _q=g.shape_quality(sqm, F.col("_box.width"), F.col("_box.length"), min_rect, max_aspect, min_area))
    cls = g.classify_lot(sqm, F.col("_q.is_valid"), min_area)
    kind = F.when(park, "park").when(cls == "commercial", "lot").when(cls == "green_space", "green").otherwise("dropped")

    def of_lot(value: Column) -> Column:
        return F.when(park, 0.0).otherwise(value)

    out = lots.select(
        *blocks.columns, "lot_no", kind.alias("kind"), sqm.alias("area_sqm"),
        of_lot(sqm / F.col("_len") * F.col("_n")).alias("width_m"),
        of_lot(g.area_of_column(g.inset(cut, setback))).alias("buildable_sqm"),
        of_lot(F.col("_q.rectangularity")).alias("rectangularity"),
    )
    return out.filter("kind <> 'dropped'")


def grid_plots(
    sites: DataFrame, roads: DataFrame, width: float, depth: float, min_area: float, setback: float, road_setback: float
) -> DataFrame:
    """Grid of plots over the setback polygon of convex sites, less axis-parallel through-roads.

    A road crossing a cell splits it, and split cells are dropped; a road along one side trims it.
    """
    s = g.materialize(sites, _in=g.inset(F.col("ring"), setback)).filter(F.size("_in") >= 3)
    s = g.materialize(s, _m=g.bounds(F.col("_in")), planes=g.planes_of(F.col("_in")))
    nx = F.floor((F.col("_m.maxx") - F.col("_m.minx")) / width + g.EPS).cast("int")
    ny = F.floor((F.col("_m.maxy") - F.col("_m.miny")) / depth + g.EPS).cast("int")
    c = s.withColumn("row", F.explode(_span(ny))).withColumn("col", F.explode(_span(nx)))
    c = c.select(
        "site_id", "row", "col", "_in", "planes",
        (F.col("_m.minx") + F.col("col") * width).alias("x"), (F.col("_m.miny") + F.col("row") * depth).alias("y"),
        F.lit(float(width)).alias("w"), F.lit(float(depth)).alias("h"),
    )
    grow = F.col("width_m") / 2 + road_setback
    vertical = F.col("x1") == F.col("x2")
    strips = roads.select(
        "site_id",
        (F.least("x1", "x2") - F.when(vertical, grow).otherwise(0.0)).alias("x"),
        (F.least("y1", "y2") - F.when(vertical, 0.0).otherwise(grow)).alias("y"),
        (F.abs(F.col("x2") - F.col("x1")) + F.when(vertical, grow * 2).otherwise(0.0)).alias("w"),
        (F.abs(F.col("y2") - F.col("y1")) + F.when(vertical, 0.0).otherwise(grow * 2)).alias("h"),
        vertical.alias("vertical"),
    )
    meet = g.rect_overlap(g.rect_of(), {k: F.col(f"{k}_b") for k in "xywh"}) > 0
    lean = c.select("site_id", "row", "col", "x", "y", "w", "h")
    hit = near_pairs(lean, strips, ["site_id"], 0.0, 100.0, meet)
    v = F.col("vertical_b")
    lo, hi = F.when(v, F.col("x_b")).otherwise(F.col("y_b")), F.when(v, F.col("x_b") + F.col("w_b")).otherwise(
        F.col("y_b") + F.col("h_b"))
    c0 = F.when(v, F.col("x")).otherwise(F.col("y"))
    c1 = F.when(v, F.col("x") + F.col("w")).otherwise(F.col("y") + F.col("h"))
    over_lo, over_hi = lo <= c0 + g.EPS, hi >= c1 - g.EPS
    trims = hit.groupBy("site_id", "row", "col").agg(
        F.bool_or(~over_lo & ~over_hi).alias("_split"),
        F.max(F.when(v & over_lo, hi)).alias("_x0"), F.min(F.when(v & over_hi, lo)).alias("_x1"),
        F.max(F.when(~v & over_lo, hi)).alias("_y0"), F.min(F.when(~v & over_hi, lo)).alias("_y1"),
    )
    j = c.join(trims, ["site_id", "row", "col"], "left").filter(~F.coalesce("_split", F.lit(False)))
    x0, y0 = F.coalesce("_x0", "x"), F.coalesce("_y0", "y")
    x1, y1 = F.coalesce("_x1", F.col("x") + F.col("w")), F.coalesce("_y1", F.col("y") + F.col("h"))
    j = j.select("site_id", "row", "col", "_in", "planes", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    j = j.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn("convex", F.lit(True))
    whole = rect_in_site("_in", 0.0, prepared=True)
    clipped = g.clip_convex(F.col("_in"), g.rect_planes(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    j = g.materialize(j, ring=F.when(whole, g.rect_ring(*(F.col(k) for k in "xywh"))).otherwise(clipped))
    j = g.materialize(
        j.filter(F.size("ring") >= 3), area_sqm=F.round(g.area(F.col("ring")), 6), _m=g.bounds(F.col("ring"))
    )
    return j.filter(F.col("area_sqm") >= min_area).select(
        "site_id", "row", "col", "ring", "area_sqm", (F.col("_m.maxx") - F.col("_m.minx")).alias("width_m"),
        (F.col("_m.maxy") - F.col("_m.miny")).alias("depth_m"),
    )


def partition_site(
    sites: DataFrame, target_area: float, road_w: float, setback: float, min_plots: int, max_plots: int
) -> DataFrame:
    """Plots of equal size in a grid over the setback polygon of convex sites, numbered row by row.

    Rows with ``status = 'error'`` say why a site got none.
    """
    s = g.materialize(sites, _in=g.inset(F.col("ring"), setback))
    s = g.materialize(s, _a=g.area(F.col("_in")), _m=g.bounds(F.col("_in")), planes=g.planes_of(F.col("_in")))
    n = F.greatest(
        F.lit(min_plots), F.least(F.floor(F.col("_a") / (target_area * 1.3)).cast("int"), F.lit(max_plots))
    )
    uw, uh = F.col("_m.maxx") - F.col("_m.minx") - road_w, F.col("_m.maxy") - F.col("_m.miny") - road_w
    s = g.materialize(s, _n=n, _uw=uw, _uh=uh)
    aspect = F.when(F.col("_uh") > 0, F.try_divide(F.col("_uw"), F.col("_uh"))).otherwise(1.0)
    first = F.floor(F.sqrt(F.col("_n") * F.greatest(aspect, F.lit(0.0)))).cast("int")
    s = g.materialize(s, _c0=F.greatest(F.lit(1), first))
    s = g.materialize(s, _rows=F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("_c0")).cast("int")))
    s = g.materialize(s, _cols=F.greatest(F.col("_c0"), F.ceil(F.col("_n") / F.col("_rows")).cast("int")))

    def size(extent: str, k: str, road: float) -> Column:
        return (F.col(extent) - (F.col(k) - 1) * road) / F.col(k)

    tight = (size("_uw", "_cols", road_w) < 15) | (size("_uh", "_rows", road_w) < 15)
    s = g.materialize(
        s,
        _road=F.when(tight, 6.0).otherwise(float(road_w)),
        _pw=F.when(tight, size("_uw", "_cols", 6.0)).otherwise(size("_uw", "_cols", road_w)),
        _ph=F.when(tight, size("_uh", "_rows", 6.0)).otherwise(size("_uh", "_rows", road_w)),
    )
    error = (
        F.when(F.col("_a") <= 0, "no buildable area").when(F.col("_n") < 1, "no plot fits")
        .when((F.col("_pw") < 15) | (F.col("_ph") < 15), "plots too small")
    )
    s = s.withColumn("_err", error)
    cells = F.transform(
        _span(F.col("_rows") * F.col("_cols")),
        lambda k: F.struct(
            (F.col("_m.minx") + F.pmod(k, F.col("_cols")) * (F.col("_pw") + F.col("_road"))).alias("x"),
            (F.col("_m.miny") + F.floor(k / F.col("_cols")) * (F.col("_ph") + F.col("_road"))).alias("y"),
        ),
    )
    zero = F.lit(0.0)

    def inside(c: Column) -> Column:
        return F.forall(
            F.col("planes"),
            lambda p: p.a * c.x + p.b * c.y + F.greatest(p.a, zero) * F.col("_pw") + F.greatest(p.b, zero) * F.col("_ph")
            <= p.c + g.EPS,
        )

    def mostly(c: Column) -> Column:
        return g.area_in_rect(F.col("_in"), c.x, c.y, F.col("_pw"), F.col("_ph")) > F.col("_pw") * F.col("_ph") * 0.9

    kept = F.slice(F.filter(cells, lambda c: inside(c) | mostly(c)), F.lit(1), F.greatest(F.col("_n"), F.lit(1)))
    s = g.materialize(s, _k=F.when(F.col("_err").isNull(), kept))
    s = s.withColumn("_err", F.when(F.col("_err").isNull() & (F.size("_k") == 0), "nothing placed").otherwise(F.col("_err")))
    s = s.select("site_id", "_err", "_pw", "_ph", "_road", F.posexplode_outer("_k").alias("_i", "_c"))
    return s.select(
        "site_id", F.when(F.col("_err").isNull(), "success").otherwise("error").alias("status"),
        F.col("_err").alias("message"), F.concat(F.lit("P"), (F.col("_i") + 1).cast("string")).alias("plot_id"),
        F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_pw").alias("w"), F.col("_ph").alias("h"),
        F.col("_road").alias("road_m"),
    )


# fixed values: plot width, plot height, gap, number of plots
PACKINGS: dict[str, tuple[float, float, float, int]] = {
    "balanced": (50.0, 70.0, 20.0, 8),
    "premium": (80.0, 100.0, 30.0, 4),
}


def _prepared(sites: DataFrame) -> DataFrame:
    r = F.col("ring")
    return g.materialize(sites, _m=g.bounds(r), convex=g.is_convex(r), planes=g.planes_of(r))


def pack_layout(sites: DataFrame, strategy: str, setback: float = 0.0) -> DataFrame:
    """Fixed plots in rows from the min corner, inside the outline, the first few only."""
    w, h, gap, k = PACKINGS[strategy]
    s = _prepared(sites)
    xs = _steps(F.col("_m.minx") + gap, F.col("_m.maxx") - w, w + gap)
    ys = _steps(F.col("_m.miny") + gap, F.col("_m.maxy") - h, h + gap)
    cells = F.flatten(
        F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y"))))
    )
    zero = F.lit(0.0)

    def inside(c: Column) -> Column:
        convex = F.forall(
            F.col("planes"),
            lambda p: p.a * c.x + p.b * c.y + F.greatest(p.a, zero) * w + F.greatest(p.b, zero) * h
            <= p.c - setback + g.EPS,
        )
        general = g.rect_clear_of_outline(F.col("ring"), c.x, c.y, F.lit(w), F.lit(h), setback)
        return F.when(F.col("convex"), convex).otherwise(general)

    placed = F.slice(F.filter(cells, inside), 1, k)
    return s.select("site_id", F.posexplode(placed).alias("plot_no", "_c")).select(
        "site_id", F.lit(strategy).alias("strategy"), "plot_no", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"),
        F.lit(w).alias("w"), F.lit(h).alias("h"),
    )


def _uniform(*parts: Column) -> Column:
    """Hash of the parts as a number in [0, 1); the same wherever and whenever the row is computed."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def sample_layouts(
    sites: DataFrame, n_candidates: int, n_plots: int, seed: int = 42, setback: float = 10.0,
    w: tuple[float, float] = (30.0, 80.0), h: tuple[float, float] = (40.0, 100.0), gap: float = 0.0,
) -> DataFrame:
    """Random rectangles inside the setback, each placed unless it meets an earlier placed one.

    Placement order matters, so one candidate is folded inside its row; candidates spread over the cluster.
    """
    s = _prepared(sites)
    s = s.withColumn("candidate_no", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    s = spread(s, "site_id", "candidate_no")
    zero = F.lit(0.0)

    def u(i: Column, what: int) -> Column:
        return _uniform(F.lit(seed), F.col("site_id"), F.col("candidate_no"), i, F.lit(what))

    def draw(i: Column) -> Column:
        pw, ph = w[0] + u(i, 1) * (w[1] - w[0]), h[0] + u(i, 2) * (h[1] - h[0])
        x = F.col("_m.minx") + u(i, 3) * F.greatest(F.col("_m.maxx") - F.col("_m.minx") - pw, zero)
        y = F.col("_m.miny") + u(i, 4) * F.greatest(F.col("_m.maxy") - F.col("_m.miny") - ph, zero)
        return F.struct(i.alias("plot_no"), x.alias("x"), y.alias("y"), pw.alias("w"), ph.alias("h"))

    def fits(r: Column) -> Column:
        convex = F.forall(
            F.col("planes"),
            lambda p: p.a * r.x + p.b * r.y + F.greatest(p.a, zero) * r.w + F.greatest(p.b, zero) * r.h
            <= p.c - setback + g.EPS,
        )
        return F.when(F.col("convex"), convex).otherwise(
            g.rect_clear_of_outline(F.col("ring"), r.x, r.y, r.w, r.h, setback)
        )

    def meets(r: Column, q: Column) -> Column:
        return (
            (r.x < q.x + q.w + gap) & (q.x < r.x + r.w + gap) & (r.y < q.y + q.h + gap) & (q.y < r.y + r.h + gap)
        )

    s = g.materialize(s, _d=F.transform(F.sequence(F.lit(0), F.lit(n_plots - 1)), draw))
    s = g.materialize(s, _d=F.filter(F.col("_d"), fits))
    placed = F.aggregate(
        F.col("_d"),
        F.slice(F.col("_d"), 1, 0),
        lambda acc, r: F.when(F.exists(acc, lambda q: meets(r, q)), acc).otherwise(F.concat(acc, F.array(r))),
    )
    return s.select("site_id", "candidate_no", F.explode(placed).alias("_p")).select("site_id", "candidate_no", "_p.*")


def mutate_layouts(
    placed: DataFrame, sites: DataFrame, seed: int = 43, shift: float = 30.0, probability: float = 0.3, setback: float = 10.0
) -> DataFrame:
    """Each plot moved by up to ``shift`` with the given probability, clamped to the bounds, undone when outside."""
    s = _prepared(sites.select("site_id", "ring"))
    j = placed.join(s, "site_id")
    ids = [F.col("site_id"), F.col("candidate_no"), F.col("plot_no")]
    moves = _uniform(F.lit(seed), *ids, F.lit(0)) < probability

    def moved(axis: str, size: str, lo: str, hi: str, what: int) -> Column:
        v = F.col(axis) + (2 * _uniform(F.lit(seed), *ids, F.lit(what)) - 1) * shift
        return F.least(F.greatest(v, F.col(lo)), F.greatest(F.col(hi) - F.col(size), F.col(lo)))

    j = j.withColumnRenamed("x", "_x").withColumnRenamed("y", "_y")
    j = j.withColumn("x", moved("_x", "w", "_m.minx", "_m.maxx", 1)).withColumn("y", moved("_y", "h", "_m.miny", "_m.maxy", 2))
    ok = moves & rect_in_site("ring", setback, prepared=True)
    return j.select(
        "site_id", "candidate_no", "plot_no", F.when(ok, F.col("x")).otherwise(F.col("_x")).alias("x"),
        F.when(ok, F.col("y")).otherwise(F.col("_y")).alias("y"), "w", "h", ok.alias("moved"),
    )


def lot_envelope(lots: DataFrame, front: float) -> DataFrame:
    """Buildable area behind the front setback and the remainder; an empty inset makes the whole lot setback."""
    a = g.area(F.col("ring"))
    b = F.round(g.area(g.inset(F.col("ring"), front)), 6)
    return lots.withColumn("area_sqm", a).withColumn("buildable_sqm", b).withColumn(
        "setback_sqm", F.col("area_sqm") - F.col("buildable_sqm")
    )
