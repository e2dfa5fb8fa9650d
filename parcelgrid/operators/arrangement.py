"""Arrangements of edges: overlays of polygons of any shape, and rings put together from loose edges.

The edges of all polygons of a site are split where they cross, touch or run along each other, so that every piece lies
inside, outside or on the outline of each polygon.  A piece on an outline knows its covered side from the direction of
that outline, for all others the parity of its midpoint tells.  Pieces with wanted land on one side only are the outline
of the result; each points to the next one around that land, and rings are put in order by pointer doubling.

Edges meet through bucketed joins and rings grow by joins on edge numbers, so neither a site nor a ring is worked on in
one task before it is a row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.functions.overlay_kernels import SNAP
from parcelgrid.operators.bucket import merged, near_pairs, spread, with_box
from parcelgrid.operators.network import components
from parcelgrid.operators.prefix import ranked
from parcelgrid.session import cut_lineage

#: Sides of a key that are merged in one row at most.
FEW_SIDES = 256

Keep = Callable[[dict[str, Column]], Column]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once, with a number of their own."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def snapped(points: DataFrame, keys: Sequence[str], tol: float, cell_m: float = 100.0) -> DataFrame:
    """``(keys, px, py, nx, ny)`` of the points that move: points within ``tol`` of each other, and of those in turn,
    meet at the first of them in the order of ``(x, y)``.  Neighbouring cells are searched, so no grid line parts them."""
    p = points.select(*keys, "px", "py").distinct()
    box = p.select(*keys, "px", "py", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    first = F.struct("px", "py") < F.struct("px_b", "py_b")
    # points have no extent: in small cells only those that may be one meet
    fine = min(cell_m, max(1.0, 4 * tol))
    pairs = cut_lineage(near_pairs(box, box, keys, tol, fine, first).select(*keys, "px", "py", "px_b", "py_b"))
    nodes = numbered(
        pairs.select(*keys, "px", "py").unionByName(
            pairs.select(*keys, F.col("px_b").alias("px"), F.col("py_b").alias("py"))
        ).distinct(), "node",
    )
    if nodes.isEmpty():
        return nodes.select(*keys, "px", "py", F.col("px").alias("nx"), F.col("py").alias("ny"))
    there = nodes.select(*keys, F.col("px").alias("px_b"), F.col("py").alias("py_b"), F.col("node").alias("v"))
    edges = pairs.join(nodes, [*keys, "px", "py"]).join(there, [*keys, "px_b", "py_b"])
    one = F.lit(0).alias("site_id")
    comp = components(nodes.select(one, "node"), edges.select(one, F.col("node").alias("u"), "v")).select("node", "comp")
    placed = nodes.join(comp, "node")
    to = placed.groupBy("comp").agg(F.min(F.struct("px", "py")).alias("_t"))
    return placed.join(to, "comp").select(*keys, "px", "py", F.col("_t.px").alias("nx"), F.col("_t.py").alias("ny"))


def move(df: DataFrame, moves: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``df`` with the points ``(x, y)`` that move where they move to."""
    m = moves.select(*keys, F.col("px").alias(x), F.col("py").alias(y), "nx", "ny")
    return df.join(m, [*keys, x, y], "left").withColumns(
        {x: F.coalesce("nx", x), y: F.coalesce("ny", y)}
    ).drop("nx", "ny")


def _sides(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of all rings, counter-clockwise; rings without an area have none."""
    a = g.materialize(polygons.select(*keys, "poly", "role", "ring"), _a=g.signed_area(F.col("ring")))
    ring = F.when(F.col("_a") < 0, F.reverse("ring")).otherwise(F.col("ring"))
    e = a.filter("_a <> 0").select(*keys, "poly", "role", F.explode(g.edges(ring)).alias("_e"))
    return e.select(
        *keys, "poly", "role", F.col("_e.p.x").alias("x1"), F.col("_e.p.y").alias("y1"), F.col("_e.q.x").alias("x2"),
        F.col("_e.q.y").alias("y2"),
    ).filter("x1 <> x2 OR y1 <> y2")


def _split_points(sides: DataFrame, keys: Sequence[str], tol: float, cell_m: float) -> DataFrame:
    """Ends of every side and the points where another one crosses or touches it, with their place along it."""
    boxed = sides.withColumns({
        "x": F.least("x1", "x2"), "y": F.least("y1", "y2"), "w": F.abs(F.col("x2") - F.col("x1")), "h": F.abs(F.col("y2") - F.col("y1")),
    })
    j = near_pairs(boxed, boxed, keys, tol, cell_m, F.col("side") != F.col("side_b"))
    # plain columns, one step after the other: they stay in generated code, where functions of arrays do not
    corners = ("x1", "y1", "x2", "y2")
    own = [*keys, "side", "poly", "role", *corners]
    # both sides of a pair compute their crossing from the same one, so they find the same point
    first = F.col("side") < F.col("side_b")
    j = j.select(
        *own, *[f"{c}_b" for c in corners], *[F.when(first, F.col(c)).otherwise(F.col(f"{c}_b")).alias(f"a_{c}") for c in corners],
        *[F.when(first, F.col(f"{c}_b")).otherwise(F.col(c)).alias(f"b_{c}") for c in corners],
    )
    c = F.col
    j = j.withColumns({
        "_dax": c("a_x2") - c("a_x1"), "_day": c("a_y2") - c("a_y1"), "_dbx": c("b_x2") - c("b_x1"), "_dby": c("b_y2") - c("b_y1"),
        "_ox": c("b_x1") - c("a_x1"), "_oy": c("b_y1") - c("a_y1"),
    }).withColumn("_det", c("_dax") * c("_dby") - c("_day") * c("_dbx"))
    j = j.withColumns({
        "_t": F.try_divide(c("_ox") * c("_dby") - c("_oy") * c("_dbx"), c("_det")),
        "_u": F.try_divide(c("_ox") * c("_day") - c("_oy") * c("_dax"), c("_det")),
    })
    meets = (c("_t") >= 0) & (c("_t") <= 1) & (c("_u") >= 0) & (c("_u") <= 1)
    j = j.withColumns({
        "_cx": F.when(meets, c("a_x1") + c("_t") * c("_dax")), "_cy": F.when(meets, c("a_y1") + c("_t") * c("_day")),
    })
    # an end within reach of the crossing stands for it
    at = [
        F.coalesce(*[
            F.when(F.hypot(c(f"{s}_x{k}") - c("_cx"), c(f"{s}_y{k}") - c("_cy")) <= tol, c(f"{s}_{v}{k}")) for s in "ab" for k in (1, 2)
        ], c(f"_c{v}")) for v in "xy"
    ]
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")

    def foot(k: int) -> Column:
        t = F.try_divide((c(f"x{k}_b") - c("x1")) * dx + (c(f"y{k}_b") - c("y1")) * dy, dx * dx + dy * dy)
        return F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    j = j.withColumns({"_k1": foot(1), "_k2": foot(2)})
    touch = {
        k: F.hypot(c(f"x{k}_b") - (c("x1") + c(f"_k{k}") * dx), c(f"y{k}_b") - (c("y1") + c(f"_k{k}") * dy)) <= tol for k in (1, 2)
    }
    j = g.materialize(j, _cx=at[0], _cy=at[1], **{
        f"_{v}{k}": F.when(touch[k], c(f"{v}{k}_b")) for k in (1, 2) for v in "xy"
    }).select(*own, "_cx", "_cy", "_x1", "_y1", "_x2", "_y2")
    # most pairs are neighbours of a ring and find an end of the side itself, which it has anyway
    new = [
        (c(px).isNotNull() & ~((c(px) == c("x1")) & (c(py) == c("y1"))) & ~((c(px) == c("x2")) & (c(py) == c("y2"))))
        for px, py in (("_cx", "_cy"), ("_x1", "_y1"), ("_x2", "_y2"))
    ]
    found = F.array(*[
        F.struct(n.alias("new"), c(px).alias("x"), c(py).alias("y")) for n, (px, py) in zip(new, (("_cx", "_cy"), ("_x1", "_y1"), ("_x2", "_y2")))
    ])
    met = j.filter(new[0] | new[1] | new[2]).select(*own, F.explode(found).alias("_p")).filter("_p.new").select(
        *own, g.pt(c("_p.x"), c("_p.y")).alias("_p")
    )
    ends = sides.select(
        *keys, "side", "poly", "role", "x1", "y1", "x2", "y2",
        F.explode(F.array(g.pt(F.col("x1"), F.col("y1")), g.pt(F.col("x2"), F.col("y2")))).alias("_p"),
    )
    along = ((F.col("_p.x") - F.col("x1")) * dx + (F.col("_p.y") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    return met.unionByName(ends).select(
        *keys, "side", "poly", "role", F.col("_p.x").alias("px"), F.col("_p.y").alias("py"), along.alias("t")
    )


def boundary_edges(
    polygons: DataFrame, keys: Sequence[str], keep: Keep, roles: Sequence[str], tol: float = SNAP, cell_m: float = 100.0
) -> DataFrame:
    """Directed edges ``(keys, ux, uy, vx, vy)`` around the wanted land, which lies on their left.

    ``polygons(keys, poly, role, ring)``.  ``keep`` gets, for each role, the number of its polygons that cover a place,
    and says whether the place is wanted.
    """
    sides = numbered(_sides(polygons, keys), "side")
    points = cut_lineage(_split_points(sides, keys, tol, cell_m))
    points = move(points, snapped(points, keys, tol, cell_m), keys, "px", "py")
    points = points.groupBy(*keys, "side", "poly", "role", "px", "py").agg(F.min("t").alias("t"))
    order = Window.partitionBy("side").orderBy("t")
    pieces = points.withColumns({"qx": F.lead("px").over(order), "qy": F.lead("py").over(order)}).filter("qx IS NOT NULL")
    p, q = F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"))
    onward = F.when(p < q, 1).otherwise(-1)
    own = cut_lineage(
        pieces.select(*keys, "poly", "role", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), onward.alias("way"))
        .groupBy(*keys, "a", "b", "poly", "role").agg(F.sum("way").alias("way"))
    )
    mid = own.select(*keys, "a", "b").distinct().select(
        "*", ((F.col("a.x") + F.col("b.x")) / 2).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2).alias("y"),
        F.lit(0.0).alias("w"), F.lit(0.0).alias("h"),
    )
    around = near_pairs(mid, with_box(polygons.select(*keys, "poly", "role", "ring")), keys, 0.0, cell_m).select(
        *keys, "a", "b", F.col("poly_b").alias("poly"), F.col("role_b").alias("role"), "ring_b", "x", "y"
    )
    inside = around.join(own.select(*keys, "a", "b", "poly"), [*keys, "a", "b", "poly"], "left_anti").filter(
        g.contains_point(F.col("ring_b"), F.col("x"), F.col("y"), boundary=False)
    )
    cover = own.select(*keys, "a", "b", "role", (F.col("way") > 0).cast("int").alias("l"), (F.col("way") < 0).cast("int").alias("r"))
    cover = cover.unionByName(inside.select(*keys, "a", "b", "role", F.lit(1).alias("l"), F.lit(1).alias("r")))
    counts = cover.groupBy(*keys, "a", "b").agg(*[
        F.sum(F.when(F.col("role") == role, F.col(s)).otherwise(0)).alias(f"_{s}_{role}") for role in roles for s in "lr"
    ])
    left, right = (keep({role: F.col(f"_{s}_{role}") for role in roles}) for s in "lr")
    edge = counts.withColumns({"_l": left, "_r": right}).filter("_l <> _r")
    ends = [
        F.when(F.col("_l"), F.col(f"{c}.{k}")).otherwise(F.col(f"{d}.{k}")).alias(f"{n}{k}")
        for c, d, n in (("a", "b", "u"), ("b", "a", "v")) for k in "xy"
    ]
    return edge.select(*keys, *ends)


def next_around(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edges(keys, edge, ux, uy, vx, vy)`` with ``next``: the edge that goes on with the same land on the left.

    Where several edges leave a point it is the first one clockwise from the way back, so land that touches itself in a
    point only falls into separate rings.
    """
    out = edges.select(
        *keys, F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("edge").alias("next"),
        F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")).alias("_to"),
    )
    back = F.atan2(F.col("uy") - F.col("vy"), F.col("ux") - F.col("vx"))
    turn = F.pmod(back - F.col("_to"), F.lit(2 * math.pi))
    turn = F.when(turn <= 1e-12, 2 * math.pi).otherwise(turn)
    j = edges.join(out, [*keys, "vx", "vy"]).select(*keys, "edge", "ux", "uy", "next", turn.alias("_turn"))
    return j.groupBy(*keys, "edge", "ux", "uy").agg(F.min_by("next", F.struct("_turn", "next")).alias("next"))


def order_rings(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rings ``(keys, ring_id, ring)`` of ``edges(keys, edge, next, ux, uy)``, every one of which has one before it.

    Pointer doubling: after k rounds each edge knows the lowest edge among the 2**k from it on, and how far that is.  A
    ring's lowest edge is its number and its first corner.  The number of rounds is the logarithm of the longest ring.
    """
    start = cut_lineage(edges)
    state = start.select("edge", F.col("next").alias("jump"), F.col("edge").alias("low"), F.lit(0).cast("long").alias("far"))
    span = 1
    while True:
        for _ in range(2):  # two steps for each written round
            there = state.select(
                F.col("edge").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("far").alias("_far")
            )
            lower = F.col("_low") < F.col("low")
            state = state.join(there, "jump").select(
                "edge", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"),
                F.when(lower, F.col("_far") + span).otherwise(F.col("far")).alias("far"), lower.alias("moved"),
            )
            span *= 2
        state = cut_lineage(state)
        if state.filter("moved").isEmpty():
            break
    corner = F.struct((-F.col("far")).alias("o"), F.col("ux").alias("x"), F.col("uy").alias("y"))
    ring = start.join(state.select("edge", "low", "far"), "edge").groupBy(*keys, F.col("low").alias("ring_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("far") > 0, corner))).alias("_c"),
        F.first(F.when(F.col("far") == 0, g.pt(F.col("ux"), F.col("uy"))), ignorenulls=True).alias("_first"),
    )
    rest = F.transform("_c", lambda c: g.pt(c["x"], c["y"]))
    return ring.select(*keys, "ring_id", F.concat(F.array("_first"), rest).alias("ring"))


def land_parts(edges: DataFrame, keys: Sequence[str], cell_m: float = 100.0) -> DataFrame:
    """Connected parts ``(keys, ring, holes, area_sqm)`` of the land on the left of ``edges(keys, ux, uy, vx, vy)``."""
    linked = next_around(numbered(edges, "edge"), keys)
    rings = order_rings(linked, keys)
    rings = g.materialize(rings, _whole=F.col("ring"), ring=g.drop_collinear(F.col("ring"), SNAP))
    rings = cut_lineage(g.materialize(rings, _a=g.signed_area(F.col("_whole"))))
    outer = rings.filter("_a > 0").select(*keys, "ring_id", "ring", F.col("_a").alias("_outer"))
    p, q = F.col("_whole")[0], F.col("_whole")[1]
    inner = rings.filter("_a < 0").select(
        *keys, F.col("ring").alias("hole"), F.col("ring_id").alias("hole_id"), (-F.col("_a")).alias("_inner"),
        ((p.x + q.x) / 2).alias("x"), ((p.y + q.y) / 2).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"),
    )
    # a hole lies in the smallest ring around it
    near = near_pairs(inner, with_box(outer), keys, 0.0, cell_m).filter(
        g.point_in_ring(F.col("ring_b"), g.pt(F.col("x"), F.col("y")), boundary=False)
    )
    holes = near.groupBy(*keys, "hole_id").agg(
        F.min_by(F.struct("ring_id_b", "hole", "_inner"), F.struct("_outer_b", "ring_id_b")).alias("_m")
    ).groupBy(F.col("_m.ring_id_b").alias("ring_id")).agg(
        F.collect_list("_m.hole").alias("holes"), F.sum("_m._inner").alias("_holes")
    )
    none = F.array().cast(f"array<{g.RING}>")
    return outer.join(holes, "ring_id", "left").select(
        *keys, "ring", F.coalesce("holes", none).alias("holes"), (F.col("_outer") - F.coalesce("_holes", F.lit(0.0))).alias("area_sqm")
    )


def numbered_parts(parts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Parts with ``name`` 1, 2, ... from the lowest left corner on."""
    b = g.materialize(parts, _b=g.bounds(F.col("ring"))).withColumns({"_x": F.round("_b.minx", 6), "_y": F.round("_b.miny", 6)})
    return ranked(b, keys, ["_x", "_y", "area_sqm"]).withColumnRenamed("rn", name).select(*parts.columns, name)


def extract_blocks(
    sites: DataFrame, roads: DataFrame, extra_width: float = 0.0, min_area: float = 500.0, cell_m: float = 100.0
) -> DataFrame:
    """Land of each site between its roads, for any outline and any road.

    ``sites(site_id, ring)``; ``roads(site_id, road_no, x1, y1, x2, y2, width_m)`` or with a ``path`` of points instead of
    two ends.  Roads are flat-capped strips; they may end inside the site, cross,
    bend (the strips of a path overlap there, without a rounded corner), or close around a block.
    Returns ``site_id, block_no, ring, holes, area_sqm``, numbered from the lower left corner; a site without roads
    stays one block.  Blocks below ``min_area`` are dropped.  A site without an outline, and roads without ends or
    width, give nothing; roads outside of all sites do no harm.
    """
    if "path" in roads.columns:
        path = F.col("path")
    else:
        path = g.ring_of((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    strips = roads.select("site_id", "road_no", F.posexplode(g.road_strips(path, F.col("width_m") + extra_width)).alias("_k", "ring"))
    polygons = sites.select("site_id", F.lit("site").alias("poly"), F.lit("site").alias("role"), "ring").unionByName(
        strips.select("site_id", F.concat_ws("/", "road_no", "_k").alias("poly"), F.lit("road").alias("role"), "ring")
    )
    usable = polygons.filter(
        (F.size("ring") >= 3) & F.forall("ring", lambda p: F.coalesce(~F.isnan(p.x + p.y), F.lit(False)))
    )
    edges = boundary_edges(
        usable, ["site_id"], lambda n: (n["site"] > 0) & (n["road"] == 0), ["site", "road"], cell_m=cell_m
    )
    parts = land_parts(edges, ["site_id"], cell_m).filter(F.col("area_sqm") >= min_area)
    # numbering leaves the few bytes of all blocks in a task or two
    return spread(numbered_parts(parts, ["site_id"], "block_no"), "site_id", "block_no")


def dissolve(
    parts: DataFrame, keys: Sequence[str], part_no: str = "part_no", cell_m: float = 100.0, few_sides: int = FEW_SIDES
) -> DataFrame:
    """Polygons of a key merged: exact outlines ``(keys, merged_no, ring, holes, area_sqm)``, overlaps counted once.

    ``parts(keys, part_no, ring)``.  Polygons that share an edge are one part, those that meet in a point are not.

    The polygons of a key with at most ``few_sides`` sides are one row and merged in Arrow batches, so that they are
    shuffled once; those of a larger key are spread over cells, edges and rings, each step of which is written.
    """
    polygons = parts.select(*keys, F.col(part_no).cast("string").alias("poly"), F.lit("part").alias("role"), "ring").filter(
        F.size("ring") >= 3
    ).dropna(subset=list(keys))
    large = cut_lineage(polygons.groupBy(*keys).agg(F.sum(F.size("ring")).alias("_n")).filter(F.col("_n") > few_sides).select(*keys))
    some = not large.isEmpty()
    few = polygons.join(merged(large), list(keys), "left_anti") if some else polygons.repartition(*keys)
    lists = few.groupBy(*keys).agg(F.collect_list(F.struct("poly", "ring")).alias("_p"))
    out = lists.select(*keys, g.dissolve(F.col("_p")).alias("_m")).select(*keys, F.posexplode("_m").alias("_no", "_m")).select(
        *keys, (F.col("_no") + 1).cast("long").alias("merged_no"), "_m.ring", "_m.holes", "_m.area_sqm"
    )
    if not some:
        return out
    edges = boundary_edges(polygons.join(merged(large), list(keys), "left_semi"), keys, lambda n: n["part"] > 0, ["part"], cell_m=cell_m)
    return out.unionByName(numbered_parts(land_parts(edges, keys, cell_m), keys, "merged_no").select(out.columns))
