"""Utility networks of all sites at once: neighbour edges, spanning trees, loops, paths, centres, drainage.

Points are ``(site_id, node, px, py)`` with ``node`` a BIGINT unique within its site; edges are
``(site_id, u, v, weight)`` with ``u < v``.  Iterative operators cut their lineage with a reliable checkpoint
each round and read one counter on the driver; no data comes back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import merged, near_pairs
from parcelgrid.session import cut_lineage

EDGE = ["site_id", "u", "v", "weight"]


def candidate_edges(points: DataFrame, max_d: float, cell_m: float | None = None) -> DataFrame:
    """Pairs strictly nearer than ``max_d``, found through grid cells."""
    p = points.select(
        "site_id", "node", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h")
    )
    pairs = near_pairs(p, p, ["site_id"], max_d, cell_m or max_d, F.col("node") < F.col("node_b"))
    return pairs.filter(F.col("gap_m") < max_d).select(
        "site_id", F.col("node").alias("u"), F.col("node_b").alias("v"), F.col("gap_m").alias("weight")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from every node, by contraction.

    Every component points to its smallest neighbour, if that is smaller; pointers are followed to their ends by doubling,
    and the edges go on between the components reached.  At least half of the components with neighbours go in each
    round, so a chain of a million nodes takes some twenty rounds, on edges that become fewer.
    """
    e = edges.select("site_id", F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b")
    live = cut_lineage(e.unionByName(e.select("site_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("site_id", "node", F.col("node").alias("comp"))
    while not live.isEmpty():
        to = live.groupBy("site_id", "a").agg(F.min("b").alias("low")).select("site_id", "a", F.least("a", "low").alias("to"))
        moving = True
        while moving:
            for _ in range(2):
                ahead = to.select("site_id", F.col("a").alias("to"), F.col("to").alias("next"))
                to = to.join(merged(ahead), ["site_id", "to"]).select("site_id", "a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            to = cut_lineage(to)
            moving = not to.filter("moved").isEmpty()
        to = to.drop("moved")
        labels = labels.join(merged(to.withColumnRenamed("a", "comp")), ["site_id", "comp"], "left").select(
            "site_id", "node", F.coalesce("to", "comp").alias("comp")
        )
        live = cut_lineage(
            live.join(merged(to), ["site_id", "a"]).select("site_id", F.col("to").alias("a"), "b")
            .join(merged(to.select("site_id", F.col("a").alias("b"), F.col("to").alias("c"))), ["site_id", "b"])
            .filter("a <> c").select("site_id", "a", F.col("c").alias("b")).distinct()
        )
    return cut_lineage(labels)


def _hook(picked: DataFrame) -> DataFrame:
    """Root of every component that picked an edge.

    Each component points to the other end of its edge; of two pointing at each other the smaller id is the
    root.  Pointers are then followed twice per round until none moves.
    """
    p = picked.select("site_id", "c", F.when(F.col("cu") == F.col("c"), F.col("cv")).otherwise(F.col("cu")).alias("to"))
    other = p.select("site_id", F.col("c").alias("to"), F.col("to").alias("back"))
    up = p.join(merged(other), ["site_id", "to"], "left").select(
        "site_id", "c",
        F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"),
    )
    up = cut_lineage(up)
    while True:
        hop = up.select("site_id", F.col("c").alias("to"), F.col("to").alias("to2"))
        twice = up.join(merged(hop), ["site_id", "to"], "left").select(
            "site_id", "c", "to", F.coalesce("to2", "to").alias("new")
        )
        hop2 = hop.withColumnRenamed("to", "new").withColumnRenamed("to2", "to3")
        step = cut_lineage(
            twice.join(merged(hop2), ["site_id", "new"], "left").select("site_id", "c", "to", F.coalesce("to3", "new").alias("new"))
        )
        done = step.filter("`to` <> `new`").isEmpty()
        up = step.select("site_id", "c", F.col("new").alias("to"))
        if done:
            break
    return up.select("site_id", F.col("c").alias("comp"), F.col("to").alias("root"))


def _relabel(labels: DataFrame, roots: DataFrame) -> DataFrame:
    cols = [c for c in labels.columns if c != "comp"]
    return labels.join(merged(roots), ["site_id", "comp"], "left").select(*cols, F.coalesce("root", "comp").alias("comp"))


def _cheapest(live: DataFrame) -> DataFrame:
    """Cheapest outgoing edge per component; the minimum is taken on the map side first."""
    ends = live.withColumn("c", F.explode(F.array("cu", "cv")))
    best = ends.groupBy("site_id", "c").agg(F.min(F.struct("weight", "u", "v", "cu", "cv")).alias("_e"))
    return best.select("site_id", "c", "_e.*")


def mst(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest per site.  Every component picks its cheapest outgoing edge each round; ties go to
    the lower ``(weight, u, v)``, so the forest is unique and no cycle can close."""
    labels = nodes.select("site_id", "node", F.col("node").alias("comp"))
    live, tree = edges.select(*EDGE), None
    while True:
        j = live.join(
            merged(labels.select("site_id", F.col("node").alias("u"), F.col("comp").alias("cu"))), ["site_id", "u"]
        ).join(merged(labels.select("site_id", F.col("node").alias("v"), F.col("comp").alias("cv"))), ["site_id", "v"])
        live = cut_lineage(j.filter("cu <> cv"))
        picked = cut_lineage(_cheapest(live))
        if picked.isEmpty():
            break
        new = picked.select(*EDGE).distinct()
        tree = new if tree is None else tree.unionByName(new)
        labels = cut_lineage(_relabel(labels, _hook(picked)))
        live = live.select(*EDGE)
    return tree if tree is not None else edges.select(*EDGE).limit(0)


#: Directions around a point; the edges of a spanning tree need six or more.
SECTORS = 8


def _sector_reach(k: int) -> Column:
    """How far the box of the site extends from ``(px, py)`` within one sector."""
    def exit_at(angle: float) -> Column:
        c, s = math.cos(angle), math.sin(angle)
        sides = []
        if abs(c) > 1e-12:
            sides.append(((F.col("maxx") if c > 0 else F.col("minx")) - F.col("px")) / c)
        if abs(s) > 1e-12:
            sides.append(((F.col("maxy") if s > 0 else F.col("miny")) - F.col("py")) / s)
        return F.least(*sides) if len(sides) > 1 else sides[0]

    step = 2 * math.pi / SECTORS
    ends = [exit_at(k * step - math.pi), exit_at((k + 1) * step - math.pi)]
    for x in ("minx", "maxx"):
        for y in ("miny", "maxy"):
            dx, dy = F.col(x) - F.col("px"), F.col(y) - F.col("py")
            ends.append(F.when(_sector(dx, dy) == k, F.hypot(dx, dy)).otherwise(0.0))
    return F.greatest(*ends)


def _sector(dx: Column, dy: Column) -> Column:
    turn = (F.atan2(dy, dx) + math.pi) / (2 * math.pi / SECTORS)
    return F.pmod(F.floor(turn), F.lit(SECTORS)).cast("int")


def cone_edges(points: DataFrame) -> DataFrame:
    """Edges from each point to the nearest one in each of ``SECTORS`` directions: at most that many per point, and all
    edges of the spanning tree are among them.

    ``points(site_id, node, px, py)``, no two of a site at one place.  Neighbours are looked for within a radius that
    starts at the mean spacing of the site and doubles; a point drops out when each sector holds one or ends, within
    the box of the site, before the radius does.  After the first rounds only points at the rim are left.
    """
    box = points.groupBy("site_id").agg(
        *[f(c).alias(f"{n}{c[1]}") for c in ("px", "py") for f, n in ((F.min, "min"), (F.max, "max"))], F.count("*").alias("_n")
    )
    spacing = F.sqrt(F.greatest(
        (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")),
        F.pow(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")), 2) / F.col("_n"), F.lit(1e-12),
    ) / F.col("_n"))
    # in units of the spacing, so that one radius suits sites of every density
    p = cut_lineage(points.join(box.withColumn("_u", spacing), "site_id").select(
        "site_id", "node", "px", "py", "minx", "maxx", "miny", "maxy", "_u", (F.col("px") / F.col("_u")).alias("x"),
        (F.col("py") / F.col("_u")).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"),
    ))
    others = p.select("site_id", "node", "px", "py", "x", "y", "w", "h")
    todo, edges, radius = p, None, 1.5
    while True:
        near = near_pairs(todo.select(*others.columns), others, ["site_id"], radius, radius, F.col("node") != F.col("node_b"))
        dx, dy = F.col("px_b") - F.col("px"), F.col("py_b") - F.col("py")
        edge = F.struct(F.hypot(dx, dy).alias("weight"), F.least("node", "node_b").alias("u"), F.greatest("node", "node_b").alias("v"))
        best = cut_lineage(near.groupBy("site_id", "node", _sector(dx, dy).alias("sector")).agg(F.min(edge).alias("_e")))
        found = best.select("site_id", "_e.u", "_e.v", "_e.weight")
        edges = found if edges is None else edges.unionByName(found)
        held = best.groupBy("site_id", "node").agg(F.collect_set("sector").alias("_held"))
        open_ = F.exists(
            F.array(*[F.struct(F.lit(k).alias("k"), _sector_reach(k).alias("reach")) for k in range(SECTORS)]),
            lambda s: (s["reach"] > radius * F.col("_u")) & ~F.array_contains(F.coalesce("_held", F.array().cast("array<int>")), s["k"]),
        )
        todo = cut_lineage(todo.join(held, ["site_id", "node"], "left").filter(open_).drop("_held"))
        if todo.isEmpty():
            return edges.distinct()
        radius *= 2


def euclidean_mst(points: DataFrame, start_m: float | None = None) -> DataFrame:
    """Spanning tree over all points without listing all pairs: the spanning tree of their cone edges.

    Copies of one location hang on their smallest id at length 0.  A point without a place is an error.  Edges of equal
    length are taken in the order of their ends, so the tree is unique.  ``start_m`` is not used any more.
    """
    pts = cut_lineage(points.select("site_id", "node", "px", "py"))
    placed = F.col("px").isNotNull() & F.col("py").isNotNull() & ~F.isnan("px") & ~F.isnan("py")
    if not pts.filter(~placed).isEmpty():
        raise ValueError("a point has no place")
    spot = pts.groupBy("site_id", "px", "py").agg(F.min("node").alias("rep"))
    copies = pts.join(spot, ["site_id", "px", "py"]).filter("node <> rep").select(
        "site_id", F.col("rep").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("weight")
    )
    places = cut_lineage(spot.select("site_id", F.col("rep").alias("node"), "px", "py"))
    return copies.unionByName(mst(places, cone_edges(places)))


def loop_network(points: DataFrame, max_d: float = 500.0, redundancy: float = 0.15) -> DataFrame:
    """Spanning tree of the largest component plus its shortest other edges, at least one where there is any."""
    pts = cut_lineage(points.select("site_id", "node", "px", "py"))
    edges = cut_lineage(candidate_edges(pts, max_d))
    comp = components(pts, edges)
    size = comp.groupBy("site_id", "comp").agg(F.count("*").alias("n"))
    largest = size.groupBy("site_id").agg(
        F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"), F.sum("n").alias("n_all")
    )
    kept = comp.join(largest, ["site_id", "comp"]).select("site_id", "node", "n_all")
    inner = cut_lineage(edges.join(kept.select("site_id", F.col("node").alias("u")), ["site_id", "u"], "left_semi"))
    tree = mst(kept.select("site_id", "node"), inner)
    rest = inner.join(tree.select("site_id", "u", "v"), ["site_id", "u", "v"], "left_anti")
    extra = shortest_per_site(rest, largest.select("site_id", F.greatest(
        F.lit(1), F.floor(F.col("n_all") * redundancy)).alias("k")))
    return tree.withColumn("kind", F.lit("tree")).unionByName(extra.select(*EDGE).withColumn("kind", F.lit("loop")))


def shortest_per_site(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """The ``k`` shortest edges per site, ``k`` a column; large sites are ranked in chunks."""
    from parcelgrid.operators.prefix import ranked

    # one number that orders as (u, v) does; a decimal holds both ids whole
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    keyed = edges.withColumn("_tie", whole("u") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + whole("v"))
    r = ranked(keyed, ["site_id"], "weight", "_tie")
    return r.join(limits, "site_id").filter(F.col("rn") <= F.col("k")).drop("_tie")


def steiner_approx(terminals: DataFrame, extra: DataFrame, start_m: float) -> DataFrame:
    """Spanning tree over terminals and all candidate points; unused candidates stay, as in the original."""
    return euclidean_mst(terminals.unionByName(extra), start_m)


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distance and predecessor of every node reachable from its site's source, by frontier relaxation.

    Edges without a length, or of a negative or infinite one, are no way.
    """
    e = edges.select(*EDGE).filter((F.col("weight") >= 0) & (F.col("weight") < float("inf")))
    both = cut_lineage(
        e.unionByName(e.select("site_id", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    )
    best = cut_lineage(
        sources.select("site_id", "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("fresh"))
    )
    while True:
        front = best.filter("fresh").select("site_id", F.col("node").alias("u"), "dist")
        offers = front.join(merged(both), ["site_id", "u"]).groupBy("site_id", F.col("v").alias("node")).agg(
            F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("u").alias("pred"))).alias("_o")
        )
        offered = best.drop("fresh").join(merged(offers), ["site_id", "node"], "full").select(
            "site_id",
            "node",
            F.when(F.col("dist").isNull() | (F.col("_o.dist") < F.col("dist") - g.EPS), True).otherwise(False).alias("fresh"),
            "dist",
            "pred",
            "_o",
        )
        best = cut_lineage(
            offered.select(
                "site_id", "node", F.when(F.col("fresh"), F.col("_o.dist")).otherwise(F.col("dist")).alias("dist"),
                F.when(F.col("fresh"), F.col("_o.pred")).otherwise(F.col("pred")).alias("pred"), "fresh",
            )
        )
        if best.filter("fresh").isEmpty():
            return best.drop("fresh")


def path_to(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of the path from the source to each site's target; nothing when unreachable."""
    at = cut_lineage(targets.select("site_id", "node", F.lit(0).alias("step")).join(
        merged(paths.select("site_id", "node")), ["site_id", "node"], "left_semi"))
    out, k = at, 0
    while True:
        k += 1
        nxt = at.join(merged(paths), ["site_id", "node"]).filter("pred is not null").select(
            "site_id", F.col("pred").alias("node"), F.lit(k).alias("step")
        )
        at = cut_lineage(nxt)
        if at.isEmpty():
            return out
        out = out.unionByName(at)


def _walked_cells(segments: DataFrame, cell_m: float) -> DataFrame:
    """One row for each grid cell ``cx, cy`` that the segment ``ax, ay, bx, by`` meets: linear in its length.

    Columns of cells come first; within a column the segment covers the range between its heights at the two borders.
    """
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = segments.withColumn("cx", F.explode(F.sequence(F.floor(left / cell_m), F.floor(right / cell_m))))
    slope = (F.col("by") - F.col("ay")) / F.when(F.col("bx") != F.col("ax"), F.col("bx") - F.col("ax"))

    def height(x: Column) -> Column:
        return F.col("ay") + (x - F.col("ax")) * slope

    ya = F.coalesce(height(F.greatest(left, F.col("cx") * cell_m)), F.col("ay"))
    yb = F.coalesce(height(F.least(right, (F.col("cx") + 1) * cell_m)), F.col("by"))
    # rounding of a height must not lose a cell
    low, high = (F.floor((y / cell_m) + d) for y, d in ((F.least(ya, yb), -1e-6), (F.greatest(ya, yb), 1e-6)))
    return columns.withColumn("cy", F.explode(F.sequence(low, high)))


def visibility_edges(
    edges: DataFrame, points: DataFrame, obstacles: DataFrame, cell_m: float = 100.0, buffer: str | None = None
) -> DataFrame:
    """Edges that keep clear of all obstacles of their site; touching is allowed.

    ``obstacles(site_id, ring)`` are simple rings of any shape, or rectangles ``(site_id, x, y, w, h)``.  With ``buffer``,
    the name of a column, an edge must also keep that distance; null counts as 0.  Segments and obstacles meet in the
    grid cells that the segment runs through.  An edge whose ends have no place, and an obstacle without one, block nothing.
    """
    p = points.select("site_id", "node", "px", "py")
    e = edges.select("site_id", "u", "v").distinct()
    e = e.join(merged(p.select("site_id", F.col("node").alias("u"), F.col("px").alias("ax"), F.col("py").alias("ay"))), ["site_id", "u"])
    e = e.join(merged(p.select("site_id", F.col("node").alias("v"), F.col("px").alias("bx"), F.col("py").alias("by"))), ["site_id", "v"])
    ring = F.col("ring") if "ring" in obstacles.columns else g.rect_ring(*(F.col(k) for k in "xywh"))
    keep = F.coalesce(F.col(buffer), F.lit(0.0)) if buffer else F.lit(0.0)
    o = g.materialize(obstacles.select("site_id", ring.alias("ring"), keep.alias("keep")), _b=g.bounds(F.col("ring")))
    cells = lambda lo, hi: F.explode(F.sequence(
        F.floor((F.col(lo) - F.col("keep")) / cell_m - 1e-6), F.floor((F.col(hi) + F.col("keep")) / cell_m + 1e-6)))
    o = o.select("site_id", "ring", "keep", "_b", cells("_b.minx", "_b.maxx").alias("cx"), "_b.miny", "_b.maxy")
    o = o.select("site_id", "ring", "keep", "_b", "cx", cells("miny", "maxy").alias("cy"))
    placed = F.coalesce(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by"), F.lit(float("nan")))
    walked = _walked_cells(e.filter(~F.isnan(placed)), cell_m)
    near = (
        (F.least("ax", "bx") < F.col("_b.maxx") + F.col("keep")) & (F.greatest("ax", "bx") > F.col("_b.minx") - F.col("keep"))
        & (F.least("ay", "by") < F.col("_b.maxy") + F.col("keep")) & (F.greatest("ay", "by") > F.col("_b.miny") - F.col("keep"))
    )
    met = walked.join(o, ["site_id", "cx", "cy"]).filter(near)
    a, b = g.pt(F.col("ax"), F.col("ay")), g.pt(F.col("bx"), F.col("by"))
    inside = F.exists(
        g.clip_segment(a, b, F.col("ring")),
        lambda s: (F.hypot(s[1].x - s[0].x, s[1].y - s[0].y) > g.EPS)
        & g.point_in_ring(F.col("ring"), g.pt((s[0].x + s[1].x) / 2, (s[0].y + s[1].y) / 2), boundary=False),
    )
    close = (F.col("keep") > 0) & (g.ring_path_distance(F.col("ring"), F.array(a, b)) < F.col("keep") - g.EPS)
    blocked = met.filter(inside | close).select("site_id", "u", "v")
    return edges.join(merged(blocked), ["site_id", "u", "v"], "left_anti")


def network_summary(points: DataFrame, electric: DataFrame, water: DataFrame) -> DataFrame:
    """Lengths per site and redundant = edges - (nodes - 1), negative when the graph was not connected."""
    n = points.groupBy("site_id").agg(F.count("*").alias("n_nodes"))

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("site_id").agg(F.sum("weight").alias(f"{name}_m"), F.count("*").alias(f"n_{name}"))

    j = n.join(total(electric, "electric"), "site_id", "left").join(total(water, "water"), "site_id", "left")
    return j.select(
        "site_id", "n_nodes", F.coalesce("electric_m", F.lit(0.0)).alias("electric_m"),
        F.coalesce("water_m", F.lit(0.0)).alias("water_m"),
        (F.coalesce("n_electric", F.lit(0)) - (F.col("n_nodes") - 1)).alias("redundant"),
    )


def routing_points(assets: DataFrame, gates: DataFrame) -> DataFrame:
    """Gate as node -1 and the centres of all buildings of sites that have any; roads stay out."""
    b = assets.filter(F.col("type") != "internal_road").select(
        "site_id", F.col("asset_id").alias("node"), (F.col("x") + F.col("w") / 2).alias("px"),
        (F.col("y") + F.col("h") / 2).alias("py"),
    )
    served = gates.join(b.select("site_id").distinct(), "site_id", "left_semi")
    return b.unionByName(served.select("site_id", F.lit(-1).cast("long").alias("node"), "px", "py"))


def routing_errors(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """Sites that cannot be routed and why."""
    a = assets.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("type") != "internal_road").alias("n_buildings")
    )
    j = sites.select("site_id").join(a, "site_id", "left")
    error = F.when(F.col("n").isNull(), "no assets").when(F.col("n_buildings") == 0, "only roads")
    return j.select("site_id", error.alias("error")).filter("error is not null")


def route_to_boundary(sites: DataFrame, assets: DataFrame, offset: float = 2.0) -> DataFrame:
    """Straight connector from every asset centre to the nearest point of the inset outline."""
    inner = g.materialize(sites, _in=g.inset(F.col("ring"), offset))
    line = g.closed(F.when(F.size("_in") >= 3, F.col("_in")).otherwise(F.col("ring")))
    s = g.materialize(inner, line=line).select("site_id", "line")
    a = assets.select(
        "site_id", "asset_id", g.pt(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2).alias("c")
    ).join(s, "site_id")
    j = g.materialize(a, n=g.nearest_point(F.col("line"), F.col("c")))
    return j.select("site_id", "asset_id", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.dist").alias("length_m"))


def nearest_centre(points: DataFrame, centres: DataFrame, start_m: float) -> DataFrame:
    """Nearest centre of every point, searched in grid cells within a radius that doubles until all have one.

    A point never meets all centres of its site; whatever lies within the radius holds the nearest one.
    A site without a centre is an error.
    """
    if not points.join(centres.select("site_id"), "site_id", "left_anti").isEmpty():
        raise ValueError("a site has no centre")
    c = centres.select(
        "site_id", "c", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h")
    )
    todo, done, radius = points.select("site_id", "node", "px", "py"), None, float(start_m)
    while True:
        p = todo.select("*", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
        d = F.round((F.col("px") - F.col("x_b")) ** 2 + (F.col("py") - F.col("y_b")) ** 2, 6)
        near = near_pairs(p, c, ["site_id"], radius, radius, how="left").groupBy("site_id", "node").agg(
            F.min(F.when(F.col("x_b").isNotNull(), F.struct(d.alias("d"), F.col("c_b").alias("c")))).alias("_m"),
            F.first("px").alias("px"), F.first("py").alias("py"),
        )
        step = cut_lineage(near.select("site_id", "node", "px", "py", F.col("_m.c").alias("c")))
        hit = step.filter("c is not null")
        done = hit if done is None else done.unionByName(hit)
        todo = step.filter("c is null").drop("c")
        if todo.isEmpty():
            return done
        radius *= 2


def place_transformers(points: DataFrame, per: int = 15, rounds: int = 5, start_m: float = 200.0) -> DataFrame:
    """Centres of ``max(1, n div per)`` clusters per site, Lloyd rounds for all sites at once.

    Seeds are the points at equal steps of the id order; sums are combined on the map side.
    """
    from parcelgrid.operators.prefix import ranked

    p = points.select("site_id", "node", "px", "py")
    r = ranked(p, ["site_id"], "node", "node")
    k = F.greatest(F.lit(1), F.floor(F.col("n") / per))
    step = F.floor(F.col("n") / k)
    i = F.col("rn") - 1
    seed = (F.pmod(i, step) == 0) & (F.floor(i / step) < k)
    centres = cut_lineage(
        r.filter(seed).select("site_id", F.floor(i / step).cast("long").alias("c"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    )
    p = cut_lineage(p)
    for _ in range(rounds):
        nearest = nearest_centre(p, centres, start_m)
        moved = nearest.groupBy("site_id", "c").agg(
            F.round(F.avg("px"), 6).alias("nx"), F.round(F.avg("py"), 6).alias("ny")
        )
        # a centre that lost its points stays where it was
        centres = cut_lineage(centres.join(moved, ["site_id", "c"], "left").select(
            "site_id", "c", F.coalesce("nx", "cx").alias("cx"), F.coalesce("ny", "cy").alias("cy")
        ))
    return centres


def drainage_flow(lots: DataFrame, outlets: DataFrame, length: float = 30.0) -> DataFrame:
    """Arrow of fixed length from every lot towards its site's outlet; lots on the outlet have none."""
    j = lots.join(outlets.select("site_id", F.col("px").alias("ox"), F.col("py").alias("oy")), "site_id")
    dx, dy = F.col("ox") - F.col("px"), F.col("oy") - F.col("py")
    j = j.withColumn("_d", F.hypot(dx, dy)).filter("_d > 0")
    return j.select(
        "site_id", "node", "px", "py", (dx / F.col("_d") * length).alias("vx"), (dy / F.col("_d") * length).alias("vy")
    )
