"""Road templates over a table of sites, each a projection followed by one ``explode``.

Input rows carry ``site_id`` and ``ring``; parameters are columns or numbers, so every site may have its own.
Output: ``roads(site_id, template, axis, road_no, path, length_m)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g

ALONG, ACROSS, RING, CONNECTOR = 0, 1, 2, 3


def _frame(sites: DataFrame, rotation: g.Num) -> DataFrame:
    """Oriented box and the direction of the main axis after the requested rotation."""
    a = F.radians(F.pmod(g.num(rotation), F.lit(360.0)))
    boxed = g.materialize(sites, _b=g.obb(F.col("ring")))
    ux, uy = F.col("_b.ux"), F.col("_b.uy")
    return g.materialize(boxed, _cos=ux * F.cos(a) - uy * F.sin(a), _sin=ux * F.sin(a) + uy * F.cos(a))


def _line(axis: int, no: Column, offset: Column, min_len: float) -> Column:
    return F.struct(
        F.lit(axis).alias("axis"), no.cast("int").alias("no"), offset.cast("double").alias("offset"),
        F.lit(float(min_len)).alias("min_len"),
    )


def _comb(axis: int, n: Column, spacing: Column, min_len: float) -> Column:
    """``n`` lines placed symmetrically about the centre."""
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: _line(axis, i, (i - (n - 1) / 2.0) * spacing, min_len)
    )


def _draw(framed: DataFrame, template: str, lines: Column) -> DataFrame:
    """Lay the lines out, 1.5 times the box long, and clip each to its site."""
    j = framed.withColumn("_l", F.explode(lines))
    along = F.col("_l.axis") == ALONG
    cos, sin, off = F.col("_cos"), F.col("_sin"), F.col("_l.offset")
    cx = F.col("_b.cx") + off * F.when(along, -sin).otherwise(cos)
    cy = F.col("_b.cy") + off * F.when(along, cos).otherwise(sin)
    half = 0.75 * F.when(along, F.col("_b.length")).otherwise(F.col("_b.width"))
    dx, dy = F.when(along, cos).otherwise(-sin) * half, F.when(along, sin).otherwise(cos) * half
    j = g.materialize(
        j.select("site_id", "ring", "_l", cx.alias("_x"), cy.alias("_y"), dx.alias("_dx"), dy.alias("_dy")),
        _a=g.pt(F.col("_x") - F.col("_dx"), F.col("_y") - F.col("_dy")),
        _z=g.pt(F.col("_x") + F.col("_dx"), F.col("_y") + F.col("_dy")),
    )
    j = g.materialize(j, path=g.longest_part(g.clip_segment(F.col("_a"), F.col("_z"), F.col("ring"))))
    j = g.materialize(j.filter(F.col("path").isNotNull()), length_m=g.path_length(F.col("path")))
    return j.filter(F.col("length_m") > F.col("_l.min_len")).select(
        "site_id", F.lit(template).alias("template"), F.col("_l.axis").alias("axis"), F.col("_l.no").alias("road_no"),
        "path", "length_m",
    )


def roads_grid(sites: DataFrame, cell: g.Num = 100.0, rotation: g.Num = 0.0) -> DataFrame:
    s = _frame(sites, rotation)
    c = g.num(cell)

    def count(extent: Column) -> Column:
        return F.floor(extent / c + g.EPS).cast("int") + 1

    def spacing(extent: Column) -> Column:
        n = count(extent)
        return F.when(n > 1, F.try_divide(extent, n - 1)).otherwise(extent)

    w, ln = F.col("_b.width"), F.col("_b.length")
    return _draw(
        s, "grid", F.concat(_comb(ALONG, count(w), spacing(w), 20), _comb(ACROSS, count(ln), spacing(ln), 20))
    )


def roads_spine(sites: DataFrame, cell: g.Num = 100.0, rotation: g.Num = 0.0) -> DataFrame:
    c = g.num(cell)
    ln = F.col("_b.length")
    n = F.floor(ln / c + g.EPS).cast("int")
    main = F.array(_line(ALONG, F.lit(0), F.lit(0.0), 0))
    branch = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: _line(ACROSS, i + 1, c / 2 + i * c - ln / 2, 20),
    )
    return _draw(_frame(sites, rotation), "spine", F.when(n > 1, F.concat(main, branch)).otherwise(main))


def roads_cross(sites: DataFrame, rotation: g.Num = 0.0) -> DataFrame:
    two = F.array(_line(ALONG, F.lit(0), F.lit(0.0), 0), _line(ACROSS, F.lit(1), F.lit(0.0), 0))
    return _draw(_frame(sites, rotation), "cross", two)


def roads_loop(
    sites: DataFrame, buffer_m: float = 15.0, main_width: float = 15.0, entry_position: float = 0.25
) -> DataFrame:
    """Ring road inside the outline and a connector to it; a site too small for that gets a perimeter road.

    The ring is only drawn for convex outlines, see ``geometry.inset``.
    """
    d = float(buffer_m + main_width)
    ring = F.col("ring")
    # both insets in the batch of the box
    s = g.materialize(sites, _b=g.obb(ring), _deep=g.inset(ring, d), _wide=g.inset(ring, float(buffer_m)))
    s = g.materialize(s, _fits=(F.size("_deep") >= 3) & (g.area(F.col("_deep")) >= 100.0))
    s = g.materialize(s, _in=F.when(F.col("_fits"), F.col("_deep")).otherwise(F.col("_wide")))
    off = (entry_position - 0.5) * F.col("_b.length")
    entry = g.pt(F.col("_b.cx") + off * F.col("_b.ux"), F.col("_b.cy") + off * F.col("_b.uy"))
    s = g.materialize(s, _at=entry)
    s = g.materialize(s, _e=g.nearest_point(g.closed(ring), F.col("_at")))
    s = g.materialize(s, _r=g.nearest_point(g.closed(F.col("_in")), F.col("_e")))
    ring_road = F.struct(F.lit(RING).alias("axis"), F.lit(0).alias("no"), g.closed(F.col("_in")).alias("path"))
    connector = F.struct(
        F.lit(CONNECTOR).alias("axis"), F.lit(1).alias("no"),
        F.array(g.pt(F.col("_e.x"), F.col("_e.y")), g.pt(F.col("_r.x"), F.col("_r.y"))).alias("path"),
    )
    roads = F.when(F.col("_fits"), F.array(ring_road, connector)).when(F.size("_in") >= 3, F.array(ring_road))
    j = s.select("site_id", F.explode(roads).alias("_l"))
    return j.select(
        "site_id", F.lit("loop").alias("template"), F.col("_l.axis").alias("axis"), F.col("_l.no").alias("road_no"),
        F.col("_l.path").alias("path"), g.path_length(F.col("_l.path")).alias("length_m"),
    )


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "grid": roads_grid,
    "spine": roads_spine,
    "cross": roads_cross,
    "loop": roads_loop,
}


def roads_by_template(sites: DataFrame, template: str = "template") -> DataFrame:
    """Every site by the generator its ``template`` column names; see ``template_errors`` for unknown names."""
    parts = [make(sites.filter(F.col(template) == name)) for name, make in TEMPLATES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def template_errors(sites: DataFrame, template: str = "template") -> DataFrame:
    """A row with the reason for every site that ``roads_by_template`` can draw nothing for."""
    known = F.col(template).isin(*TEMPLATES)
    why = F.when(F.col(template).isNull(), "no template").when(~known, F.concat(F.lit("unknown template "), F.col(template)))
    return sites.select("site_id", template, why.alias("error")).filter("error IS NOT NULL")


def entry_points(sites: DataFrame, roads: DataFrame) -> DataFrame:
    """Entries per template: two opposite box corners (grid), axis ends (spine, cross), connector start (loop)."""
    ends = F.array(F.col("path")[0], F.col("path")[F.size("path") - 1])
    lines = roads.filter(
        ((F.col("template") == "spine") & (F.col("axis") == ALONG)) | (F.col("template") == "cross")
    ).select("site_id", "template", "road_no", F.posexplode(ends).alias("end_no", "p"))
    loops = roads.filter((F.col("template") == "loop") & (F.col("axis") == CONNECTOR)).select(
        "site_id", "template", "road_no", F.lit(0).alias("end_no"), F.col("path")[0].alias("p")
    )
    b = g.materialize(sites, _b=g.obb(F.col("ring")))
    ux, uy, lx, wx = F.col("_b.ux"), F.col("_b.uy"), F.col("_b.length") / 2, F.col("_b.width") / 2
    px, py = ux * lx - uy * wx, uy * lx + ux * wx
    corners = F.array(
        g.pt(F.col("_b.cx") - px, F.col("_b.cy") - py), g.pt(F.col("_b.cx") + px, F.col("_b.cy") + py)
    )
    grids = b.select("site_id", F.posexplode(corners).alias("end_no", "p")).join(
        roads.filter(F.col("template") == "grid").select("site_id").distinct(), "site_id", "left_semi"
    ).select("site_id", F.lit("grid").alias("template"), F.lit(0).alias("road_no"), "end_no", "p")
    return lines.unionByName(loops).unionByName(grids)


def recommend_template(area_m2: Column, aspect: Column) -> Column:
    return (
        F.when(aspect > 2.5, "spine").when(aspect < 1.3, "cross").when(area_m2 > 500000, "grid").otherwise("loop")
    )


def fold_parameters(requests: DataFrame, cell: float = 100.0, width: float = 12.0) -> DataFrame:
    """Template parameters per site from a log ``(site_id, seq, action, value)``.

    Rotation adds up; a width below 6 m or a cell outside 30-500 m is refused and the last accepted value stays.
    """
    a, v = F.col("action"), F.col("value")
    ok_cell = (a == "set_cell_size") & v.between(30, 500)
    ok_width = (a == "set_road_width") & (v >= 6)
    refused = a.isin("set_cell_size", "set_road_width") & ~ok_cell & ~ok_width
    return requests.groupBy("site_id").agg(
        F.coalesce(F.sum(F.when(a == "rotate", v)), F.lit(0.0)).alias("rotation"),
        F.coalesce(F.max_by(F.when(ok_cell, v), F.when(ok_cell, F.col("seq"))), F.lit(float(cell))).alias("cell_m"),
        F.coalesce(F.max_by(F.when(ok_width, v), F.when(ok_width, F.col("seq"))), F.lit(float(width))).alias("width_m"),
        F.count_if(refused).alias("n_refused"),
    )
