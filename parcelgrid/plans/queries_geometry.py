"""Registered queries over the geometry expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelgrid.fixtures import Fixtures, sites_with_ring
from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import spread
from parcelgrid.plans import oracle_forms as o
from parcelgrid.plans.registry import query, r4


def plots_with_ring(fx: Fixtures) -> DataFrame:
    return g.materialize(fx.plots, ring=g.rect_ring(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def plots_in_sites(fx: Fixtures) -> DataFrame:
    """Plots joined to their layout's site, both with rings."""
    site = sites_with_ring(fx).select(
        "site_id", F.col("ring").alias("site"), F.col("w").alias("sw"), F.col("h").alias("sh"),
        F.col("cut"), F.col("concave"),
    )
    return plots_with_ring(fx).join(fx.layouts, "layout_id").join(site, "site_id")


@query(
    "g1_measures",
    f"""SELECT site_id, round({o.SITE_AREA},4) AS area_sqm,
        round(CASE WHEN concave THEN 2*(w+h) ELSE 2*(w+h)-2*cut+cut*sqrt(2.0) END,4) AS perimeter_m,
        0.0::DOUBLE AS minx, 0.0::DOUBLE AS miny, w AS maxx, h AS maxy,
        round(CASE WHEN concave THEN 5*w/12 ELSE (w*h*w/2-cut*cut/2*(w-cut/3))/(w*h-cut*cut/2) END,4) AS cx,
        round(CASE WHEN concave THEN 5*h/12 ELSE (w*h*h/2-cut*cut/2*(h-cut/3))/(w*h-cut*cut/2) END,4) AS cy,
        CASE WHEN concave THEN 6 ELSE 5 END AS n_vertices FROM sites""",
)
def measures(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).select(
        "site_id", "ring", g.bounds(F.col("ring")).alias("b"), g.centroid(F.col("ring")).alias("c")
    )
    ring = F.col("ring")
    return s.select(
        "site_id", r4(g.area(ring), "area_sqm"), r4(g.perimeter(ring), "perimeter_m"),
        "b.minx", "b.miny", "b.maxx", "b.maxy",
        r4(F.col("c.x"), "cx"), r4(F.col("c.y"), "cy"), g.vertex_count(ring).alias("n_vertices"),
    )


@query(
    "g2_normalize_ring",
    """SELECT layout_id, plot_no, 4 AS n, w*h AS signed_area, x+w AS x1, y AS y1, x+w AS x2, y+h AS y2 FROM plots""",
)
def normalize_ring(fx: Fixtures) -> DataFrame:
    x, y, w, h = (F.col(k) for k in "xywh")
    messy = g.ring_of((x, y), (x, y + h), (x + 0.05, y + h), (x + w, y + h), (x + w, y), (x, y))
    p = fx.plots.select("layout_id", "plot_no", g.normalize_ring(messy).alias("ring"))
    first, second = F.col("ring")[0], F.col("ring")[1]
    return p.select(
        "layout_id", "plot_no", F.size("ring").alias("n"), r4(g.signed_area(F.col("ring")), "signed_area"),
        first.x.alias("x1"), first.y.alias("y1"), second.x.alias("x2"), second.y.alias("y2"),
    )


@query(
    "g3_validate_geometry",
    """SELECT layout_id, plot_no, CASE WHEN plot_no%3=0 THEN 'invalid' ELSE 'valid' END AS status,
       plot_no%3=2 AS is_convex, CASE plot_no%3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.75*w*h ELSE w*h END AS area_sqm
       FROM plots""",
)
def validate_geometry(fx: Fixtures) -> DataFrame:
    x, y, w, h = (F.col(k) for k in "xywh")
    bow = g.ring_of((x, y), (x + w, y + h), (x + w, y), (x, y + h))
    ell = g.ring_of((x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h))
    ring = F.when(F.col("plot_no") % 3 == 0, bow).when(F.col("plot_no") % 3 == 1, ell).otherwise(
        g.rect_ring(x, y, w, h)
    )
    p = fx.plots.select("layout_id", "plot_no", ring.alias("ring")).withColumn("ok", g.is_simple(F.col("ring")))
    return p.select(
        "layout_id", "plot_no", F.when(F.col("ok"), "valid").otherwise("invalid").alias("status"),
        (F.col("ok") & g.is_convex(F.col("ring"))).alias("is_convex"), r4(g.area(F.col("ring")), "area_sqm"),
    )


@query(
    "g4_convex_hull",
    """SELECT site_id, 5 AS n_vertices, round(CASE WHEN concave THEN 0.875*w*h ELSE w*h-cut*cut/2 END,4) AS hull_area
       FROM sites""",
)
def convex_hull(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).select("site_id", g.convex_hull(F.col("ring")).alias("hull"))
    return s.select("site_id", F.size("hull").alias("n_vertices"), r4(g.signed_area(F.col("hull")), "hull_area"))


def turned_plots(fx: Fixtures) -> DataFrame:
    """Plots turned by the 3-4-5 angle about the origin."""
    return g.materialize(plots_with_ring(fx), ring=g.rotate_cs(F.col("ring"), 0.8, 0.6, g.pt(0, 0)))


@query(
    "g5_obb",
    """SELECT layout_id, plot_no, least(w,h) AS width_m, greatest(w,h) AS length_m,
       round(degrees(atan2(0.6,0.8)) + CASE WHEN w>=h THEN 0 ELSE 90 END,4) AS angle_deg,
       round(CASE WHEN w>=h THEN 0.8 ELSE -0.6 END,4)::DOUBLE AS ux, round(CASE WHEN w>=h THEN 0.6 ELSE 0.8 END,4)::DOUBLE AS uy,
       round(CASE WHEN w>=h THEN -0.6 ELSE -0.8 END,4)::DOUBLE AS perp_x, round(CASE WHEN w>=h THEN 0.8 ELSE -0.6 END,4)::DOUBLE AS perp_y
       FROM plots""",
)
def obb(fx: Fixtures) -> DataFrame:
    p = turned_plots(fx).select("layout_id", "plot_no", g.obb(F.col("ring")).alias("b"))
    return p.select(
        "layout_id", "plot_no", r4(F.col("b.width"), "width_m"), r4(F.col("b.length"), "length_m"),
        r4(F.col("b.angle_deg"), "angle_deg"), r4(F.col("b.ux"), "ux"), r4(F.col("b.uy"), "uy"),
        r4(-F.col("b.uy"), "perp_x"), r4(F.col("b.ux"), "perp_y"),
    )


@query(
    "g6_shape_quality",
    """SELECT layout_id, plot_no, 1.0::DOUBLE AS rectangularity, round(greatest(w,h)/least(w,h),4) AS aspect,
       round(0.7+0.3*least(w,h)/greatest(w,h),4) AS score,
       greatest(w,h)/least(w,h)<=4 AND w*h>=2000 AS is_valid FROM plots""",
)
def shape_quality(fx: Fixtures) -> DataFrame:
    p = turned_plots(fx).select(
        "layout_id", "plot_no", g.area(F.col("ring")).alias("a"), g.obb(F.col("ring")).alias("b")
    )
    p = p.withColumn("q", g.shape_quality(F.col("a"), F.col("b.width"), F.col("b.length"), min_area=2000.0))
    return p.select(
        "layout_id", "plot_no", r4(F.col("q.rectangularity"), "rectangularity"), r4(F.col("q.aspect"), "aspect"),
        r4(F.col("q.score"), "score"), F.col("q.is_valid").alias("is_valid"),
    )


@query(
    "g7_classify_lot",
    """SELECT layout_id, plot_no, CASE WHEN w*h<2500 THEN 'unusable' WHEN greatest(w,h)/least(w,h)<=4 THEN 'commercial'
       ELSE 'green_space' END AS lot_class FROM plots""",
)
def classify_lot(fx: Fixtures) -> DataFrame:
    p = plots_with_ring(fx).select(
        "layout_id", "plot_no", g.area(F.col("ring")).alias("a"), g.obb(F.col("ring")).alias("b")
    )
    p = p.withColumn("q", g.shape_quality(F.col("a"), F.col("b.width"), F.col("b.length"), 0.65, 4.0, 2500.0))
    return p.select(
        "layout_id", "plot_no", g.classify_lot(F.col("a"), F.col("q.is_valid"), 2500.0).alias("lot_class")
    )


@query(
    "g8_affine",
    """SELECT layout_id, plot_no, x+5 AS tx, y-3 AS ty, round(x+w/2 + (w/2)*0.8 - (h/2)*0.6,4) AS rx,
       round(y+h/2 + (w/2)*0.6 + (h/2)*0.8,4) AS ry, x+w/2 + 1.5*w/2 AS sx, y+h/2 + 1.5*h/2 AS sy FROM plots""",
)
def affine(fx: Fixtures) -> DataFrame:
    p = plots_with_ring(fx).withColumn("c", g.centroid(F.col("ring")))
    ring, c = F.col("ring"), F.col("c")
    p = p.select(
        "layout_id", "plot_no", g.translate(ring, 5, -3)[0].alias("t"),
        g.rotate_cs(ring, 0.8, 0.6, c)[2].alias("r"), g.scale(ring, 1.5, c)[2].alias("s"),
    )
    return p.select(
        "layout_id", "plot_no", r4(F.col("t.x"), "tx"), r4(F.col("t.y"), "ty"), r4(F.col("r.x"), "rx"),
        r4(F.col("r.y"), "ry"), r4(F.col("s.x"), "sx"), r4(F.col("s.y"), "sy"),
    )


@query(
    "g9_snap_to_grid",
    """SELECT layout_id, plot_no, round_even(x/10,0)*10 AS x0, round_even(y/10,0)*10 AS y0,
       (round_even((x+w)/10,0)-round_even(x/10,0))*(round_even((y+h)/10,0)-round_even(y/10,0))*100 AS area_sqm
       FROM plots""",
)
def snap_to_grid(fx: Fixtures) -> DataFrame:
    p = plots_with_ring(fx).select("layout_id", "plot_no", g.snap_to_grid(F.col("ring"), 10).alias("ring"))
    return p.select(
        "layout_id", "plot_no", F.col("ring")[0].x.alias("x0"), F.col("ring")[0].y.alias("y0"),
        r4(g.area(F.col("ring")), "area_sqm"),
    )


@query("g10_elevation", "SELECT layout_id, plot_no, round(50-0.02::DOUBLE*(x+w/2)-0.03::DOUBLE*(y+h/2),4) AS z FROM plots")
def elevation(fx: Fixtures) -> DataFrame:
    return fx.plots.select(
        "layout_id", "plot_no", r4(g.elevation(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2), "z")
    )


@query(
    "g11_legal_params",
    """SELECT layout_id, plot_no, d AS density, round(w*h*d,4) AS max_build_m2 FROM
       (SELECT *, CASE WHEN w*h<3000 THEN 0.70::DOUBLE WHEN w*h<10000 THEN 0.65::DOUBLE ELSE 0.60::DOUBLE END AS d FROM plots)
       WHERE w>44 AND h>44""",
)
def legal_params(fx: Fixtures) -> DataFrame:
    p = fx.plots.filter((F.col("w") > 44) & (F.col("h") > 44)).select(
        "layout_id", "plot_no", g.legal_params(F.col("w") * F.col("h")).alias("l")
    )
    return p.select("layout_id", "plot_no", "l.density", r4(F.col("l.max_build_m2"), "max_build_m2"))


@query(
    "g12_clip_convex",
    """SELECT layout_id, plot_no, greatest(0.0, least(x+w,350)-greatest(x,50))*greatest(0.0, least(y+h,300)-greatest(y,40))
       AS clipped_sqm FROM plots""",
)
def clip_convex(fx: Fixtures) -> DataFrame:
    cut = g.clip_convex(F.col("ring"), g.rect_planes(50, 40, 350, 300))
    return plots_with_ring(fx).select("layout_id", "plot_no", r4(g.area(cut), "clipped_sqm"))


@query(
    "g13_intersection_area",
    f"""SELECT p.layout_id, plot_no, round({o.site_overlap('p', 's')},4) AS inside_sqm
        FROM plots p JOIN layouts l USING (layout_id) JOIN sites s ON s.site_id=l.site_id""",
)
def intersection_area(fx: Fixtures) -> DataFrame:
    return plots_in_sites(fx).select(
        "layout_id", "plot_no", r4(g.intersection_area(F.col("ring"), F.col("site")), "inside_sqm")
    )


@query(
    "g14_distance",
    f"""SELECT p.layout_id, p.plot_no, r.road_no, round({o.gap('p', 'q')},4) AS next_plot_m, round({o.road_gap('p', 'r')},4) AS road_m
        FROM plots p JOIN plots q ON q.layout_id=p.layout_id AND q.plot_no=p.plot_no+1
        JOIN layouts l ON l.layout_id=p.layout_id JOIN roads r ON r.site_id=l.site_id""",
)
def distance(fx: Fixtures) -> DataFrame:
    p = plots_with_ring(fx).select("layout_id", "plot_no", "ring")
    nxt = p.select("layout_id", (F.col("plot_no") - 1).alias("plot_no"), F.col("ring").alias("next_ring"))
    road = fx.roads.select(
        "site_id", "road_no", g.ring_of((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))).alias("path")
    )
    return (
        p.join(nxt, ["layout_id", "plot_no"]).join(fx.layouts, "layout_id").join(road, "site_id")
        .select(
            "layout_id", "plot_no", "road_no", r4(g.ring_distance(F.col("ring"), F.col("next_ring")), "next_plot_m"),
            r4(g.ring_path_distance(F.col("ring"), F.col("path")), "road_m"),
        )
    )


@query(
    "g15_contains",
    f"""SELECT p.layout_id, plot_no, {o.site_contains('p', 's')} AS in_site,
        CASE WHEN p.x+p.w/2>s.w OR p.y+p.h/2>s.h THEN false WHEN s.concave THEN NOT (p.x+p.w/2>s.w/2 AND p.y+p.h/2>s.h/2)
             ELSE p.x+p.w/2+p.y+p.h/2<=s.w+s.h-s.cut END AS centre_in_site
        FROM plots p JOIN layouts l USING (layout_id) JOIN sites s ON s.site_id=l.site_id""",
)
def contains(fx: Fixtures) -> DataFrame:
    x, y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return plots_in_sites(fx).select(
        "layout_id", "plot_no", g.ring_contains(F.col("site"), F.col("ring")).alias("in_site"),
        g.contains_point(F.col("site"), x, y).alias("centre_in_site"),
    )


@query(
    "g16_clip_line",
    """SELECT * FROM (SELECT asset_id, 0.0::DOUBLE AS xa,
       CASE WHEN concave THEN CASE WHEN ly<s.h/2 THEN s.w ELSE s.w/2 END ELSE least(s.w, s.w+s.h-cut-ly) END AS xb, ly AS y_line
       FROM (SELECT *, y+h/2+0.25 AS ly FROM assets) a JOIN sites s USING (site_id) WHERE ly<s.h)""",
)
def clip_line(fx: Fixtures) -> DataFrame:
    a = spread(fx.assets.select("asset_id", "site_id", (F.col("y") + F.col("h") / 2 + 0.25).alias("ly")), "asset_id")
    s = sites_with_ring(fx).select("site_id", "ring", "w")
    part = g.longest_part(
        g.clip_segment(g.pt(-100, F.col("ly")), g.pt(F.col("w") + 100, F.col("ly")), F.col("ring"))
    )
    j = a.join(s, "site_id").select("asset_id", "ly", part.alias("part")).filter(F.col("part").isNotNull())
    return j.select(
        "asset_id", r4(F.col("part")[0].x, "xa"), r4(F.col("part")[1].x, "xb"), r4(F.col("part")[0].y, "y_line")
    )


@query(
    "g17_interpolate_nearest",
    """SELECT asset_id, round(CASE WHEN d<=s.w THEN d ELSE s.w END,4) AS px, round(CASE WHEN d<=s.w THEN 0 ELSE least(d-s.w,s.h) END,4) AS py,
       round(CASE WHEN least(greatest(px0,0),s.w)=s.w THEN s.w WHEN py0 <= s.w-px0 THEN px0 ELSE s.w END,4) AS nx,
       round(CASE WHEN px0>=s.w OR py0 > s.w-px0 THEN least(greatest(py0,0),s.h) ELSE 0 END,4) AS ny
       FROM (SELECT *, (asset_id*17%900)::DOUBLE AS d, x+w/2 AS px0, y+h/2 AS py0 FROM assets) a JOIN sites s USING (site_id)""",
)
def interpolate_nearest(fx: Fixtures) -> DataFrame:
    s = fx.sites.select("site_id", g.ring_of((0, 0), (F.col("w"), 0), (F.col("w"), F.col("h"))).alias("path"))
    centre = g.pt(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    j = fx.assets.join(s, "site_id").select(
        "asset_id", g.interpolate(F.col("path"), (F.col("asset_id") * 17 % 900).cast("double")).alias("p"),
        g.nearest_point(F.col("path"), centre).alias("n"),
    )
    return j.select("asset_id", r4(F.col("p.x"), "px"), r4(F.col("p.y"), "py"), r4(F.col("n.x"), "nx"), r4(F.col("n.y"), "ny"))


@query(
    "g18_road_strip",
    """SELECT site_id, road_no, round((x2-x1+y2-y1)*(width_m+6),4) AS strip_sqm,
       CASE WHEN y1=y2 THEN x1 ELSE x1-(width_m+6)/2 END AS minx, CASE WHEN y1=y2 THEN y1-(width_m+6)/2 ELSE y1 END AS miny,
       CASE WHEN y1=y2 THEN x2 ELSE x2+(width_m+6)/2 END AS maxx, CASE WHEN y1=y2 THEN y2+(width_m+6)/2 ELSE y2 END AS maxy
       FROM roads""",
)
def road_strip(fx: Fixtures) -> DataFrame:
    path = g.ring_of((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    sidewalks = F.lit(2 * 3.0)
    strip = fx.roads.select(
        "site_id", "road_no", F.explode(g.road_strips(path, F.col("width_m") + sidewalks)).alias("strip")
    ).withColumn("b", g.bounds(F.col("strip")))
    return strip.select(
        "site_id", "road_no", r4(g.signed_area(F.col("strip")), "strip_sqm"), r4(F.col("b.minx"), "minx"),
        r4(F.col("b.miny"), "miny"), r4(F.col("b.maxx"), "maxx"), r4(F.col("b.maxy"), "maxy"),
    )


@query(
    "g19_inset",
    """SELECT site_id, 5 AS n_vertices, round((w-20)*(h-20)-pow(cut-20+10*sqrt(2.0),2)/2,4) AS buildable_sqm
       FROM sites WHERE NOT concave""",
)
def inset(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).filter("not concave").select("site_id", g.inset(F.col("ring"), 10).alias("inner"))
    return s.select("site_id", F.size("inner").alias("n_vertices"), r4(g.area(F.col("inner")), "buildable_sqm"))


@query(
    "g20_fillet_chamfer",
    """SELECT site_id, 10 AS fillet_n, round(w/4-r,4) AS fx1, round(h/4,4) AS fy1, round(w/4,4) AS fx8, round(h/4+r,4) AS fy8,
       round(w/4-r + 0.75*h-r + r*sqrt(2.0),4) AS fillet_m, 4 AS chamfer_n, round(w/4-5 + 0.75*h-5 + 5*sqrt(2.0),4) AS chamfer_m
       FROM (SELECT *, least(60.0, 0.4*least(w/4, 0.75*h)) AS r FROM sites)""",
)
def fillet_chamfer(fx: Fixtures) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    path = g.ring_of((0, h / 4), (w / 4, h / 4), (w / 4, h))
    s = fx.sites.select(
        "site_id", g.fillet(path, radius=60.0).alias("f"), g.chamfer(path, length=5.0).alias("c")
    )
    return s.select(
        "site_id", F.size("f").alias("fillet_n"), r4(F.col("f")[1].x, "fx1"), r4(F.col("f")[1].y, "fy1"),
        r4(F.col("f")[8].x, "fx8"), r4(F.col("f")[8].y, "fy8"), r4(g.path_length(F.col("f")), "fillet_m"),
        F.size("c").alias("chamfer_n"), r4(g.path_length(F.col("c")), "chamfer_m"),
    )


@query(
    "g21_drop_collinear",
    """SELECT layout_id, plot_no, 4 AS n_vertices, w*h AS area_sqm FROM plots""",
)
def drop_collinear(fx: Fixtures) -> DataFrame:
    x, y, w, h = (F.col(k) for k in "xywh")
    ring = g.ring_of(
        (x, y), (x + w / 2, y + 0.05), (x + w, y), (x + w, y + h / 2), (x + w, y + h), (x, y + h), (x, y + h / 4)
    )
    p = fx.plots.select("layout_id", "plot_no", g.drop_collinear(ring).alias("ring"))
    return p.select(
        "layout_id", "plot_no", F.size("ring").alias("n_vertices"), r4(g.area(F.col("ring")), "area_sqm")
    )
