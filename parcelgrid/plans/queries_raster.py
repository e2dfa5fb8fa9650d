"""Registered queries over rasters and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelgrid.fixtures import Fixtures, sites_with_ring
from parcelgrid.functions import geometry as g
from parcelgrid.operators import arrangement as ar, raster as ra, tiles as ti
from parcelgrid.operators.sweeps import road_spacing_sweep
from parcelgrid.plans import oracle_forms as o
from parcelgrid.plans.queries_generate import convex_sites
from parcelgrid.plans.queries_network import asset_points
from parcelgrid.plans.registry import query, r4


def _raster(size: int, where: str = "true") -> str:
    return f"""
    rc AS (SELECT site_id, i, j, (i+0.5)*{size} AS px, (j+0.5)*{size} AS py FROM sites, LATERAL (SELECT unnest(range(ceil(w/{size})::BIGINT)) AS i) a,
      LATERAL (SELECT unnest(range(ceil(h/{size})::BIGINT)) AS j) b WHERE {where} AND (i+0.5)*{size}<=w AND (j+0.5)*{size}<=h AND
      CASE WHEN concave THEN (i+0.5)*{size}<=w/2 OR (j+0.5)*{size}<=h/2 ELSE (i+0.5)*{size}+(j+0.5)*{size}<=w+h-cut END)
    """


_DIST = "sqrt(pow(greatest(0,px-r.x2,r.x1-px),2)+pow(greatest(0,py-r.y2,r.y1-py),2))"


#: Distance of a cell centre to a road of any direction.
_DIST = """sqrt(pow(px-(r.x1+t*(r.x2-r.x1)),2)+pow(py-(r.y1+t*(r.y2-r.y1)),2))"""
_FAR = """st AS (SELECT * FROM roads UNION ALL SELECT site_id, 3, 'internal', 3*w/4, 0.0, w-20, h/3, 8.0 FROM sites),
  fa AS (SELECT * FROM rc WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, greatest(0,least(1,((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2)))) AS t FROM st WHERE st.site_id=rc.site_id) r WHERE """


def slanted_roads(fx: Fixtures) -> DataFrame:
    """The roads of a site and one across the corner of the far side."""
    slant = fx.sites.select(
        "site_id", F.lit(3).cast("long").alias("road_no"), F.lit("internal").alias("road_class"), (F.col("w") * 3 / 4).alias("x1"),
        F.lit(0.0).alias("y1"), (F.col("w") - 20).alias("x2"), (F.col("h") / 3).alias("y2"), F.lit(8.0).alias("width_m"),
    )
    return fx.roads.unionByName(slant)


@query(
    "j7_dead_zones",
    _raster(20) + "," + _FAR + f"""round({_DIST},6)<=100)),
    nb AS (SELECT a.site_id, a.i, a.j, b.i AS i2, b.j AS j2 FROM fa a JOIN fa b ON a.site_id=b.site_id AND abs(a.i-b.i)+abs(a.j-b.j)=1),
    lb AS (SELECT site_id, i, j, i*1048576+j AS c FROM fa UNION SELECT nb.site_id, i2, j2, c FROM lb JOIN nb ON nb.site_id=lb.site_id AND nb.i=lb.i AND nb.j=lb.j AND c<nb.i2*1048576+nb.j2)
    SELECT site_id, part, count(*)*400.0::DOUBLE AS area_sqm FROM (SELECT site_id, i, j, min(c) AS part FROM lb GROUP BY 1,2,3) GROUP BY 1,2""",
)
def dead_zones(fx: Fixtures) -> DataFrame:
    return ra.dead_zones(sites_with_ring(fx), slanted_roads(fx), 100.0, size=20.0).select("site_id", "part", "area_sqm")


@query(
    "j11_buildable_area",
    _raster(10) + """, bl AS (SELECT site_id, count(*)*100.0::DOUBLE AS b FROM rc WHERE EXISTS (SELECT 1 FROM site_constraints c WHERE c.site_id=rc.site_id AND is_hard AND sqrt(pow(greatest(0,px-(x+w),x-px),2)+pow(greatest(0,py-(y+h),y-py),2))<=buffer_m) GROUP BY 1)
    SELECT site_id, coalesce(b,0) AS blocked_sqm, CASE WHEN concave THEN 0.75*w*h ELSE w*h-cut*cut/2 END-coalesce(b,0) AS buildable_sqm FROM sites LEFT JOIN bl USING (site_id)""",
)
def buildable_area(fx: Fixtures) -> DataFrame:
    b = ra.buildable_area(sites_with_ring(fx), fx.site_constraints, size=10.0)
    return b.select("site_id", "blocked_sqm", r4(F.col("buildable_sqm"), "buildable_sqm"))


@query(
    "a13_green_remainder",
    _raster(20) + f""", tk AS (SELECT site_id, x, y, w, h FROM assets UNION ALL
      SELECT site_id, CASE WHEN road_no=1 THEN x1 ELSE x1-width_m/2 END-2, CASE WHEN road_no=1 THEN y1-width_m/2 ELSE y1 END-2, CASE WHEN road_no=1 THEN x2-x1 ELSE width_m END+4, CASE WHEN road_no=1 THEN width_m ELSE y2-y1 END+4 FROM roads),
    inn AS (SELECT c.site_id, c.px, c.py FROM (SELECT site_id, px, py, px AS x, py AS y, 0.0 AS w, 0.0 AS h FROM rc) c JOIN sites s USING (site_id) WHERE {o.site_contains('c', 's', '25.0')}),
    fa AS (SELECT * FROM inn WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.site_id=inn.site_id AND px BETWEEN x AND x+w AND py BETWEEN y AND y+h))
    SELECT site_id, count(*)*400.0::DOUBLE AS green_sqm FROM fa GROUP BY 1""",
)
def green_remainder(fx: Fixtures) -> DataFrame:
    path = g.ring_of((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    strips = fx.roads.select("site_id", F.explode(g.road_strips(path, F.col("width_m"))).alias("ring"))
    parts = ra.green_remainder(sites_with_ring(fx), fx.assets, strips, size=20.0, setback=25.0)
    return parts.groupBy("site_id").agg(F.sum("area_sqm").alias("green_sqm"))


@query(
    "a15_union_area",
    """cl AS (SELECT DISTINCT layout_id, i, j FROM plots, LATERAL (SELECT unnest(range(floor(x/20+0.5)::BIGINT, floor((x+w)/20+0.5)::BIGINT)) AS i) a, LATERAL (SELECT unnest(range(floor(y/20+0.5)::BIGINT, floor((y+h)/20+0.5)::BIGINT)) AS j) b)
       SELECT layout_id, count(*)*400.0::DOUBLE AS area_sqm FROM cl GROUP BY 1""",
)
def union_area(fx: Fixtures) -> DataFrame:
    return ra.union_area(fx.plots, ["layout_id"], 20.0)


@query(
    "a15_dissolve",
    """q AS (SELECT layout_id, plot_no, x+plot_no/8.0 AS x0, y+plot_no/16.0 AS y0, x+plot_no/8.0+w AS x1, y+plot_no/16.0+h AS y1 FROM plots),
       touch AS (SELECT a.layout_id, a.plot_no AS p, b.plot_no AS r FROM q a JOIN q b USING (layout_id)
         WHERE least(a.x1,b.x1)>=greatest(a.x0,b.x0) AND least(a.y1,b.y1)>=greatest(a.y0,b.y0) AND (least(a.x1,b.x1)>greatest(a.x0,b.x0) OR least(a.y1,b.y1)>greatest(a.y0,b.y0))),
       walk AS (SELECT layout_id, plot_no AS p, plot_no AS low FROM q UNION SELECT w.layout_id, t.r, w.low FROM walk w JOIN touch t ON t.layout_id=w.layout_id AND t.p=w.p),
       part AS (SELECT layout_id, p AS plot_no, min(low) AS part FROM walk GROUP BY 1,2),
       m AS (SELECT q.*, part FROM q JOIN part USING (layout_id, plot_no)),
       xs AS (SELECT *, lead(v) OVER (PARTITION BY layout_id, part ORDER BY v) AS nv FROM (SELECT DISTINCT layout_id, part, unnest([x0,x1]) AS v FROM m)),
       ys AS (SELECT *, lead(v) OVER (PARTITION BY layout_id, part ORDER BY v) AS nv FROM (SELECT DISTINCT layout_id, part, unnest([y0,y1]) AS v FROM m)),
       cells AS (SELECT DISTINCT m.layout_id, m.part, xs.v AS cx, xs.nv AS dx, ys.v AS cy, ys.nv AS dy FROM m
         JOIN xs ON xs.layout_id=m.layout_id AND xs.part=m.part AND xs.v>=m.x0 AND xs.nv<=m.x1 JOIN ys ON ys.layout_id=m.layout_id AND ys.part=m.part AND ys.v>=m.y0 AND ys.nv<=m.y1)
       SELECT layout_id, round(sum((dx-cx)*(dy-cy))::DOUBLE,4) AS area_sqm FROM cells GROUP BY layout_id, part""",
)
def dissolve_plots(fx: Fixtures) -> DataFrame:
    """Merged outlines of the plots of a layout, moved off the raster: one row for each part."""
    moved = g.rect_ring(F.col("x") + F.col("plot_no") / 8.0, F.col("y") + F.col("plot_no") / 16.0, F.col("w"), F.col("h"))
    parts = fx.plots.select("layout_id", "plot_no", moved.alias("ring"))
    return ar.dissolve(parts, ["layout_id"], "plot_no", cell_m=400.0).select("layout_id", r4(F.col("area_sqm"), "area_sqm"))


@query(
    "e20_nearest_seed_regions",
    _raster(20) + """, pt AS (SELECT site_id, asset_id AS node, x+w/2 AS sx, y+h/2 AS sy FROM assets)
    SELECT site_id, i::INT AS i, j::INT AS j, arg_min(node, [round(sqrt(pow(px-sx,2)+pow(py-sy,2)),6), node]) AS seed FROM rc JOIN pt USING (site_id) GROUP BY 1,2,3
    UNION ALL SELECT site_id, i::INT, j::INT, NULL FROM rc WHERE site_id NOT IN (SELECT site_id FROM pt)""",
)
def nearest_seed_regions(fx: Fixtures) -> DataFrame:
    return ra.nearest_seed_regions(ra.site_cells(sites_with_ring(fx), 20.0), asset_points(fx), 100.0).drop("d")


@query(
    "e20_region_borders",
    _raster(20) + """, pt AS (SELECT site_id, asset_id AS node, x+w/2 AS sx, y+h/2 AS sy FROM assets),
    reg AS (SELECT site_id, i::INT AS i, j::INT AS j, arg_min(node, [round(sqrt(pow(px-sx,2)+pow(py-sy,2)),6), node]) AS seed FROM rc JOIN pt USING (site_id) GROUP BY 1,2,3)
    SELECT a.site_id, b.i, b.j, a.seed, 'x' AS axis, b.seed AS other FROM reg a JOIN reg b ON b.site_id=a.site_id AND b.i=a.i+1 AND b.j=a.j WHERE a.seed<>b.seed
    UNION ALL SELECT a.site_id, b.i, b.j, a.seed, 'y', b.seed FROM reg a JOIN reg b ON b.site_id=a.site_id AND b.j=a.j+1 AND b.i=a.i WHERE a.seed<>b.seed""",
)
def region_borders(fx: Fixtures) -> DataFrame:
    return ra.region_borders(nearest_seed_regions(fx))


@query(
    "a12_sweep_road_spacing",
)
def sweep_road_spacing(fx: Fixtures) -> DataFrame:
    return road_spacing_sweep(convex_sites(fx).select("site_id", "ring"), max_distance=100.0, setback=20.0)


# tiles of this query: id, edges north, east, south, west
TILES = [
    (0, "empty", "empty", "empty", "empty"),
    (1, "road", "empty", "road", "empty"),
    (2, "road", "road", "road", "road"),
    (3, "building", "building", "building", "building"),
    (4, "fence", "building", "fence", "building"),
    (5, "green", "green", "green", "green"),
    (6, "parking", "road", "parking", "road"),
    (7, "empty", "green", "empty", "green"),
]
_TILES = "tl(tile_id, n, e, s, w) AS (VALUES " + ", ".join(str(t) for t in TILES) + ")\n"


def tiles(fx: Fixtures) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t[0]).alias("tile_id"), *[F.lit(v).alias(f"edge_{s}") for v, s in zip(t[1:], ti.SIDES)]) for t in TILES])
    return fx.spark.range(1).select(F.inline(rows))


_GRID = "gd AS (SELECT layout_id%1000 AS site_id, layout_id//1000 AS row, plot_no AS col, ((layout_id*7+plot_no*3)%8)::INT AS tile_id FROM plots)\n"


def tile_cells(fx: Fixtures) -> DataFrame:
    return fx.plots.select(
        (F.col("layout_id") % 1000).alias("site_id"), F.expr("layout_id div 1000").alias("row"), F.col("plot_no").alias("col"),
        ((F.col("layout_id") * 7 + F.col("plot_no") * 3) % 8).cast("int").alias("tile_id"),
    )


@query(
    "j9_tile_compatibility",
    _TILES + "," + _GRID + """, c AS (SELECT a.tile_id, 'n' AS side, b.tile_id AS other FROM tl a JOIN tl b ON a.n=b.s UNION ALL SELECT a.tile_id, 's', b.tile_id FROM tl a JOIN tl b ON a.s=b.n
     UNION ALL SELECT a.tile_id, 'e', b.tile_id FROM tl a JOIN tl b ON a.e=b.w UNION ALL SELECT a.tile_id, 'w', b.tile_id FROM tl a JOIN tl b ON a.w=b.e)
     SELECT site_id, row, col, side, count(*) AS n_fitting FROM gd JOIN c USING (tile_id) GROUP BY ALL""",
)
def tile_compatibility(fx: Fixtures) -> DataFrame:
    c = ti.tile_compatibility(tiles(fx)).groupBy("tile_id", "side").agg(F.count("*").alias("n_fitting"))
    return tile_cells(fx).join(F.broadcast(c), "tile_id").select("site_id", "row", "col", "side", "n_fitting")


@query(
    "j10_tile_adjacency_audit",
    _TILES + "," + _GRID + """, ne AS (SELECT a.site_id, b.row, b.col, 'e' AS side, a.tile_id, b.tile_id AS other FROM gd a JOIN gd b ON a.site_id=b.site_id AND a.row=b.row AND b.col=a.col+1
     UNION ALL SELECT a.site_id, b.row, b.col, 'n', a.tile_id, b.tile_id FROM gd a JOIN gd b ON a.site_id=b.site_id AND b.row=a.row+1 AND a.col=b.col)
     SELECT ne.* FROM ne JOIN tl a ON a.tile_id=ne.tile_id JOIN tl b ON b.tile_id=ne.other WHERE CASE side WHEN 'e' THEN a.e<>b.w ELSE a.n<>b.s END""",
)
def tile_adjacency_audit(fx: Fixtures) -> DataFrame:
    return ti.adjacency_audit(tile_cells(fx), tiles(fx)).select("site_id", "row", "col", "side", "tile_id", "other")


@query(
    "j10_kind_areas",
    _GRID + """, kd AS (SELECT t AS tile_id, CASE WHEN t IN (1,2) THEN 'road' WHEN t IN (3,4) THEN 'building' WHEN t=5 THEN 'green' WHEN t=6 THEN 'parking' ELSE 'empty' END AS kind FROM (SELECT unnest(range(8)) AS t)),
    have AS (SELECT site_id, kind, count(*) AS n FROM gd JOIN kd USING (tile_id) GROUP BY 1,2)
    SELECT s.site_id, k.kind, coalesce(n,0) AS n_cells, coalesce(n,0)*225.0::DOUBLE AS area_sqm FROM (SELECT DISTINCT site_id FROM gd) s CROSS JOIN (SELECT DISTINCT kind FROM kd) k LEFT JOIN have h ON h.site_id=s.site_id AND h.kind=k.kind""",
)
def tile_kind_areas(fx: Fixtures) -> DataFrame:
    names = ["empty", "road", "road", "building", "building", "green", "parking", "empty"]
    kinds = tiles(fx).select("tile_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tile_id") + 1).alias("kind"))
    return ti.kind_areas(tile_cells(fx), kinds, 15.0)


@query(
    "j9_turned_tiles",
    _TILES + "," + _GRID + """, rt AS (SELECT layout_id, plot_no, tile_id, (layout_id%4)::INT AS quarter FROM (SELECT layout_id, plot_no, ((layout_id*7+plot_no*3)%8)::INT AS tile_id FROM plots))
    SELECT layout_id, plot_no, CASE quarter WHEN 0 THEN n WHEN 1 THEN w WHEN 2 THEN s ELSE e END AS edge_n, CASE quarter WHEN 0 THEN e WHEN 1 THEN n WHEN 2 THEN w ELSE s END AS edge_e,
      CASE quarter WHEN 0 THEN s WHEN 1 THEN e WHEN 2 THEN n ELSE w END AS edge_s, CASE quarter WHEN 0 THEN w WHEN 1 THEN s WHEN 2 THEN e ELSE n END AS edge_w FROM rt JOIN tl USING (tile_id)""",
)
def turned_tiles(fx: Fixtures) -> DataFrame:
    placed = fx.plots.select(
        "layout_id", "plot_no", ((F.col("layout_id") * 7 + F.col("plot_no") * 3) % 8).cast("int").alias("tile_id"),
        (F.col("layout_id") % 4).cast("int").alias("quarter"),
    ).join(F.broadcast(tiles(fx)), "tile_id")
    turned = ti.rotate_tile(placed, F.col("quarter"))
    return turned.select("layout_id", "plot_no", *[f"edge_{s}" for s in ti.SIDES])
