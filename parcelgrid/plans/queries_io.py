"""Registered queries over sources, sinks, registries and the batch twins of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.fixtures import VIEWS, Fixtures, sites_with_ring
from parcelgrid.functions import geometry as g, registry as rg
from parcelgrid.plans.queries_geometry import plots_with_ring
from parcelgrid.plans.queries_rules import _GATE, ASSET_KEYWORDS, typed_assets
from parcelgrid.plans.registry import query, r4
from parcelgrid.session import shared_folder
from parcelgrid.sources import asset_text, dxf, geojson
from parcelgrid.streaming import jobs


def geojson_documents(fx: Fixtures) -> DataFrame:
    """One plan per site: outline (open ring on odd sites), a road, a two-part asset; every tenth site is empty."""
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    close = F.when(F.col("site_id") % 2 == 0, ",[0,0]").otherwise("")
    text = F.format_string(
        '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,%1$d],[%2$d,%1$d]]},"properties":{"id":"R1"}},'
        '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[%2$d,0],[%2$d,%3$d],[0,%3$d]%4$s]]},"properties":{"id":"S"}},'
        '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[10,0],[10,10],[0,10],[0,0]]],[[[20,20],[50,20],[50,60],[20,60],[20,20]]]]},'
        '"properties":{"role":"asset","id":"A"}}]}',
        (h / 4).cast("int"), w, h, close,
    )
    value = F.when(F.col("site_id") % 10 == 9, '{"type":"FeatureCollection","features":[]}').otherwise(text)
    return fx.sites.select(F.col("site_id").cast("string").alias("path"), value.alias("value"))


@query(
    "io1_read_geojson",
    """SELECT site_id::VARCHAR AS path, f::INT AS feature_no, CASE f WHEN 0 THEN 'road' WHEN 1 THEN 'boundary' WHEN 2 THEN 'asset' ELSE 'none' END AS role,
       CASE f WHEN 0 THEN w WHEN 1 THEN w*h WHEN 2 THEN 1200 ELSE 0 END AS size, '' AS error FROM sites, (SELECT unnest([0,1,2]) AS f) WHERE site_id%10<>9
       UNION ALL SELECT site_id::VARCHAR, -1, 'none', 0, 'empty document' FROM sites WHERE site_id%10=9""",
)
def read_geojson(fx: Fixtures) -> DataFrame:
    f = geojson.parse_geojson(geojson_documents(fx))
    size = F.coalesce(g.area(F.col("ring")), g.path_length(F.col("line")), F.lit(0.0))
    return f.select(
        "path", F.coalesce("feature_no", F.lit(-1)).alias("feature_no"), F.coalesce("role", F.lit("none")).alias("role"),
        size.alias("size"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "io2_read_project_json",
    """SELECT asset_id::VARCHAR AS asset_id, 0 AS part_no, w*h AS area_sqm FROM assets UNION ALL SELECT asset_id::VARCHAR, 1, 100.0 FROM assets WHERE asset_id%2=0""",
)
def read_project_json(fx: Fixtures) -> DataFrame:
    x, y, x2, y2 = (c.cast("int") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    ring = F.format_string("[[%1$d,%2$d],[%3$d,%2$d],[%3$d,%4$d],[%1$d,%4$d]]", x, y, x2, y2)
    asset = F.when(
        F.col("asset_id") % 2 == 0,
        F.concat(F.lit('"polygons":[{"name":"a","coordinates":'), ring, F.lit('},{"name":"b","coordinates":[[0,0],[10,0],[10,10],[0,10]]}]')),
    ).otherwise(F.concat(F.lit('"coordinates":'), ring))
    value = F.concat(
        F.lit('{"project_name":"p","boundary":{"area_m2":1.0,"coordinates":[[0,0],[1,0],[1,1]]},"assets":[{"asset_id":"'),
        F.col("asset_id").cast("string"), F.lit('","type":"t",'), asset, F.lit("}]}"),
    )
    docs = fx.assets.select(F.col("asset_id").cast("string").alias("path"), value.alias("value"))
    p = geojson.parse_project_json(docs)
    return p.select("asset_id", "part_no", g.area(F.col("ring")).alias("area_sqm"))


def dxf_documents(fx: Fixtures) -> DataFrame:
    """Outline as a closed polyline, except on every third site, where it is four loose lines; one road line."""
    w, h = F.col("w"), F.col("h")
    corners = [g.pt(0, 0), g.pt(w, F.lit(0.0)), g.pt(w, h), g.pt(F.lit(0.0), h)]
    lot = F.lit("LOTS")
    loose = F.concat(*[dxf.line_text(lot, corners[i], corners[(i + 1) % 4]) for i in (0, 2, 1, 3)])
    outline = F.when(F.col("site_id") % 3 == 0, loose).otherwise(dxf.polyline_text(lot, F.array(*corners)))
    road = F.when(F.col("site_id") % 3 == 0, "").otherwise(
        dxf.line_text(F.lit("ROADS"), g.pt(F.lit(0.0), h / 4), g.pt(w, h / 4))
    )
    old = F.lit(
        "0\nPOLYLINE\n8\nOLD\n66\n1\n10\n0.0\n20\n0.0\n70\n0\n0\nVERTEX\n8\nOLD\n10\n5.0\n20\n6.0\n0\nVERTEX\n8\nOLD\n10\n8.0\n20\n10.0\n0\nSEQEND\n"
    )
    value = F.concat(F.lit(dxf.HEADER), outline, road, old, F.lit(dxf.FOOTER))
    return fx.sites.select(F.col("site_id").cast("string").alias("path"), value.alias("value"))


@query(
    "io3_read_dxf_entities",
    """SELECT site_id::VARCHAR AS path, 'LINE' AS kind, CASE WHEN site_id%3=0 THEN 'LOTS' ELSE 'ROADS' END AS layer, false AS is_closed, CASE WHEN site_id%3=0 THEN 4 ELSE 1 END::BIGINT AS n,
       CASE WHEN site_id%3=0 THEN 2*(w+h) ELSE w END AS length_m FROM sites
     UNION ALL SELECT site_id::VARCHAR, 'LWPOLYLINE', 'LOTS', true, 1, 2*w+h FROM sites WHERE site_id%3<>0 UNION ALL SELECT site_id::VARCHAR, 'POLYLINE', 'OLD', false, 1, 5 FROM sites""",
)
def read_dxf_entities(fx: Fixtures) -> DataFrame:
    e = dxf.parse_dxf(dxf_documents(fx))
    return e.groupBy("path", "kind", "layer", "is_closed").agg(
        F.count("*").alias("n"), r4(F.sum(g.path_length(F.col("points"))), "length_m")
    )


@query(
    "io4_dxf_boundary_and_roads",
    """SELECT site_id::VARCHAR AS path, 'boundary' AS role, 1::BIGINT AS n, w*h AS area_sqm FROM sites
       UNION ALL SELECT site_id::VARCHAR, 'road', CASE WHEN site_id%3=0 THEN 5 ELSE 2 END, 0 FROM sites""",
)
def dxf_boundary_and_roads(fx: Fixtures) -> DataFrame:
    b = dxf.boundary_and_roads(dxf.parse_dxf(dxf_documents(fx)))
    return b.groupBy("path", "role").agg(F.count("*").alias("n"), r4(F.sum("area_sqm"), "area_sqm"))


def loose_drawings(fx: Fixtures) -> DataFrame:
    """Lines in no order: an outline whose ends miss each other across a rounding border, a crossroads, two asset
    boxes that touch in a corner on every fourth site and lie apart on the others, and a line on its own."""
    w, h = F.col("w"), F.col("h")
    out, n = F.lit("LOTS"), F.lit(0.0)
    off = [F.lit(0.004), F.lit(0.006)]
    sides = [
        dxf.line_text(out, g.pt(w + off[1], h), g.pt(n, h)), dxf.line_text(out, g.pt(n, n), g.pt(w + off[0], n)),
        dxf.line_text(out, g.pt(n, h), g.pt(n, n)), dxf.line_text(out, g.pt(w + off[1], n), g.pt(w + off[0], h)),
    ]
    cross = [dxf.line_text(F.lit("ROADS"), g.pt(w / 2, h / 2), g.pt(w / 2 + dx, h / 2 + dy)) for dx, dy in ((90, 0), (-90, 0), (0, 90), (0, -90))]

    def box(x: Column, y: float, size: float) -> list[Column]:
        c = [g.pt(x, F.lit(y)), g.pt(x + size, F.lit(y)), g.pt(x + size, F.lit(y + size)), g.pt(x, F.lit(y + size))]
        return [dxf.line_text(out, c[i], c[(i + 1) % 4]) for i in (2, 0, 3, 1)]

    apart = F.when(F.col("site_id") % 4 == 0, 30.0).otherwise(35.0)
    alone = dxf.line_text(out, g.pt(F.lit(1000.0), n), g.pt(F.lit(1010.0), n))
    value = F.concat(F.lit(dxf.HEADER), *sides, *cross, *box(F.lit(10.0), 10.0, 20.0), *box(apart, 30.0, 20.0), alone, F.lit(dxf.FOOTER))
    return fx.sites.select(F.col("site_id").cast("string").alias("path"), value.alias("value"))


@query(
    "io5_assemble_rings",
    """SELECT site_id::VARCHAR AS path, status, n_lines, round(CASE k WHEN 0 THEN (w+0.004)*h ELSE a END::DOUBLE, 4) AS area_sqm FROM sites, (VALUES (0, 'ring', 4::BIGINT, 0.0), (1, 'open', 4, 0), (2, 'open', 1, 0)) v(k, status, n_lines, a)
       UNION ALL SELECT site_id::VARCHAR, 'ring', 4, 400 FROM sites, (SELECT unnest(range(2))) WHERE site_id%4<>0
       UNION ALL SELECT site_id::VARCHAR, 'open', 8, 0 FROM sites WHERE site_id%4=0""",
)
def assemble_rings(fx: Fixtures) -> DataFrame:
    r = dxf.assemble_rings(dxf.parse_dxf(loose_drawings(fx)))
    return r.select("path", "status", "n_lines", r4(F.coalesce(g.area(F.col("ring")), F.lit(0.0)), "area_sqm"))


@query(
    "io11_dxf_summary",
    """SELECT site_id::VARCHAR AS path, (site_id%3<>0)::BIGINT AS n_lwpolyline, (site_id%3<>0)::BIGINT AS n_closed, 1::BIGINT AS n_polyline, CASE WHEN site_id%3=0 THEN 4 ELSE 1 END::BIGINT AS n_line, true AS is_valid FROM sites
       UNION ALL SELECT 'empty-'||site_id, 0, 0, 0, 0, false FROM sites""",
)
def dxf_summary(fx: Fixtures) -> DataFrame:
    """Every drawing, and for every site one more without entities."""
    empty = fx.sites.select(F.concat(F.lit("empty-"), F.col("site_id").cast("string")).alias("path"), F.lit(dxf.HEADER + dxf.FOOTER).alias("value"))
    drawings = dxf_documents(fx).unionByName(empty)
    return dxf.summary(dxf.parse_dxf(drawings), drawings)


@query(
    "io6_parse_assets_from_text",
    """SELECT asset_id, 'add' AS action, CASE WHEN asset_id%17=0 THEN '' ELSE t END AS type, CASE WHEN asset_id%17=0 THEN 0 ELSE w END AS width_m, CASE WHEN asset_id%17=0 THEN 'bad json' ELSE '' END AS error
       FROM (SELECT *, ['factory_standard','warehouse_cold','office_hq','parking_lot','green_buffer','utility_station','internal_road'][kind_no+1] AS t FROM assets) WHERE asset_id%17=0 OR kind_no<>3""",
)
def parse_assets_from_text(fx: Fixtures) -> DataFrame:
    """Parking lots get an unknown type, every tenth text lacks a bracket, every seventeenth is broken."""
    a = typed_assets(fx)
    kind = F.when(F.col("kind_no") == 3, "swimming_pool").otherwise(F.col("type"))
    tail = F.when(F.col("asset_id") % 10 == 0, "}").otherwise("]}")
    obj = F.concat(
        F.lit('{"explanation":"x","new_assets":[{"type":"'), kind, F.lit('","polygon":[[0,0],['), F.col("w").cast("string"), F.lit(',0],[0,5]]}'), tail
    )
    body = F.when(F.col("asset_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```\nbye"))).otherwise(
        F.concat(F.lit("Here: "), obj, F.lit(" done"))
    )
    text = F.when(F.col("asset_id") % 17 == 0, "no object here").otherwise(body)
    p = asset_text.parse_assets_from_text(a.select("asset_id", text.alias("text")), "text", ASSET_KEYWORDS)
    return p.select(
        "asset_id", "action", F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce(F.col("polygon")[1][0], F.lit(0.0)).alias("width_m"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "io8_write_geojson",
    "SELECT layout_id, plot_no, 'plot_'||plot_no AS id, type, w*h AS area_sqm, 'asset' AS role FROM plots",
)
def write_geojson(fx: Fixtures) -> DataFrame:
    """Feature per plot as text, read back."""
    props = F.struct(
        F.concat(F.lit("plot_"), F.col("plot_no").cast("string")).alias("id"), F.col("type"), F.lit("asset").alias("role"),
    )
    lines = plots_with_ring(fx).select(
        F.concat_ws("/", F.col("layout_id").cast("string"), F.col("plot_no").cast("string")).alias("path"),
        geojson.feature_json(F.col("ring"), props).alias("value"),
    )
    f = geojson.parse_geojson(lines).filter("error is null")
    key = F.split("path", "/")
    return f.select(
        key[0].cast("long").alias("layout_id"), key[1].cast("long").alias("plot_no"), F.col("properties")["id"].alias("id"),
        F.col("properties")["type"].alias("type"), r4(g.area(F.col("ring")), "area_sqm"), F.col("properties")["role"].alias("role"),
    )


@query(
    "io9_write_dxf",
    """SELECT layout_id, plot_no, CASE type WHEN 'industrial' THEN 'LOTS' WHEN 'utility' THEN 'SERVICE' ELSE 'PARKS' END AS layer, w*h AS area_sqm FROM plots""",
)
def write_dxf(fx: Fixtures) -> DataFrame:
    """Polyline text per plot, read back through the reader."""
    kind = F.when(F.col("type") == "industrial", "lot").when(F.col("type") == "utility", "service").otherwise("park")
    docs = plots_with_ring(fx).select(
        F.concat_ws("/", F.col("layout_id").cast("string"), F.col("plot_no").cast("string")).alias("path"),
        dxf.polyline_text(dxf.layer_of(kind), F.col("ring")).alias("value"),
    )
    e = dxf.parse_dxf(docs)
    key = F.split("path", "/")
    return e.select(
        key[0].cast("long").alias("layout_id"), key[1].cast("long").alias("plot_no"), "layer", r4(g.area(F.col("points")), "area_sqm")
    )


@query(
    "io10_sites_from_coordinates",
    """SELECT site_id, CASE WHEN site_id%7=0 THEN 0 ELSE w*h END AS area_sqm, CASE WHEN site_id%7=0 THEN 0 ELSE (w-20)*(h-20) END AS buildable_sqm, CASE WHEN site_id%7=0 THEN 'need at least 3 points' ELSE '' END AS error FROM sites""",
)
def sites_from_coordinates(fx: Fixtures) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    full = g.ring_of((0, 0), (0, h), (w, h), (w, 0), (0, 0))
    rows = fx.sites.select("site_id", F.when(F.col("site_id") % 7 == 0, g.ring_of((0, 0), (w, h))).otherwise(full).alias("coords"))
    s = geojson.sites_from_coordinates(rows, 10.0)
    zero = F.lit(0.0)
    return s.select(
        "site_id", r4(F.coalesce("area_sqm", zero), "area_sqm"), r4(F.coalesce("buildable_sqm", zero), "buildable_sqm"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "u1_sql_functions",
    """SELECT layout_id, plot_no, round(50-0.02::DOUBLE*x-0.03::DOUBLE*y,4) AS z, CASE WHEN w*h<3000 THEN 0.70::DOUBLE WHEN w*h<10000 THEN 0.65::DOUBLE ELSE 0.60::DOUBLE END AS density,
       CASE WHEN w*h<2000 THEN 'unusable' WHEN w>=h THEN 'commercial' ELSE 'green_space' END AS cls FROM plots""",
)
def sql_functions(fx: Fixtures) -> DataFrame:
    rg.register(fx.spark)
    return fx.plots.selectExpr(
        "layout_id", "plot_no", "round(elevation_at(x, y), 4) AS z", "legal_density(w * h) AS density",
        "lot_class(w * h, w >= h, 2000D) AS cls",
    )


@query(
    "u1_action_registry",
    """SELECT design_id, edit_no, CASE action WHEN 'move' THEN dx+dy WHEN 'delete' THEN 0 ELSE -1 END AS value, CASE WHEN action IN ('move','delete') THEN '' ELSE 'unknown action '||action END AS error FROM edits""",
)
def action_registry(fx: Fixtures) -> DataFrame:
    known = {
        "move": lambda d: d.withColumn("value", F.col("dx") + F.col("dy")),
        "delete": lambda d: d.withColumn("value", F.lit(0.0)),
    }
    out = rg.run_actions(fx.edits, known)
    return out.select("design_id", "edit_no", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("error", F.lit("")).alias("error"))


@query(
    "st2_design_state",
    """SELECT design_id, target, sum(CASE WHEN action='move' THEN dx ELSE 0 END) AS dx, sum(CASE WHEN action='move' THEN dy ELSE 0 END) AS dy, bool_or(action='delete') AS deleted,
       bool_or(action='convert_to_green') AS to_green, count(*) AS n_edits FROM edits GROUP BY 1,2""",
)
def design_state(fx: Fixtures) -> DataFrame:
    return jobs.design_state(fx.edits).select("design_id", "target", "dx", "dy", "deleted", "to_green", "n_edits")


@query(
    "st1_asset_gate",
    _GATE + """SELECT site_id, asset_id, round(w*h,4) AS kept_sqm FROM assets WHERE is_existing UNION ALL
        SELECT site_id, asset_id, round(kept,4) FROM gate2 WHERE site_id IN (SELECT site_id FROM res WHERE n_errors=0)""",
)
def asset_gate(fx: Fixtures) -> DataFrame:
    """The stored assets after a stream has read all arriving ones; files that exist at the start are one batch."""
    folder = f"{shared_folder(fx.spark)}/gate-{uuid.uuid4().hex}"
    jobs.seed_assets(fx.spark, typed_assets(fx).filter("is_existing"), f"{folder}/store")
    parts = fx.spark.readStream.schema(fx.part.schema).parquet(f"{fx.sf_dir}/part.parquet*")
    arriving = fx.spark.sql(VIEWS["assets"], part=parts, supplier=fx.supplier)
    kinds = F.array(*[F.lit(k) for k in ASSET_KEYWORDS])
    arriving = arriving.withColumn("type", F.element_at(kinds, (F.col("kind_no") + 1).cast("int"))).filter("not is_existing")
    stream = jobs.start_asset_gate(arriving, sites_with_ring(fx), f"{folder}/store", f"{folder}/refused", f"{folder}/checkpoint")
    stream.awaitTermination()
    return jobs.current_assets(fx.spark, f"{folder}/store").select("site_id", "asset_id", r4(F.col("kept_sqm"), "kept_sqm"))


@query(
    "st3_session_activity",
    """g AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) < INTERVAL '2' MINUTE THEN 0 ELSE 1 END AS n FROM messages),
       s AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT session_id, epoch(min(created_at))::BIGINT AS started, count(*) AS n_messages FROM s GROUP BY session_id, k""",
)
def session_activity(fx: Fixtures) -> DataFrame:
    a = jobs.session_activity(fx.messages, gap="2 minutes")
    return a.select("session_id", F.unix_seconds("started_at").alias("started"), "n_messages")
