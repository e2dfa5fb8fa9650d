"""DXF text: alternating lines of group code and value.

A drawing is one row; its entities come out of that row, so reading needs no shuffle.  Points are written and read over Arrow
batches (``text_kernels``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.arrangement import move, numbered, order_rings, snapped
from parcelgrid.operators.network import components
from parcelgrid.session import cut_lineage

# fixed values: layer per feature kind
LAYERS = {
    "block": "BLOCKS", "park": "PARKS", "service": "SERVICE", "xlnt": "SERVICE", "road_network": "ROADS",
    "connection": "INFRASTRUCTURE", "transformer": "INFRASTRUCTURE", "drainage": "INFRASTRUCTURE", "lot": "LOTS",
    "setback": "LOTS",
}


def parse_dxf(docs: DataFrame) -> DataFrame:
    """Entities ``path, entity_no, kind, layer, is_closed, points`` of LWPOLYLINE, POLYLINE and LINE."""
    e = docs.select("path", g.dxf_entities(F.col("value")).alias("_all")).select("path", F.explode("_all").alias("_e")).select("path", "_e.*")
    flag = F.coalesce(F.col("flag").try_cast("int"), F.lit(0))
    return e.select(
        "path", "entity_no", "kind", "layer", ((flag.bitwiseAND(1) == 1) & (F.col("kind") != "LINE")).alias("is_closed"), "points"
    )


def boundary_and_roads(entities: DataFrame) -> DataFrame:
    """One boundary per drawing, and its roads: open polylines and lines.

    The boundary is the largest valid closed LWPOLYLINE, in a drawing without one the largest closed POLYLINE, and in
    a drawing without either the largest ring that its loose lines form.
    """
    rings = g.materialize(entities.filter("is_closed"), area_sqm=g.area(F.col("points")), ok=g.is_simple(F.col("points")))
    best = rings.filter("ok").groupBy("path").agg(
        F.max_by(
            F.struct("entity_no", "points", "area_sqm"), F.struct(F.col("kind") == "LWPOLYLINE", "area_sqm", -F.col("entity_no"))
        ).alias("_m")
    ).select("path", "_m.*")
    loose = assemble_rings(entities.join(best.select("path"), "path", "left_anti")).filter("status = 'ring'")
    formed = g.materialize(loose, area_sqm=g.area(F.col("ring")), ok=g.is_simple(F.col("ring"))).filter("ok")
    largest = formed.groupBy("path").agg(
        F.max_by(F.struct("ring", "area_sqm"), F.struct("area_sqm", -F.col("comp"))).alias("_m")
    ).select(
        "path", F.lit(None).cast(entities.schema["entity_no"].dataType).alias("entity_no"), F.col("_m.ring").alias("points"), "_m.area_sqm"
    )
    best = best.unionByName(largest).withColumn("role", F.lit("boundary"))
    roads = entities.filter("not is_closed").select(
        "path", "entity_no", "points", F.lit(0.0).alias("area_sqm"), F.lit("road").alias("role")
    )
    return best.unionByName(roads)


def summary(entities: DataFrame, drawings: DataFrame) -> DataFrame:
    """Counts per drawing of ``drawings``; one without a usable entity has zeros and is invalid."""
    k = F.col("kind")
    every = drawings.select("path").distinct().withColumn("kind", F.lit(None).cast("string")).withColumn("is_closed", F.lit(False))
    return entities.select("path", "kind", "is_closed").unionByName(every).groupBy("path").agg(
        F.count_if(k == "LWPOLYLINE").alias("n_lwpolyline"),
        F.count_if((k == "LWPOLYLINE") & F.col("is_closed")).alias("n_closed"),
        F.count_if(k == "POLYLINE").alias("n_polyline"),
        F.count_if(k == "LINE").alias("n_line"),
        (F.count("kind") > 0).alias("is_valid"),
    )


def assemble_rings(entities: DataFrame, snap: float = 0.01) -> DataFrame:
    """Closed rings from loose LINEs: ``path, comp, status, ring, n_lines``, one row for each connected part.

    Ends within ``snap`` of each other meet.  A part in which every point has two lines is a ring; any other, and one of
    two points only, is reported as open.  Open parts are set aside before rings are put in order, by pointer doubling
    over their lines, so a street drawing costs a degree count.  Rings run counter-clockwise; ``comp`` is the first
    entity of the part.  Lines shorter than ``snap``, or without two points, are no part of any.
    """
    key = ["path"]
    ln = numbered(entities.filter("kind = 'LINE' AND size(points) >= 2").select("path", "entity_no", "points"), "line")
    ends = ln.select(
        "path", "entity_no", "line", F.posexplode(F.slice("points", 1, 2)).alias("end", "_p")
    ).select("path", "entity_no", "line", "end", F.col("_p.x").alias("px"), F.col("_p.y").alias("py")).filter(
        F.col("px").isNotNull() & F.col("py").isNotNull()
    )
    ends = cut_lineage(move(ends, snapped(ends, key, snap), key, "px", "py"))
    point = ends.groupBy("path", "px", "py").agg(F.count("*").alias("n_lines"))
    nodes = numbered(point, "node")
    at = ends.join(nodes.select("path", "px", "py", "node"), ["path", "px", "py"])
    line = at.groupBy("path", "entity_no", "line").agg(
        *[F.max(F.when(F.col("end") == k, F.struct("node", "px", "py"))).alias(n) for k, n in ((0, "u"), (1, "v"))]
    )
    line = cut_lineage(line.filter("u.node <> v.node"))
    degree = line.select(F.explode(F.array("u.node", "v.node")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    one = F.lit(0).alias("site_id")
    comp = components(
        degree.select(one, "node"), line.select(one, F.col("u.node").alias("u"), F.col("v.node").alias("v"))
    ).select("node", F.col("comp").alias("part"))
    part = cut_lineage(line.join(comp.withColumnRenamed("node", "_n"), F.col("u.node") == F.col("_n")).drop("_n"))
    loose = comp.join(degree.filter("degree <> 2"), "node").select("part").distinct()
    closed = part.join(loose, "part", "left_anti")
    both = closed.select("path", "part", "line", (F.col("line") * 2).alias("edge"), "u", "v").unionByName(
        closed.select("path", "part", "line", (F.col("line") * 2 + 1).alias("edge"), F.col("v").alias("u"), F.col("u").alias("v"))
    )
    after = both.select(F.col("u.node").alias("_at"), F.col("edge").alias("next"), F.col("line").alias("_other"))
    linked = both.join(after, (F.col("v.node") == F.col("_at")) & (F.col("line") != F.col("_other"))).select(
        "path", "part", "edge", "next", F.col("u.px").alias("ux"), F.col("u.py").alias("uy")
    )
    rings = g.materialize(order_rings(linked, ["path", "part"]), _a=g.signed_area(F.col("ring")))
    rings = rings.filter((F.size("ring") >= 3) & (F.col("_a") > 0)).select("part", "ring")
    counted = part.groupBy("path", "part").agg(F.min("entity_no").alias("comp"), F.count("*").alias("n_lines"))
    return counted.join(rings, "part", "left").select(
        "path", "comp", F.when(F.col("ring").isNull(), "open").otherwise("ring").alias("status"), "ring", "n_lines"
    )


def layer_of(kind: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in LAYERS.items() for v in kv])
    return F.coalesce(names[kind], F.lit("LOTS"))


def polyline_text(layer: Column, ring: Column) -> Column:
    """Closed LWPOLYLINE as group-code lines."""
    return g.dxf_polyline(layer, ring)


def line_text(layer: Column, a: Column, b: Column) -> Column:
    return F.concat(
        F.lit("0\nLINE\n8\n"), layer, F.format_string("\n10\n%.6f\n20\n%.6f\n11\n%.6f\n21\n%.6f\n", a.x, a.y, b.x, b.y)
    )


def point_text(layer: Column, p: Column) -> Column:
    return F.concat(F.lit("0\nCIRCLE\n8\n"), layer, F.format_string("\n10\n%.6f\n20\n%.6f\n40\n2.0\n", p.x, p.y))


def label_text(layer: Column, p: Column, text: Column) -> Column:
    return F.concat(F.lit("0\nTEXT\n8\n"), layer, F.format_string("\n10\n%.6f\n20\n%.6f\n40\n2.5\n1\n%s\n", p.x, p.y, text))


HEADER, FOOTER = "0\nSECTION\n2\nENTITIES\n", "0\nENDSEC\n0\nEOF\n"


def write_dxf(features: DataFrame, path: str, key: str = "site_id") -> None:
    """One folder per drawing; ``features(key, feature_no, kind, ring, label)`` become polylines and labels.

    Rows are range-partitioned by drawing and feature, so a large drawing spreads over tasks and its part files
    keep the order when they are put together by name.
    """
    layer = layer_of(F.col("kind"))
    body = F.concat(polyline_text(layer, F.col("ring")), label_text(layer, g.centroid(F.col("ring")), F.col("label")))
    rows = features.select(key, F.col("feature_no").cast("long").alias("no"), F.regexp_replace(body, "\n$", "").alias("value"))
    keys = rows.select(key).distinct()
    ends = keys.select(key, F.lit(-1).cast("long").alias("no"), F.lit(HEADER.rstrip("\n")).alias("value")).unionByName(
        keys.select(key, F.lit(2**62).alias("no"), F.lit(FOOTER.rstrip("\n")).alias("value"))
    )
    out = rows.unionByName(ends).repartitionByRange(F.col(key), F.col("no")).sortWithinPartitions(key, "no")
    out.select(key, "value").write.partitionBy(key).text(path)
