"""GeoJSON and project JSON as DataFrame transformations; one document per row ``(path, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelgrid.functions import geometry as g

_GEOM = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,geometry:{_GEOM},properties:map<string,string>>"
_DOC = f"type string, features array<{_FEATURE}>, geometry {_GEOM}, properties map<string,string>, coordinates string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: a drawing or plan is one record, many of them spread over the cluster."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _points(raw: Column) -> Column:
    return F.transform(raw, lambda p: g.pt(p[0], p[1]))


def _open(ring: Column) -> Column:
    """Drop a closing point if there is one; both spellings are accepted."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    same = (F.size(ring) > 1) & (first.x == last.x) & (first.y == last.y)
    return F.when(same, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def _opened(raw: Column) -> Column:
    """``_open`` of the points; they are made once and not for each look at the first and the last."""
    return g.let(_points(raw), _open)


def parse_geojson(docs: DataFrame) -> DataFrame:
    """Features with role and shape; an empty or broken document gives one row with ``error``.

    A polygon has its outer ``ring`` and its ``holes``; a line of several parts has one row for each.
    """
    d = g.materialize(docs, _d=F.from_json("value", _DOC))
    bare = F.array(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.col("_d.type").alias("type"), F.col("_d.coordinates").alias("coordinates")).alias("geometry"),
            F.lit(None).cast("map<string,string>").alias("properties"),
        )
    )
    one = F.array(
        F.struct(F.lit("Feature").alias("type"), F.col("_d.geometry").alias("geometry"), F.col("_d.properties").alias("properties"))
    )
    kind = F.col("_d.type")
    feats = (
        F.when(kind == "FeatureCollection", F.col("_d.features")).when(kind == "Feature", one)
        .when(F.col("_d.coordinates").isNotNull(), bare)
    )
    d = g.materialize(d.select("path", "_d"), _f=feats)
    polygon = F.transform("_f", lambda f: F.coalesce(f.geometry.type.isin("Polygon", "MultiPolygon"), F.lit(False)))
    marked = F.exists("_f", lambda f: F.coalesce(f.properties["role"] == "boundary", F.lit(False)))
    d = g.materialize(d, _first=F.when(~marked, F.array_position(polygon, True)).otherwise(F.lit(0)))
    bad = F.col("_f").isNull() | (F.size("_f") == 0)
    rows = d.select("path", bad.alias("_bad"), "_first", F.posexplode_outer("_f").alias("feature_no", "_f"))
    c, t, role = F.col("_f.geometry.coordinates"), F.col("_f.geometry.type"), F.col("_f.properties")["role"]
    opened = lambda rings: F.transform(rings, _opened)
    # all rings of a polygon, of several polygons those of the largest
    rings = F.when(t == "Polygon", opened(F.from_json(c, "array<array<array<double>>>"))).when(
        t == "MultiPolygon",
        F.array_max(
            F.transform(
                F.from_json(c, "array<array<array<array<double>>>>"),
                lambda p, i: F.struct(g.area(_points(p[0])).alias("a"), (-i).alias("o"), opened(p).alias("rings")),
            )
        ).rings,
    )
    lines = F.when(t == "LineString", F.array(_points(F.from_json(c, "array<array<double>>")))).when(
        t == "MultiLineString", F.transform(F.from_json(c, "array<array<array<double>>>"), _points)
    )
    is_line = t.isin("LineString", "MultiLineString")
    name = (
        F.when(role == "boundary", "boundary").when(F.col("feature_no") + 1 == F.col("_first"), "boundary")
        .when((role == "road") | is_line, "road").otherwise(F.coalesce(role, F.lit("other")))
    )
    out = g.materialize(rows.select(
        F.col("path").alias("path"), "feature_no", F.when(F.col("_bad"), "empty document").alias("error"),
        F.when(~F.col("_bad"), name).alias("role"), t.alias("geom_type"), F.col("_f.properties").alias("properties"),
        rings.alias("_rings"), lines.alias("_lines"),
    ))
    return out.select(
        "path", "feature_no", "error", "role", "geom_type", F.get("_rings", 0).alias("ring"),
        F.slice("_rings", 2, F.greatest(F.size("_rings") - 1, F.lit(0))).alias("holes"),
        F.explode_outer("_lines").alias("line"), "properties",
    )


def net_area(ring: Column, holes: Column) -> Column:
    """Area of a polygon without its holes."""
    return g.area(ring) - F.aggregate(F.coalesce(holes, F.array().cast(holes_type())), F.lit(0.0), lambda a, h: a + g.area(h))


def holes_type() -> str:
    return f"array<{g.RING}>"


def parse_project_json(docs: DataFrame) -> DataFrame:
    """Assets of project documents: one ``coordinates`` ring or a list of named polygons."""
    ring = "array<array<double>>"
    schema = (
        f"project_name string, boundary struct<area_m2:double,coordinates:{ring}>, "
        f"assets array<struct<asset_id:string,type:string,coordinates:{ring},polygons:array<struct<name:string,coordinates:{ring}>>>>"
    )
    d = docs.select("path", F.from_json("value", schema).alias("_d"))
    a = d.select("path", F.col("_d.project_name").alias("project"), F.explode("_d.assets").alias("_a"))
    single = F.array(F.struct(F.col("_a.asset_id").alias("name"), F.col("_a.coordinates").alias("coordinates")))
    p = a.select(
        "path", "project", "_a.asset_id", "_a.type", F.posexplode(F.coalesce("_a.polygons", single)).alias("part_no", "_p")
    )
    return p.select(
        "path", "project", "asset_id", "type", "part_no", F.col("_p.name").alias("name"),
        _opened(F.col("_p.coordinates")).alias("ring"),
    )


def feature_json(ring: Column, properties: Column) -> Column:
    """One GeoJSON feature per row, with a closed ring."""
    coords = F.array(F.transform(g.closed(ring), lambda p: F.array(p.x, p.y)))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_features(features: DataFrame, path: str, key: str = "site_id") -> None:
    """Line-delimited features, one folder per site; large sites span several files."""
    features.select(key, "feature").write.partitionBy(key).text(path)


def sites_from_coordinates(rows: DataFrame, setback: float = 0.0) -> DataFrame:
    """Rings from raw coordinates: fewer than three points are refused, others are closed and turned."""
    ok = F.size("coords") >= 3
    s = g.materialize(rows, ring=F.when(ok, g.normalize_ring(F.col("coords"))))
    return s.select(
        "site_id", "ring", F.when(~ok, "need at least 3 points").alias("error"), g.area(F.col("ring")).alias("area_sqm"),
        g.area(g.inset(F.col("ring"), setback)).alias("buildable_sqm"), F.lit("coordinates").alias("source"),
    )
