"""Predicates and joins between plots, assets, constraints, roads and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import near_home, near_pairs
from parcelgrid.session import cut_lineage

LAYOUT = ("layout_id",)


def with_planes(sites: DataFrame) -> DataFrame:
    """Half-planes and convexity of every outline, worked out once per site instead of once per plot."""
    r = F.col("ring")
    return g.materialize(sites, convex=g.is_convex(r), planes=g.planes_of(r))


def rect_in_site(ring: str = "ring", d: float = 0.0, prepared: bool = False) -> Column:
    """Rectangle ``x,y,w,h`` inside ``ring`` with clearance ``d`` to its outline.

    ``prepared`` rows carry the columns of :func:`with_planes`.

    On a convex outline the farthest corner per side decides, so no pair of segments is looked at; the same
    test holds for concave outlines through the distance to the outline.
    """
    r, x, y, w, h = F.col(ring), *(F.col(k) for k in "xywh")
    zero = F.lit(0.0)
    convex = F.forall(
        F.col("planes") if prepared else g.planes_of(r),
        lambda p: p.a * x + p.b * y + F.greatest(p.a, zero) * w + F.greatest(p.b, zero) * h <= p.c - d + g.EPS,
    )
    return F.when(F.col("convex") if prepared else g.is_convex(r), convex).otherwise(
        g.rect_clear_of_outline(r, x, y, w, h, d)
    )


def setback_check(plots: DataFrame, d: float, ring: str = "ring") -> DataFrame:
    """Industrial plots with ``ok``: inside the outline and at least ``d`` away from it."""
    return plots.filter(F.col("type") == "industrial").withColumn("setback_ok", rect_in_site(ring, d))


def overlap_pairs(
    items: DataFrame, keys: Sequence[str] = LAYOUT, id_col: str = "plot_no", tol: float = 0.01,
    cell_m: float = 100.0,
) -> DataFrame:
    """Pairs ``a < b`` of rectangles of one key whose overlap area exceeds ``tol``."""
    lean = items.select(*keys, id_col, "x", "y", "w", "h")
    ordered = (F.col(id_col) < F.col(f"{id_col}_b")) & (
        g.rect_overlap(g.rect_of(), {k: F.col(f"{k}_b") for k in "xywh"}) > tol
    )
    pairs = near_pairs(lean, lean, keys, 0.0, cell_m, ordered)
    return pairs.select(*keys, F.col(id_col).alias("a"), F.col(f"{id_col}_b").alias("b"), "overlap_sqm")


def overlap_pairs_ring(
    items: DataFrame, keys: Sequence[str], id_col: str, tol: float = 0.01, cell_m: float = 100.0
) -> DataFrame:
    """As :func:`overlap_pairs` for simple rings: bounding boxes meet first, rings decide."""
    ordered = (F.col(id_col) < F.col(f"{id_col}_b")) & (
        g.rect_overlap(g.rect_of(), {k: F.col(f"{k}_b") for k in "xywh"}) > tol
    )
    lean = items.select(*keys, id_col, "ring", "x", "y", "w", "h")
    pairs = near_pairs(lean, lean, keys, 0.0, cell_m, ordered)
    exact = g.materialize(pairs, overlap_sqm=g.intersection_area(F.col("ring"), F.col("ring_b")))
    return exact.filter(F.col("overlap_sqm") > tol).select(
        *keys, F.col(id_col).alias("a"), F.col(f"{id_col}_b").alias("b"), "overlap_sqm"
    )


def spacing_pairs(
    items: DataFrame, min_d: float, keys: Sequence[str] = LAYOUT, id_col: str = "plot_no", cell_m: float = 100.0
) -> DataFrame:
    """Pairs ``a < b`` strictly closer than ``min_d``; touching or overlapping items have distance 0."""
    lean = items.select(*keys, id_col, "x", "y", "w", "h")
    ordered = F.col(id_col) < F.col(f"{id_col}_b")
    pairs = near_pairs(lean, lean, keys, min_d, cell_m, ordered)
    return pairs.filter(F.col("gap_m") < min_d).select(
        *keys, F.col(id_col).alias("a"), F.col(f"{id_col}_b").alias("b"), "gap_m"
    )


def constraint_hits(plots: DataFrame, constraints: DataFrame, max_buffer: float, cell_m: float = 100.0) -> DataFrame:
    """Industrial plots touching a buffered constraint of their site.

    A buffer is never built: touching it means being within ``buffer_m`` of the bare constraint.
    """
    p = plots.filter(F.col("type") == "industrial").select("site_id", "layout_id", "plot_no", "x", "y", "w", "h")
    c = constraints.select("site_id", "constraint_id", "buffer_m", "x", "y", "w", "h")
    hit = near_pairs(p, c, ["site_id"], F.col("buffer_m_b"), cell_m, max_within=max_buffer, few=True)
    return hit.select("layout_id", "plot_no", F.col("constraint_id_b").alias("constraint_id"), "gap_m")


def road_boxes(roads: DataFrame) -> DataFrame:
    """Axis-parallel road lines as boxes without thickness."""
    return roads.select(
        "site_id",
        "road_no",
        F.least("x1", "x2").alias("x"),
        F.least("y1", "y2").alias("y"),
        F.abs(F.col("x2") - F.col("x1")).alias("w"),
        F.abs(F.col("y2") - F.col("y1")).alias("h"),
    )


def road_access(plots: DataFrame, roads: DataFrame, max_d: float = 200.0) -> DataFrame:
    """Nearest road within ``max_d`` per plot; no road in reach means no access.

    There are far more plots than roads, so roads are expanded into cells and plots are not.
    """
    p = plots.select("site_id", "layout_id", "plot_no", "x", "y", "w", "h")
    near = near_home(p, road_boxes(roads), ["site_id"], max_d, cell_m=max(max_d, 250.0), how="left")
    return near.groupBy("layout_id", "plot_no").agg(
        F.min("gap_m").alias("road_m"), F.coalesce(F.min("gap_m") <= max_d, F.lit(False)).alias("has_road_access")
    )


def no_build_zones(constraints: DataFrame) -> DataFrame:
    return constraints.filter(F.col("is_hard") & (F.col("type") == "no_build"))


def min_area_filter(blocks: DataFrame, min_area: float, area: str = "area_sqm") -> DataFrame:
    return blocks.filter(F.col(area) >= min_area)


def block_quality_ratio(area: Column, original: Column) -> Column:
    return F.when(original <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(area, original)))


# ---------------------------------------------------------------- gatekeeper


def gate_assets(sites: DataFrame, assets: DataFrame, margin: float = 1.0, min_clip: float = 10.0) -> DataFrame:
    """Boundary rule for every new asset: kept whole, clipped to its site, or refused.

    ``sites(site_id, ring)``, ``assets(site_id, asset_id, type, x, y, w, h)``.  Cutting the outline by the
    rectangle (a convex window) is exact for concave outlines as well.
    """
    prepared = with_planes(sites.select("site_id", "ring")).withColumnRenamed("ring", "site")
    j = assets.join(prepared, "site_id")
    x, y, w, h = (F.col(k) for k in "xywh")
    j = g.materialize(
        j, whole=rect_in_site("site", 0.0, prepared=True), clear=rect_in_site("site", margin, prepared=True)
    )
    inside = g.clip_convex(F.col("site"), g.rect_planes(x, y, x + w, y + h))
    j = g.materialize(j, ring=F.when(F.col("whole"), g.rect_ring(x, y, w, h)).otherwise(inside))
    j = g.materialize(j, kept_sqm=F.when(F.col("whole"), w * h).otherwise(F.round(g.area(F.col("ring")), 6)))
    touches = g.ring_distance(F.col("site"), g.rect_ring(x, y, w, h)) <= g.EPS
    boundary = (
        F.when(F.col("whole"), "inside")
        .when(F.col("kept_sqm") >= min_clip, "clipped")
        .when((F.col("kept_sqm") > 0) | touches, "too_small")
        .otherwise("outside")
    )
    # findings, result and merge all read the gated assets: cut them once
    return cut_lineage(g.materialize(j, boundary=boundary).drop("site", "convex", "planes"))


def gate_findings(gated: DataFrame, existing: DataFrame, tol: float = 0.1, cell_m: float = 100.0) -> DataFrame:
    """Errors and warnings ``(site_id, asset_id, severity, finding, other_id)``.

    ``existing`` are rectangles, or with columns ``whole`` and ``ring`` what clipping has left of them.
    """
    single = gated.select(
        "site_id",
        "asset_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("boundary").isin("too_small", "outside"), F.struct(
                        F.lit("error").alias("severity"), F.col("boundary").alias("finding"))),
                    F.when(F.col("boundary") == "clipped", F.struct(
                        F.lit("warning").alias("severity"), F.lit("clipped").alias("finding"))),
                    F.when(F.col("boundary").isin("inside", "clipped") & ~F.col("clear"), F.struct(
                        F.lit("warning").alias("severity"), F.lit("near_boundary").alias("finding"))),
                )
            )
        ).alias("f"),
    ).select("site_id", "asset_id", "f.severity", "f.finding", F.lit(None).cast("long").alias("other_id"))

    new = gated.filter(F.col("boundary").isin("inside", "clipped")).select(
        "site_id", "asset_id", "type", "whole", "ring", "x", "y", "w", "h"
    )
    kept = [c for c in ("whole", "ring") if c in existing.columns]
    old = existing.select("site_id", "asset_id", "type", "x", "y", "w", "h", *kept)
    road_a, road_b = F.col("type") == "internal_road", F.col("type_b") == "internal_road"
    boxes_meet = g.rect_overlap(g.rect_of(), {k: F.col(f"{k}_b") for k in "xywh"}) > tol

    def exact(pairs: DataFrame, other: Column) -> DataFrame:
        real = F.when(F.col("plain"), F.col("overlap_sqm")).otherwise(g.intersection_area(F.col("ring"), other))
        return g.materialize(pairs, real=real).filter(F.col("real") > tol)

    rect_b = F.col("ring_b") if kept else g.rect_ring(*(F.col(f"{k}_b") for k in "xywh"))
    plain = F.col("whole") & F.col("whole_b") if kept else F.col("whole")
    with_old = near_pairs(new, old, ["site_id"], 0.0, cell_m, boxes_meet).withColumn("plain", plain)
    with_old = exact(with_old, rect_b).select(
        "site_id",
        "asset_id",
        F.when(road_a & road_b, "warning").otherwise("error").alias("severity"),
        F.when(road_a & road_b, "road_on_road").otherwise("overlaps_existing").alias("finding"),
        F.col("asset_id_b").alias("other_id"),
    )
    non_road = new.filter(F.col("type") != "internal_road")
    later = boxes_meet & (F.col("asset_id") > F.col("asset_id_b"))
    with_new = near_pairs(non_road, non_road, ["site_id"], 0.0, cell_m, later)
    with_new = exact(with_new.withColumn("plain", F.col("whole") & F.col("whole_b")), F.col("ring_b")).select(
        "site_id", "asset_id", F.lit("error").alias("severity"), F.lit("overlaps_new").alias("finding"),
        F.col("asset_id_b").alias("other_id"),
    )
    return single.unionByName(with_old).unionByName(with_new)


def gate_result(gated: DataFrame, findings: DataFrame) -> DataFrame:
    """Success flag and counts per site that received new assets."""
    sums = findings.groupBy("site_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )
    new = gated.groupBy("site_id").agg(F.count("*").alias("n_new"))
    zero = F.lit(0).cast("long")
    return (
        new.join(sums, "site_id", "left")
        .withColumn("n_errors", F.coalesce("n_errors", zero))
        .withColumn("n_warnings", F.coalesce("n_warnings", zero))
        .withColumn("success", F.col("n_errors") == 0)
    )


def merge_assets(existing: DataFrame, gated: DataFrame, result: DataFrame) -> DataFrame:
    """Existing assets, then the new ones of every successful site, with their clipped rings."""
    x, y, w, h = (F.col(k) for k in "xywh")
    old = existing.select(
        "site_id", "asset_id", "type", g.rect_ring(x, y, w, h).alias("ring"), (w * h).alias("area_sqm"),
        F.lit(0).alias("merge_group"),
    )
    passed = result.filter("success").select("site_id")
    new = gated.join(passed, "site_id", "left_semi").select(
        "site_id", "asset_id", "type", "ring", F.col("kept_sqm").alias("area_sqm"), F.lit(1).alias("merge_group")
    )
    return old.unionByName(new)
