"""Aggregations over plots, roads, assets and candidate layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ZERO = F.lit


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def road_totals(roads: DataFrame) -> DataFrame:
    """Length per class, total length and paved area per site."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))

    def of(cls: str) -> Column:
        return F.sum(F.when(F.col("road_class") == cls, length).otherwise(0.0))

    return roads.groupBy("site_id").agg(
        of("primary").alias("primary_m"),
        of("secondary").alias("secondary_m"),
        of("tertiary").alias("tertiary_m"),
        F.sum(length).alias("road_length_m"),
        F.sum(length * F.col("width_m")).alias("road_area_sqm"),
    )


def layout_metrics(layout_sites: DataFrame, plots: DataFrame, road_sums: DataFrame | None = None) -> DataFrame:
    """Areas, counts and ratios per layout; layouts without plots are kept.

    ``layout_sites(layout_id, site_id, site_sqm)``.  The plots are aggregated before the join, so only one row
    per layout moves.
    """
    a, kind = F.col("w") * F.col("h"), F.col("type")

    def total(value: str) -> Column:
        return F.sum(F.when(kind == value, a).otherwise(0.0))

    sums = plots.groupBy("layout_id").agg(
        total("industrial").alias("sellable_sqm"),
        total("green_space").alias("green_sqm"),
        total("utility").alias("utility_sqm"),
        F.count_if(kind == "industrial").alias("n_plots"),
    )
    out = layout_sites.join(sums, "layout_id", "left")
    if road_sums is None:
        out = out.withColumn("road_area_sqm", F.lit(0.0))
    else:
        out = out.join(road_sums.select("site_id", "road_area_sqm"), "site_id", "left")
    for c in ("sellable_sqm", "green_sqm", "utility_sqm", "road_area_sqm"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    out = out.withColumn("n_plots", F.coalesce("n_plots", F.lit(0).cast("long")))
    return out.select(
        "layout_id",
        "site_id",
        "site_sqm",
        "sellable_sqm",
        "green_sqm",
        "utility_sqm",
        "road_area_sqm",
        "n_plots",
        _ratio(F.col("sellable_sqm"), F.col("n_plots")).alias("avg_plot_sqm"),
        _ratio(F.col("sellable_sqm"), F.col("site_sqm")).alias("sellable_ratio"),
        _ratio(F.col("green_sqm"), F.col("site_sqm")).alias("green_ratio"),
        _ratio(F.col("utility_sqm"), F.col("site_sqm")).alias("utility_ratio"),
        _ratio(F.col("road_area_sqm"), F.col("sellable_sqm")).alias("road_efficiency"),
    )


def coverage(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """Total, used and free area per site; overlapping assets count twice."""
    used = assets.groupBy("site_id").agg(F.sum(F.col("w") * F.col("h")).alias("used_sqm"))
    j = sites.select("site_id", "site_sqm").join(used, "site_id", "left")
    j = j.withColumn("used_sqm", F.coalesce("used_sqm", F.lit(0.0)))
    return j.select(
        "site_id", "site_sqm", "used_sqm", (F.col("site_sqm") - F.col("used_sqm")).alias("free_sqm"),
        _ratio(F.col("used_sqm"), F.col("site_sqm")).alias("ratio"),
    )


def element_stats(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of roads, blocks, lots and greens in one pass over a unioned element table."""
    kind = F.col("kind")

    def area(k: str) -> Column:
        return F.sum(F.when(kind == k, F.col("area_sqm")).otherwise(0.0))

    return elements.groupBy(*keys).agg(
        F.count_if(kind == "road").alias("n_roads"),
        F.count_if(kind == "block").alias("n_blocks"),
        F.count_if(kind == "lot").alias("n_lots"),
        F.count_if(kind == "green").alias("n_greens"),
        F.sum(F.when(kind == "road", F.col("length_m")).otherwise(0.0)).alias("road_m"),
        area("lot").alias("lot_sqm"),
        area("green").alias("green_sqm"),
        (area("block") / 10000.0).alias("block_ha"),
    )


def layout_fitness(
    layout_sites: DataFrame, plots: DataFrame, target: int, inside: Column, variant: str = "weighted"
) -> DataFrame:
    """0.5 area share + 0.3 share inside + 0.2 count share; ``variant='area_count'`` leaves the middle out."""
    sums = plots.groupBy("layout_id").agg(
        F.sum(F.col("w") * F.col("h")).alias("plot_sqm"),
        F.count("*").alias("n"),
        F.count_if(inside).alias("n_inside"),
    )
    j = layout_sites.join(sums, "layout_id", "left")
    one = F.lit(1.0)
    count_share = F.least(F.col("n") / float(target), one)
    if variant == "weighted":
        score = (
            F.lit(0.5) * F.least(_ratio(F.col("plot_sqm"), F.lit(0.6) * F.col("buildable_sqm")), one)
            + F.lit(0.3) * _ratio(F.col("n_inside"), F.col("n"))
            + F.lit(0.2) * count_share
        )
    else:
        score = F.lit(0.5) * _ratio(F.col("plot_sqm"), F.col("buildable_sqm")) + F.lit(0.5) * count_share
    return j.select(
        "layout_id", "site_id", F.round(F.coalesce(F.when(F.col("n") > 0, score), F.lit(0.0)), 4).alias("fitness")
    )


def candidate_objectives(
    layout_sites: DataFrame, plots_inside: DataFrame, road_m: DataFrame | None, min_green: float = 0.15,
    max_far: float = 0.7, min_plot: float = 1000.0, no_road_penalty: float = 1e6,
) -> DataFrame:
    """Four objectives to minimise per candidate: -sellable, -green, road length, -compliance score."""
    a, ind = F.col("w") * F.col("h"), F.col("type") == "industrial"
    sums = plots_inside.groupBy("layout_id").agg(
        F.sum(F.when(ind, a).otherwise(0.0)).alias("sellable"),
        F.sum(F.when(F.col("type") == "green_space", a).otherwise(0.0)).alias("green"),
        F.coalesce(F.bool_or(ind & (a < min_plot)), F.lit(False)).alias("small"),
    )
    j = layout_sites.join(sums, "layout_id", "left")
    if road_m is not None:
        j = j.join(road_m.select("site_id", "road_length_m"), "site_id", "left")
    else:
        j = j.withColumn("road_length_m", F.lit(None).cast("double"))
    sell, green = F.coalesce("sellable", F.lit(0.0)), F.coalesce("green", F.lit(0.0))
    penalty = (
        F.when(green / F.col("site_sqm") < min_green, 0.3).otherwise(0.0)
        + F.when(sell / F.col("site_sqm") > max_far, 0.3).otherwise(0.0)
        + F.when(F.coalesce("small", F.lit(False)), 0.1).otherwise(0.0)
    )
    return j.select(
        "site_id",
        "layout_id",
        (-sell).alias("f1"),
        (-green).alias("f2"),
        F.coalesce("road_length_m", F.lit(float(no_road_penalty))).alias("f3"),
        (-F.greatest(F.lit(0.0), F.lit(1.0) - penalty)).alias("f4"),
    )


def pick_scenarios(metrics: DataFrame) -> DataFrame:
    """Per site: layout with most sellable land, most green, and the best balance; the lowest id wins ties."""
    balanced = (
        F.lit(0.4) * F.col("sellable_ratio") + F.lit(0.3) * F.col("green_ratio")
        + F.lit(0.3) * (F.lit(1.0) - F.col("road_efficiency"))
    )

    def best(score: Column) -> Column:
        return F.max_by("layout_id", F.struct(score, -F.col("layout_id")))

    return metrics.groupBy("site_id").agg(
        best(F.col("sellable_sqm")).alias("max_sellable"),
        best(F.col("green_sqm")).alias("max_green"),
        best(F.round(balanced, 9)).alias("balanced"),
    )


def session_summary(messages: DataFrame, layouts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundary flag, number of layouts and of messages of every session that has any of them."""
    m = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    lay = layouts.groupBy("session_id").agg(F.count("*").alias("n_layouts"))
    has = boundaries.select("session_id").distinct().withColumn("has_boundary", F.lit(True))
    zero = F.lit(0).cast("long")
    return (
        m.join(lay, "session_id", "full")
        .join(has, "session_id", "full")
        .select(
            "session_id",
            F.coalesce("has_boundary", F.lit(False)).alias("has_boundary"),
            F.coalesce("n_layouts", zero).alias("n_layouts"),
            F.coalesce("n_messages", zero).alias("n_messages"),
        )
    )


def redistribution_stats(features: DataFrame) -> DataFrame:
    """Counts by feature kind per site, mean lot width and lot quality."""
    kind = F.col("kind")
    lot = kind == "lot"
    n_lots = F.count_if(lot)
    return features.groupBy("site_id").agg(
        F.count_if(kind.isin("block", "park", "service")).alias("total_blocks"),
        n_lots.alias("total_lots"),
        F.count_if(kind == "park").alias("total_parks"),
        F.count_if(kind == "green").alias("total_greens"),
        F.count_if(kind == "service").alias("service_count"),
        F.coalesce(F.avg(F.when(lot, F.col("width_m"))), F.lit(0.0)).alias("avg_lot_width"),
        F.coalesce(F.avg(F.when(lot, F.col("rectangularity"))), F.lit(0.0)).alias("mean_rectangularity"),
        F.coalesce(F.try_divide(F.count_if(lot & (F.col("rectangularity") > 0.95)), n_lots), F.lit(0.0)).alias(
            "share_rectangular"
        ),
    )
