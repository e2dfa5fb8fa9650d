"""Compliance reports and the rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import own_pairs
from parcelgrid.operators.pairs import rect_in_site, road_access
from parcelgrid.session import cut_lineage


def _text(n: Column) -> Column:
    return n.cast("string")


def pair_rules(plots: DataFrame, fire_m: float, overlap_tol: float = 0.01, cell_m: float = 1000.0) -> DataFrame:
    """Fire distance and overlap among the plots of a layout: counts and first offending pair per layout."""
    lean = plots.select("layout_id", "plot_no", "type", "x", "y", "w", "h")
    ordered = F.col("plot_no") < F.col("plot_no_b")
    pairs = own_pairs(lean, ["layout_id"], fire_m, ordered, cell_m)
    fire = (F.col("type") == "industrial") & (F.col("type_b") == "industrial") & (F.col("gap_m") < fire_m)
    over = F.col("overlap_sqm") > overlap_tol
    first = F.struct(F.col("plot_no").alias("a"), F.col("plot_no_b").alias("b"), F.col("gap_m"), F.col("overlap_sqm"))
    return pairs.groupBy("layout_id").agg(
        F.count_if(fire).alias("n_fire"),
        F.count_if(over).alias("n_overlap"),
        F.min(F.when(fire, first)).alias("fire"),
        F.min(F.when(over, first)).alias("overlap"),
    )


#: Parameter that limits each rule.
LIMITS = {
    "setback": "setback_m", "far": "far_max", "green": "green_min", "area": "plot_min_sqm", "width": "plot_min_width_m",
    "access": "road_max_m", "fire": "fire_m", "overlap": "overlap_sqm",
}


def _on_sites(layouts: DataFrame, sites: DataFrame, roads: DataFrame) -> DataFrame:
    """``layout_id, site_id, site_sqm, has_roads`` of the layouts that have a site."""
    with_roads = roads.select("site_id").distinct().withColumn("_roads", F.lit(True))
    facts = sites.select("site_id", "site_sqm").join(with_roads, "site_id", "left")
    return layouts.select("layout_id", "site_id").join(facts, "site_id").select(
        "layout_id", "site_id", "site_sqm", F.coalesce("_roads", F.lit(False)).alias("has_roads")
    )


def _land_use(plots: DataFrame) -> DataFrame:
    """``sellable_sqm, green_sqm`` of every layout with plots."""
    kind, area, zero = F.col("type"), F.col("w") * F.col("h"), F.lit(0.0)
    return plots.groupBy("layout_id").agg(
        F.sum(F.when(kind == "industrial", area).otherwise(zero)).alias("sellable_sqm"),
        F.sum(F.when(kind == "green_space", area).otherwise(zero)).alias("green_sqm"),
    )


def findings(layouts: DataFrame, sites: DataFrame, plots: DataFrame, roads: DataFrame, reg: dict[str, float]) -> DataFrame:
    """Everything that breaks a rule, one row for each: ``layout_id, rule, plot_no, other_no, measured, limit_value``.

    ``layouts(layout_id, site_id)``, ``sites(site_id, site_sqm, ring, convex, planes)``.
    ``setback``: clearance of an industrial plot to the outline, 0 where it crosses it or lies outside; ``area``, ``width``,
    ``access`` (distance to the nearest road, null beyond the limit): industrial plots; ``fire`` and ``overlap``: pairs
    with their distance or common area; ``far`` and ``green``: ratios of a layout, without a plot.  Sites without roads
    have no access findings.  No rule stops at its first offender; rows are filtered where plots and pairs are met, so
    what is left over is the findings alone.

    Plots are written once for all rules, and outlines meet plots by their site, so none is copied for every layout.
    """
    reg = {"overlap_sqm": 0.01, **reg}
    none = F.lit(None)

    def row(df: DataFrame, rule: str, a: str | None, b: str | None, measured: Column) -> DataFrame:
        number = lambda c: (none if c is None else F.col(c)).cast("long")
        return df.select(
            "layout_id", F.lit(rule).alias("rule"), number(a).alias("plot_no"), number(b).alias("other_no"),
            measured.cast("double").alias("measured"), F.lit(float(reg[LIMITS[rule]])).alias("limit_value"),
        )

    lean = cut_lineage(plots.select("layout_id", "plot_no", "type", *"xywh"))
    on_sites = _on_sites(layouts, sites, roads)
    industrial = lean.filter("type = 'industrial'").select("layout_id", "plot_no", *"xywh")
    j = industrial.join(layouts.select("layout_id", "site_id"), "layout_id")
    near = g.materialize(
        j.join(sites.select("site_id", "ring", "convex", "planes"), "site_id").filter(~rect_in_site("ring", reg["setback_m"], prepared=True)),
        _in=rect_in_site("ring", 0.0, prepared=True), _r=g.rect_ring(*(F.col(k) for k in "xywh")),
    )
    gap = F.when(F.col("_in"), g.boundary_distance(F.col("ring"), F.col("_r"))).otherwise(0.0)
    area = F.col("w") * F.col("h")
    small = industrial.filter(area < reg["plot_min_sqm"])
    narrow = industrial.filter(F.col("w") < reg["plot_min_width_m"])
    served = industrial.join(on_sites.filter("has_roads").select("layout_id", "site_id"), "layout_id")
    cut_off = road_access(served, roads, reg["road_max_m"]).filter("not has_road_access")

    pairs = own_pairs(lean, ["layout_id"], reg["fire_m"], F.col("plot_no") < F.col("plot_no_b"))
    both = (F.col("type") == "industrial") & (F.col("type_b") == "industrial") & (F.col("gap_m") < reg["fire_m"])
    overlapping = F.col("overlap_sqm") > reg["overlap_sqm"]
    pair = pairs.select("layout_id", "plot_no", "plot_no_b", F.explode(F.array_compact(F.array(
        F.when(both, F.struct(F.lit("fire").alias("rule"), F.col("gap_m").alias("measured"), F.lit(float(reg["fire_m"])).alias("limit_value"))),
        F.when(overlapping, F.struct(F.lit("overlap").alias("rule"), F.col("overlap_sqm").alias("measured"), F.lit(float(reg["overlap_sqm"])).alias("limit_value"))),
    ))).alias("_f")).select("layout_id", "_f.rule", "plot_no", F.col("plot_no_b").alias("other_no"), "_f.measured", "_f.limit_value")

    zero = F.lit(0.0)
    whole = on_sites.select("layout_id", "site_sqm").join(_land_use(lean), "layout_id", "left")
    share = lambda c: F.when(F.col("site_sqm") > 0, F.coalesce(c, zero) / F.col("site_sqm")).otherwise(zero)
    ratio = lambda rule, bad, c: F.when(bad, F.struct(
        F.lit(rule).alias("rule"), c.alias("measured"), F.lit(float(reg[LIMITS[rule]])).alias("limit_value")
    ))
    far, green = F.col("_far"), F.col("_share")
    whole = whole.select("layout_id", share("sellable_sqm").alias("_far"), share("green_sqm").alias("_share")).select(
        "layout_id", F.explode(F.array_compact(F.array(
            ratio("far", far > reg["far_max"], far), ratio("green", green < reg["green_min"], green),
        ))).alias("_f")
    ).select(
        "layout_id", "_f.rule", none.cast("long").alias("plot_no"), none.cast("long").alias("other_no"), "_f.measured", "_f.limit_value"
    )
    out = row(near, "setback", "plot_no", None, gap)
    for more in (
        row(small, "area", "plot_no", None, area), row(narrow, "width", "plot_no", None, F.col("w")),
        row(cut_off, "access", "plot_no", None, F.col("road_m")), pair, whole,
    ):
        out = out.unionByName(more)
    return out


def compliance_flags(
    layouts: DataFrame, sites: DataFrame, plots: DataFrame, roads: DataFrame, reg: dict[str, float]
) -> DataFrame:
    """One row per layout with what every rule found.

    ``layouts(layout_id, site_id)``, ``sites(site_id, site_sqm, ring, convex, planes)``.  Plots are written once for all
    rules; only industrial ones meet their site, by its number, so no outline is copied for every layout, and all that
    comes back is a row for each layout.
    """
    lean = cut_lineage(plots.select("layout_id", "plot_no", "type", *"xywh"))
    industrial = lean.filter("type = 'industrial'").select("layout_id", "plot_no", *"xywh")
    on_sites = _on_sites(layouts, sites, roads)
    j = industrial.join(on_sites.select("layout_id", "site_id"), "layout_id")
    access = road_access(j, roads, reg["road_max_m"]).filter("not has_road_access")
    no_access = access.groupBy("layout_id").agg(
        F.count("*").alias("n_no_access"), F.min("plot_no").alias("first_no_access")
    )
    small, narrow = F.col("w") * F.col("h") < reg["plot_min_sqm"], F.col("w") < reg["plot_min_width_m"]
    outside = ~rect_in_site("ring", reg["setback_m"], prepared=True)
    per_plot = j.join(sites.select("site_id", "ring", "convex", "planes"), "site_id").groupBy("layout_id").agg(
        F.min(F.when(outside, F.col("plot_no"))).alias("first_setback"),
        (F.count_if(small) + F.count_if(narrow)).alias("n_dimension"),
        F.min(F.when(small | narrow, F.col("plot_no"))).alias("first_dimension"),
    )
    zero = F.lit(0.0)
    m = on_sites.join(_land_use(lean), "layout_id", "left")
    m = m.withColumn("sellable_sqm", F.coalesce("sellable_sqm", zero)).withColumn("green_sqm", F.coalesce("green_sqm", zero))
    m = m.withColumn("sellable_ratio", F.when(F.col("site_sqm") > 0, F.col("sellable_sqm") / F.col("site_sqm")).otherwise(zero))
    m = m.withColumn("green_ratio", F.when(F.col("site_sqm") > 0, F.col("green_sqm") / F.col("site_sqm")).otherwise(zero))
    return (
        m.join(per_plot, "layout_id", "left")
        .join(pair_rules(lean, reg["fire_m"]), "layout_id", "left")
        .join(no_access, "layout_id", "left")
        .withColumn("n_dimension", F.coalesce("n_dimension", F.lit(0).cast("long")))
        .withColumn("n_no_access", F.coalesce("n_no_access", F.lit(0).cast("long")))
    )


def compliance_report(flags: DataFrame, reg: dict[str, float]) -> DataFrame:
    """Seven rules in their order.  Setback, fire and overlap report the first offender only; plot size and
    access count one violation per plot and failure.  ``violations`` holds the first offender of each rule, as
    columns, so a row stays small however many plots a layout has; :func:`findings` lists all of them."""
    reg = {"overlap_sqm": 0.01, **reg}
    sell, green = F.col("sellable_ratio"), F.col("green_ratio")
    set_bad = F.col("first_setback").isNotNull()
    far_bad, far_low = sell > reg["far_max"], sell < reg["far_min"]
    green_bad = green < reg["green_min"]
    dim_bad = F.col("n_dimension") > 0
    access_bad = F.col("has_roads") & (F.col("n_no_access") > 0)
    fire_bad, over_bad = F.col("fire").isNotNull(), F.col("overlap").isNotNull()

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    n_viol = (
        one(set_bad) + one(far_bad) + one(green_bad) + F.col("n_dimension")
        + F.when(access_bad, F.col("n_no_access")).otherwise(0) + one(fire_bad) + one(over_bad)
    )

    def line(cond: Column, text: Column) -> Column:
        return F.when(cond, text)

    none = F.lit(None)

    def first(rule: str, cond: Column, a: Column | str | None, b: Column | None, measured: Column | None) -> Column:
        value = lambda c, kind: (none if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)
        return F.when(cond, F.struct(
            F.lit(rule).alias("rule"), value(a, "long").alias("plot_no"), value(b, "long").alias("other_no"),
            value(measured, "double").alias("measured"), F.lit(float(reg[LIMITS[rule]])).alias("limit_value"),
        ))

    violations = F.array_compact(F.array(
        first("setback", set_bad, "first_setback", None, None),
        first("far", far_bad, None, None, sell),
        first("green", green_bad, None, None, green),
        first("area", dim_bad, "first_dimension", None, None),
        first("access", access_bad, "first_no_access", None, None),
        first("fire", fire_bad, F.col("fire.a"), F.col("fire.b"), F.col("fire.gap_m")),
        first("overlap", over_bad, F.col("overlap.a"), F.col("overlap.b"), F.col("overlap.overlap_sqm")),
    ))
    warnings = F.array_compact(
        F.array(
            line(~far_bad & far_low, F.lit("far_low")),
            line(~F.col("has_roads"), F.lit("no_roads")),
        )
    )
    passed = F.array_compact(
        F.array(
            line(~set_bad, F.lit("setback")),
            line(~far_bad & ~far_low, F.lit("far")),
            line(~green_bad, F.lit("green")),
            line(~dim_bad, F.lit("dimensions")),
            line(F.col("has_roads") & (F.col("n_no_access") == 0), F.lit("access")),
            line(~fire_bad, F.lit("fire")),
            line(~over_bad, F.lit("overlap")),
        )
    )
    return flags.select(
        "layout_id",
        "site_id",
        "sellable_sqm",
        "green_ratio",
        "sellable_ratio",
        n_viol.cast("long").alias("n_violations"),
        (n_viol == 0).alias("is_compliant"),
        violations.alias("violations"),
        warnings.alias("warnings"),
        passed.alias("checks_passed"),
    )


def quick_compliance(
    layout_sites: DataFrame, plots_inside: DataFrame, road_width: float, setback: float, max_far: float = 0.7,
    min_green: float = 0.15, min_plot: float = 1000.0, min_setback: float = 50.0, min_road: float = 6.0,
) -> DataFrame:
    """Constant thresholds; ``plots_inside`` carries ``inside_share``, the part of a plot within the setback."""
    a = F.col("w") * F.col("h")
    sums = plots_inside.groupBy("layout_id").agg(
        F.sum(a).alias("plot_sqm"),
        F.count("*").alias("n_plots"),
        F.count_if(a < min_plot).alias("n_small"),
        F.count_if(F.col("inside_share") < 0.95).alias("n_outside"),
    )
    j = layout_sites.join(sums, "layout_id", "left")
    zero = F.lit(0).cast("long")
    far = F.coalesce("plot_sqm", F.lit(0.0)) / F.col("site_sqm")
    j = (
        j.withColumn("far", far)
        .withColumn("green_estimate", F.lit(1.0) - F.col("far") - 0.2)
        .withColumn("n_small", F.coalesce("n_small", zero))
        .withColumn("n_outside", F.coalesce("n_outside", zero))
        .withColumn("n_plots", F.coalesce("n_plots", zero))
    )
    critical = (
        F.lit(int(setback < min_setback)) + F.lit(int(road_width < min_road))
        + F.when(F.col("far") > max_far, 1).otherwise(0)
    )
    moderate = F.when(F.col("n_small") + F.col("n_outside") > 0, 1).otherwise(0)
    return j.select(
        "layout_id", "n_plots", "n_small", "n_outside", "far", "green_estimate",
        critical.cast("long").alias("n_critical"), moderate.cast("long").alias("n_moderate"),
        (F.col("green_estimate") < min_green).alias("green_warning"),
        (critical + moderate == 0).alias("compliant"),
    )


# ---------------------------------------------------------------- rule table

# fixed values: the two default rules, in insertion order
DEFAULT_RULES: list[dict] = [
    {"name": "keep_valid", "condition": "is_valid", "action": "inset_front", "priority": 10},
    {"name": "small_green", "condition": "NOT is_valid AND area_sqm >= 0.3 * min_area", "action": "green", "priority": 5},
]


def add_rule(rules: list[dict], rule: dict) -> list[dict]:
    """Adding a rule sorts the table by descending priority; the defaults alone keep insertion order."""
    return sorted([*rules, rule], key=lambda r: -r["priority"])


def rule_action(rules: list[dict]) -> Column:
    """Conditions are SQL text over the shape's columns; the first match decides."""
    chain = None
    for r in rules:
        cond = F.expr(r["condition"])
        chain = F.when(cond, r["action"]) if chain is None else chain.when(cond, r["action"])
    return chain.otherwise("drop")


def apply_rules(shapes: DataFrame, rules: list[dict]) -> DataFrame:
    return shapes.withColumn("action", rule_action(rules))
