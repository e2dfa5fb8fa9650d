"""Set operations and edits of designs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import with_near


def fold_edits(edits: DataFrame) -> DataFrame:
    """Edit log folded per element: moves add up, scales multiply, one delete is enough.

    Every part is an associative aggregate, so a hot design is reduced on the map side, and the same fold
    serves the batch table and the stream.
    """
    action = F.col("action")

    def moved(c: str) -> Column:
        return F.sum(F.when(action == "move", F.col(c)).otherwise(0.0))

    factor = F.coalesce(F.col("factor"), F.lit(1.0)) if "factor" in edits.columns else F.lit(1.0)
    return edits.groupBy("design_id", "target").agg(
        moved("dx").alias("dx"),
        moved("dy").alias("dy"),
        F.exp(F.sum(F.when(action == "scale", F.ln(factor)).otherwise(0.0))).alias("scale"),
        F.bool_or(action == "delete").alias("deleted"),
        F.bool_or(action == "convert_to_green").alias("to_green"),
        F.count_if(action == "add_road").alias("roads_added"),
        F.count("*").alias("n_edits"),
    )


def split_at_deletion(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits up to the first deletion of their element, and those after it, which find no element any more.

    The order is that of ``edit_no`` within a design.
    """
    gone = edits.filter(F.col("action") == "delete").groupBy("design_id", "target").agg(F.min("edit_no").alias("_gone"))
    j = edits.join(gone, ["design_id", "target"], "left")
    late = F.coalesce(F.col("edit_no") > F.col("_gone"), F.lit(False))
    return j.filter(~late).select(edits.columns), j.filter(late).select(edits.columns)


def apply_edits(elements: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live elements after the fold, added roads, and rejected targets.

    ``elements(design_id, target, kind, x, y, w, h)``.
    """
    moves = folded.select("design_id", "target", "dx", "dy", "scale", "deleted", "to_green")
    j = elements.join(moves, ["design_id", "target"], "left")
    alive = j.filter(~F.coalesce("deleted", F.lit(False)))
    k = F.coalesce("scale", F.lit(1.0))
    live = alive.select(
        "design_id",
        "target",
        F.when(F.coalesce("to_green", F.lit(False)) & F.col("kind").isin("lot", "block"), "green")
        .otherwise(F.col("kind")).alias("kind"),
        (F.col("x") + F.coalesce("dx", F.lit(0.0)) + F.col("w") * (1 - k) / 2).alias("x"),
        (F.col("y") + F.coalesce("dy", F.lit(0.0)) + F.col("h") * (1 - k) / 2).alias("y"),
        (F.col("w") * k).alias("w"),
        (F.col("h") * k).alias("h"),
    )
    roads = folded.filter("roads_added > 0").select("design_id", "target", "roads_added")
    needs_target = folded.filter(
        F.col("deleted") | F.col("to_green") | (F.col("dx") != 0) | (F.col("dy") != 0) | (F.col("scale") != 1.0)
    )
    rejected = needs_target.join(elements.select("design_id", "target"), ["design_id", "target"], "left_anti").select(
        "design_id", "target", "n_edits"
    )
    return live, roads, rejected


def non_tree_edges(candidates: DataFrame, tree: DataFrame) -> DataFrame:
    return candidates.join(tree.select("site_id", "u", "v"), ["site_id", "u", "v"], "left_anti")


def network_nodes(lots: DataFrame, service: DataFrame, xlnt: DataFrame) -> DataFrame:
    def tag(df: DataFrame, role: str) -> DataFrame:
        return df.withColumn("role", F.lit(role))

    return tag(lots, "lot").unionByName(tag(service, "service")).unionByName(tag(xlnt, "xlnt"))


def _gaps(lo: Column, hi: Column, cuts: Column) -> Column:
    """What sorted intervals leave of ``[lo, hi]``, as an array of ``a, b``."""
    start = F.struct(lo.alias("at"), F.array().cast("array<struct<a:double,b:double>>").alias("gaps"))

    def step(state: Column, c: Column) -> Column:
        gap = F.array(F.struct(state["at"].alias("a"), F.least(c["lo"], hi).alias("b")))
        return F.struct(
            F.greatest(state["at"], c["hi"]).alias("at"),
            F.when(c["lo"] > state["at"], F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"),
        )

    last = lambda state: F.when(
        state["at"] < hi, F.concat(state["gaps"], F.array(F.struct(state["at"].alias("a"), hi.alias("b"))))
    ).otherwise(state["gaps"])
    return F.aggregate(cuts, start, step, last)


def widen_roads(
    lots: DataFrame, roads: DataFrame, min_piece: float = 50.0, min_change: float = 0.1, cell_m: float = 250.0
) -> DataFrame:
    """Cut the added strips of straight, axis-parallel roads out of every lot they cross.

    ``roads(site_id, x1, y1, x2, y2, width_m, new_width_m)``: any number of widened roads per site.  All strips of a lot
    cut it together, so no land is kept twice; the pieces are the gaps between the strips, across
    times along, numbered from 1 by ``(x, y)``.  Pieces up to ``min_piece`` vanish; narrowing changes nothing, and a lot
    that no strip meets stays whole as piece 0.  Roads of another direction are an error.

    A lot is shuffled once, to the list of the strips around its cell, and cut where it is.
    """
    grow = F.col("new_width_m") - F.col("width_m")
    vertical, horizontal = F.col("x1") == F.col("x2"), F.col("y1") == F.col("y2")
    r = roads.filter(grow > min_change).select(
        "site_id",
        (F.least("x1", "x2") - F.when(vertical, grow / 2).otherwise(0.0)).alias("x"),
        (F.least("y1", "y2") - F.when(horizontal, grow / 2).otherwise(0.0)).alias("y"),
        F.when(vertical, grow).otherwise(F.abs(F.col("x2") - F.col("x1"))).alias("w"),
        F.when(horizontal, grow).when(vertical, F.abs(F.col("y2") - F.col("y1"))).otherwise(
            F.raise_error(F.lit("a widened road is not axis-parallel")).cast("double")).alias("h"),
        vertical.alias("vertical"),
    )
    ids = ["layout_id", "plot_no"]
    lean = lots.select("site_id", *ids, "x", "y", "w", "h")
    box = g.rect_of()
    near = with_near(lean, r, ["site_id"], "_r", 0.0, cell_m)
    crossing = F.filter("_r", lambda s: g.rect_overlap(box, {k: s[k] for k in "xywh"}) > 0)
    strips = g.materialize(near, _s=crossing)

    def cuts(mine: Callable[[Column], Column], lo: str, side: str) -> Column:
        return F.array_sort(F.transform(F.filter("_s", mine), lambda s: F.struct(s[lo].alias("lo"), (s[lo] + s[side]).alias("hi"))))

    x, y = F.col("x"), F.col("y")
    gaps = F.struct(
        _gaps(x, x + F.col("w"), cuts(lambda s: s["vertical"], "x", "w")).alias("x"),
        _gaps(y, y + F.col("h"), cuts(lambda s: ~s["vertical"], "y", "h")).alias("y"),
    )

    def pieces(gap: Column) -> Column:
        every = F.flatten(F.transform(gap["x"], lambda a: F.transform(gap["y"], lambda b: F.struct(
            a["a"].alias("x"), b["a"].alias("y"), (a["b"] - a["a"]).alias("w"), (b["b"] - b["a"]).alias("h")))))
        kept = F.filter(every, lambda p: p["w"] * p["h"] > min_piece)
        return F.transform(kept, lambda p, k: F.struct((k + 1).alias("piece"), p["x"].alias("x"), p["y"].alias("y"), p["w"].alias("w"), p["h"].alias("h")))

    whole = F.array(F.struct(F.lit(0).alias("piece"), "x", "y", "w", "h"))
    met = F.coalesce(F.size("_s") > 0, F.lit(False))
    return strips.select("site_id", *ids, F.explode(F.when(met, g.let(gaps, pieces)).otherwise(whole)).alias("_p")).select(
        "site_id", *ids, "_p.piece", "_p.x", "_p.y", "_p.w", "_p.h"
    )
