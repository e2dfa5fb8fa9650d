"""Edit logs folded in the order of the log: scaling of whole designs, moves, deletions, added roads.

Scaling a design about its centre and moving one of its elements do not commute.  The fold therefore keeps, for each
design, the product ``scale`` of its factors, and for each element the sum of its moves, every move divided by the
product at its place in the log.  An element first at ``p`` ends at ``c + scale * (p - c + moved)``.  Such states are
those of affine maps and form a monoid: ``then`` puts the fold of a later part of the log behind that of an earlier
one, so a table, two tables and a stream give the same state, and a scale edit never touches the elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.prefix import ranked

ELEMENT = ("design_id", "target")
#: Edits that need an element under their name.
NAMED = ("move", "delete", "convert_to_green")


def bad_factor() -> Column:
    """Scale edits whose factor is null, not finite or not above zero; they are refused."""
    f = F.col("factor")
    return (F.col("action") == "scale") & ~F.coalesce((f > 0) & (f < float("inf")), F.lit(False))


def _born() -> Column:
    """Number of the edit that adds the road of this name; null for other names."""
    return F.regexp_extract(F.coalesce("target", F.lit("")), r"^R([0-9]{1,18})$", 1).try_cast("long")


def at_scale(edits: DataFrame) -> DataFrame:
    """Edits with ``at_scale``: product of the factors of their design up to and with this edit.

    A running sum over ranges of the log, so a design that holds most of the log is no single task.
    """
    ln = F.when((F.col("action") == "scale") & ~bad_factor(), F.ln("factor")).otherwise(0.0)
    r = ranked(edits.withColumn("_ln", ln), ["design_id"], "edit_no", sums=["_ln"])
    return r.select(*edits.columns, F.exp(F.col("_ln_before") + F.col("_ln")).alias("at_scale"))


def fold_log(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits(design_id, edit_no, action, target, dx, dy, factor)`` as ``(designs, elements)``.

    ``designs(design_id, scale, last_no)``; ``elements(design_id, target, moved_x, moved_y, deleted, to_green, n_edits,
    n_late)`` counts the named edits up to the first deletion and those after it, which find no element.  An edit that
    names a road before the edit that adds it counts as late, too.  ``edit_no`` is unique in a design; null moves
    are moves by 0.
    """
    designs = edits.groupBy("design_id").agg(
        F.exp(F.sum(F.when((F.col("action") == "scale") & ~bad_factor(), F.ln("factor")).otherwise(0.0))).alias("scale"),
        F.max("edit_no").alias("last_no"),
    )
    named = at_scale(edits).filter(F.col("action").isin(*NAMED) & F.col("target").isNotNull())
    early = F.coalesce(F.col("edit_no") <= _born(), F.lit(False))
    gone = named.filter((F.col("action") == "delete") & ~early).groupBy(*ELEMENT).agg(F.min("edit_no").alias("_gone"))
    late = early | F.coalesce(F.col("edit_no") > F.col("_gone"), F.lit(False))
    marked = named.join(gone, list(ELEMENT), "left").withColumn("_late", late)
    moves = (F.col("action") == "move") & ~F.col("_late")

    def moved(c: str) -> Column:
        return F.coalesce(F.sum(F.when(moves, F.col(c) / F.col("at_scale"))), F.lit(0.0))

    return designs, marked.groupBy(*ELEMENT).agg(
        moved("dx").alias("moved_x"),
        moved("dy").alias("moved_y"),
        F.bool_or((F.col("action") == "delete") & ~F.col("_late")).alias("deleted"),
        F.bool_or((F.col("action") == "convert_to_green") & ~F.col("_late")).alias("to_green"),
        F.count_if(~F.col("_late")).alias("n_edits"),
        F.count_if(F.col("_late")).alias("n_late"),
    )


def then(first: tuple[DataFrame, DataFrame], later: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The fold of two parts of a log from the folds of the parts; all of ``later`` comes after ``first``."""
    (d1, e1), (d2, e2) = first, later
    one, zero, no = F.lit(1.0), F.lit(0.0), F.lit(False)
    b = d2.select("design_id", F.col("scale").alias("_s2"), F.col("last_no").alias("_n2"))
    designs = d1.join(b, "design_id", "full").select(
        "design_id",
        (F.coalesce("scale", one) * F.coalesce("_s2", one)).alias("scale"),
        F.greatest("last_no", "_n2").alias("last_no"),
    )
    names = ("moved_x", "moved_y", "deleted", "to_green", "n_edits", "n_late")
    after = e2.select(*ELEMENT, *[F.col(c).alias(f"_{c}") for c in names])
    j = e1.join(after, list(ELEMENT), "full").join(d1.select("design_id", F.col("scale").alias("_s")), "design_id", "left")
    dead, count = F.coalesce("deleted", no), lambda c: F.coalesce(c, F.lit(0).cast("long"))

    def moved(c: str) -> Column:
        return F.coalesce(c, zero) + F.when(dead, 0.0).otherwise(F.coalesce(f"_{c}", zero) / F.coalesce("_s", one))

    elements = j.select(
        *ELEMENT,
        moved("moved_x").alias("moved_x"),
        moved("moved_y").alias("moved_y"),
        (dead | F.coalesce("_deleted", no)).alias("deleted"),
        (F.coalesce("to_green", no) | (~dead & F.coalesce("_to_green", no))).alias("to_green"),
        (count("n_edits") + F.when(dead, 0).otherwise(count("_n_edits"))).alias("n_edits"),
        (count("n_late") + count("_n_late") + F.when(dead, count("_n_edits")).otherwise(0)).alias("n_late"),
    )
    return designs, elements


def final_elements(
    elements: DataFrame, centres: DataFrame, fold: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """Live elements ``(design_id, target, kind, x, y, w, h)`` after the fold; lots and blocks may have become green.

    ``centres(design_id, cx, cy)`` is what a design is scaled about; a design without one stays unscaled.
    """
    designs, folded = fold
    d = designs.select("design_id", "scale").join(centres, "design_id").filter("cx is not null and cy is not null")
    j = elements.join(folded.select(*ELEMENT, "moved_x", "moved_y", "deleted", "to_green"), list(ELEMENT), "left")
    j = j.filter(~F.coalesce("deleted", F.lit(False))).join(d, "design_id", "left")
    k = F.coalesce("scale", F.lit(1.0))

    def at(p: str, c: str) -> Column:
        centre = F.coalesce(c, F.lit(0.0))
        return centre + k * (F.col(p) - centre + F.coalesce(f"moved_{p}", F.lit(0.0)))

    green = F.coalesce("to_green", F.lit(False)) & F.col("kind").isin("lot", "block")
    return j.select(
        *ELEMENT, F.when(green, "green").otherwise(F.col("kind")).alias("kind"),
        at("x", "cx").alias("x"), at("y", "cy").alias("y"), (F.col("w") * k).alias("w"), (F.col("h") * k).alias("h"),
    )


def final_roads(
    edits: DataFrame, outlines: DataFrame, fold: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """Added roads after the fold: ``design_id, target, part, x1, y1, x2, y2``.

    ``add_road`` edits carry ``x1, y1, x2, y2``; the road is named ``R<edit_no>`` and may be moved and deleted under that
    name.  It is clipped to ``outlines(design_id, ring)`` when it is added, each part inside is kept, and it is scaled
    with the design from then on.  A road without any part inside has no row; ``refused_edits`` names it.
    """
    designs, folded = fold
    drawn = _clipped(edits, outlines).select("design_id", "edit_no", "at_scale", "_c", F.posexplode("_parts").alias("part", "_p"))
    drawn = drawn.withColumn("target", F.concat(F.lit("R"), F.col("edit_no").cast("string")))
    j = drawn.join(folded.select(*ELEMENT, "moved_x", "moved_y", "deleted"), list(ELEMENT), "left")
    j = j.filter(~F.coalesce("deleted", F.lit(False))).join(designs.select("design_id", "scale"), "design_id")

    def at(i: int, axis: str) -> Column:
        centre, p = F.col("_c")[axis], F.col("_p")[i][axis]
        moved = F.coalesce(f"moved_{axis}", F.lit(0.0))
        return centre + F.col("scale") * ((p - centre) / F.col("at_scale") + moved)

    return j.select(
        *ELEMENT, (F.col("part") + 1).alias("part"), at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2")
    )


def _clipped(edits: DataFrame, outlines: DataFrame) -> DataFrame:
    added = at_scale(edits).filter(F.col("action") == "add_road").join(outlines, "design_id")
    parts = g.clip_segment(g.pt(F.col("x1"), F.col("y1")), g.pt(F.col("x2"), F.col("y2")), F.col("ring"))
    # a road that touches the outline leaves parts without length
    long = F.filter(parts, lambda p: F.hypot(p[1].x - p[0].x, p[1].y - p[0].y) > g.EPS)
    return g.materialize(added, _parts=long, _c=g.centroid(F.col("ring")))


def refused_edits(
    edits: DataFrame, elements: DataFrame, outlines: DataFrame, fold: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """``design_id, target, reason, n``: edits that changed nothing, because their element is not there (``unknown``) or is
    gone or not yet there (``late``), their road lies outside the outline (``outside``) or their factor is no scale
    (``bad_factor``)."""
    folded = fold[1]
    n = lambda df, reason: df.groupBy(*ELEMENT).agg(F.count("*").alias("n")).select(*ELEMENT, F.lit(reason).alias("reason"), "n")
    drawn = _clipped(edits, outlines).withColumn("target", F.concat(F.lit("R"), F.col("edit_no").cast("string")))
    known = elements.select(*ELEMENT).unionByName(drawn.filter(F.size("_parts") > 0).select(*ELEMENT))
    unknown = folded.join(known, list(ELEMENT), "left_anti")
    late = folded.join(known, list(ELEMENT), "left_semi").filter("n_late > 0")
    return (
        unknown.select(*ELEMENT, F.lit("unknown").alias("reason"), (F.col("n_edits") + F.col("n_late")).alias("n"))
        .unionByName(late.select(*ELEMENT, F.lit("late").alias("reason"), F.col("n_late").alias("n")))
        .unionByName(n(drawn.filter(F.size("_parts") == 0), "outside"))
        .unionByName(n(edits.filter(bad_factor()), "bad_factor"))
    )
