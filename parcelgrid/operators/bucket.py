"""Bucketed spatial joins.

A bounding box is expanded into the integer grid cells it touches; boxes meet through an equi-join on
``(keys, cell_x, cell_y)``, so Spark shuffles by cell and never plans a nested loop.  A pair that shares
several cells is kept in its smallest common cell only, hence no ``distinct`` is needed afterwards.

A hot site or layout is spread over its cells.  A hot cell is split by AQE's skew join: nothing after
the join relies on the cell partitioning, so Spark is free to do that.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import geometry as g

BOX = ("x", "y", "w", "h")
#: Cell sizes of the levels of :func:`near_home`, as multiples of the smallest.
STEPS = (1, 4, 16, 64)
HOME = ("_lv", "_hx", "_hy")


def _cells(df: DataFrame, cell_m: float, grow: float, cx: str, cy: str) -> DataFrame:
    """One row per touched cell; ``cx0``/``cy0`` keep the first cell of the box."""

    def first(lo: str) -> Column:
        return F.floor((F.col(lo) - grow) / cell_m)

    def last(lo: str, side: str) -> Column:
        return F.floor((F.col(lo) + F.col(side) + grow) / cell_m)

    return (
        df.withColumn(f"{cx}0", first("x"))
        .withColumn(f"{cy}0", first("y"))
        .withColumn(cx, F.explode(F.sequence(F.col(f"{cx}0"), last("x", "w"))))
        .withColumn(cy, F.explode(F.sequence(F.col(f"{cy}0"), last("y", "h"))))
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, before each of them is expanded or worked on at length.

    A small file of sites is one task, and adaptive execution would merge the few bytes into one again; a number that is
    given is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that has a row for each point, edge or component.

    The planner goes by the size of files, which hold such rows in a tenth of the memory that they take on the driver, so
    it would gather a million of them there; the sides are shuffled and merged at any size.
    """
    return df.hint("merge")


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    within: float | Column = 0.0,
    cell_m: float = 100.0,
    condition: Column | None = None,
    how: str = "inner",
    max_within: float | None = None,
    few: bool = False,
) -> DataFrame:
    """Pairs of boxes of the same key whose distance is at most ``within``.

    Both inputs carry ``keys`` and ``x, y, w, h``.  Other columns of ``left`` keep their name, those of
    ``right`` get the suffix ``_b``.  The measured ``gap_m`` and ``overlap_sqm`` of the boxes are added.
    ``within`` may be a column over the joined row when ``max_within`` bounds it.

    The planner knows neither how many rows a generator made nor how many cells they touch, so by its estimate it would
    gather either side on the driver.  Both sides are shuffled and merged instead, unless ``few`` says that ``right`` is
    a handful of rows at any size of the other tables.
    """
    reach = float(within) if max_within is None else float(max_within)
    a = _cells(left, cell_m, reach, "_cx", "_cy")
    renamed = right.select(
        *[F.col(k) for k in keys], *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in keys]
    )
    b = _cells(
        renamed.select("*", *[F.col(f"{c}_b").alias(c) for c in BOX]), cell_m, 0.0, "_dx", "_dy"
    ).drop(*BOX)
    box_a, box_b = g.rect_of(), {k: F.col(f"{k}_b") for k in BOX}
    left_keys = {k: f"_k_{k}" for k in keys}
    for k, new in left_keys.items():
        b = b.withColumnRenamed(k, new)
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy"))
    for k, new in left_keys.items():
        on = on & (F.col(k) == F.col(new))
    on = (
        on
        & (F.col("_cx") == F.greatest("_cx0", "_dx0"))
        & (F.col("_cy") == F.greatest("_cy0", "_dy0"))
        & (g.rect_gap(box_a, box_b) <= within)
    )
    if condition is not None:
        on = on & condition
    joined = a.join(b if few else merged(b), on, how)
    met = F.col("x_b").isNotNull()  # greatest/least skip nulls, so an unmatched row needs its own null
    return joined.select(
        "*",
        F.when(met, g.rect_gap(box_a, box_b)).alias("gap_m"),
        F.when(met, g.rect_overlap(box_a, box_b)).alias("overlap_sqm"),
    ).drop("_cx", "_cy", "_cx0", "_cy0", "_dx", "_dy", "_dx0", "_dy0", *left_keys.values())


def _placed() -> Column:
    return (F.col("x") + F.col("y") + F.col("w") + F.col("h")).isNotNull()


def _at_home(df: DataFrame, cell_m: float) -> DataFrame:
    """``_lv, _hx, _hy``: the level whose cells are as large as the box, and the one that holds its lower left corner.

    Boxes larger than the cells of the last level have all of their key as their cell.
    """
    far, level, size = F.greatest("w", "h"), F.lit(len(STEPS)), F.lit(None).cast("double")
    for k, step in reversed(list(enumerate(STEPS))):
        level = F.when(far <= cell_m * step, k).otherwise(level)
        size = F.when(far <= cell_m * step, cell_m * step).otherwise(size)
    # without a place there is no home; the distance of boxes skips nulls
    cell = [F.when(_placed(), F.coalesce(F.floor(F.col(c) / size), F.lit(0).cast("long"))) for c in "xy"]
    return df.withColumns(dict(zip(HOME, [level, *cell])))


def _around(df: DataFrame, within: float, cell_m: float) -> DataFrame:
    """One row for each cell of each level that a box within reach may have as its home."""
    levels = [F.struct(F.lit(k).alias("k"), F.lit(float(cell_m * step)).alias("size")) for k, step in enumerate(STEPS)]
    every = F.struct(F.lit(len(STEPS)).alias("k"), F.lit(None).cast("double").alias("size"))
    size, grow = F.col("_lv.size"), within + 1e-6

    def cells(lo: str, side: str) -> Column:
        first, last = F.floor((F.col(lo) - grow) / size) - 1, F.floor((F.col(lo) + F.col(side) + grow) / size)
        return F.explode(F.when(size.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last)))

    return (
        df.filter(_placed())
        .withColumn("_lv", F.explode(F.array(*levels, every)))
        .withColumn("_hx", cells("x", "w"))
        .withColumn("_hy", cells("y", "h"))
        .withColumn("_lv", F.col("_lv.k"))
    )


def _home_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell_m: float, condition: Column | None, how: str) -> DataFrame:
    """``left`` at home joined with ``right`` around; columns of ``right`` that are in the way end in ``_b``."""
    on_keys = [*keys, *HOME]
    b = right.withColumnsRenamed({k: f"_k_{k}" for k in on_keys})
    on = F.lit(True) if condition is None else condition
    for k in on_keys:
        on = (F.col(k) == F.col(f"_k_{k}")) & on
    return _at_home(left, cell_m).join(merged(b), on, how).drop(*on_keys[len(keys):], *[f"_k_{k}" for k in on_keys])


def near_home(
    left: DataFrame, right: DataFrame, keys: Sequence[str], within: float = 0.0, cell_m: float = 250.0, how: str = "inner"
) -> DataFrame:
    """Pairs as of :func:`near_pairs`, with ``gap_m``, for many boxes on the left and fewer on the right.

    A row on the left is shuffled once, whatever its size and the reach: it stands in one cell, of a size like its own, and
    the rows on the right are expanded into the cells around them instead.
    """
    b = _around(right, within, cell_m).withColumnsRenamed({c: f"{c}_b" for c in right.columns if c not in keys})
    gap = g.rect_gap(g.rect_of(), {k: F.col(f"{k}_b") for k in BOX})
    joined = _home_join(left, b, keys, cell_m, gap <= within, how)
    return joined.withColumn("gap_m", F.when(F.col("x_b").isNotNull(), gap))


def with_near(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str, within: float = 0.0, cell_m: float = 250.0) -> DataFrame:
    """Every row on the left with the list ``name`` of the rows on the right that may be within reach, null where none is.

    The list is that of the cell; the exact test is left to the caller.  Rows on the left meet one row each.
    """
    around = _around(right, within, cell_m)
    rest = [c for c in right.columns if c not in keys]
    return _home_join(left, around.groupBy(*keys, *HOME).agg(F.collect_list(F.struct(*rest)).alias(name)), keys, cell_m, None, "left")


def own_pairs(
    items: DataFrame, keys: Sequence[str], within: float, condition: Column, cell_m: float = 1000.0, few: int = 64
) -> DataFrame:
    """Pairs of ``near_pairs(items, items, ...)`` with their columns, for tables of many small groups.

    The boxes of a key within a cell as large as a usual site are one list, so they are shuffled once and meet without a
    join.  A list of more than ``few`` boxes is taken apart again and goes through finer cells.
    """

    def first(c: str) -> Column:
        return F.floor((F.col(c) - within) / cell_m)

    cell = [*keys, "_tx", "_ty"]
    columns = [c for c in items.columns if c not in keys]
    # the join below asks for keys that are not null; the same filter here lets both parts read one shuffle
    items = items.filter(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    # in plain rows: lists begun before the shuffle would hold a box or two each
    tiles = _cells(items, cell_m, within, "_tx", "_ty").select(*cell, *columns).repartition(*cell)
    lists = tiles.groupBy(*cell).agg(F.collect_list(F.struct(*columns)).alias("_l"))
    # the pair is kept in its smallest common cell
    here = (F.col("_tx") == F.greatest(first("x"), first("x_b"))) & (F.col("_ty") == F.greatest(first("y"), first("y_b")))
    box_b = {k: F.col(f"{k}_b") for k in BOX}
    met = here & (g.rect_gap(g.rect_of(), box_b) <= within) & condition
    each = lists.filter((F.size("_l") > 1) & (F.size("_l") <= few)).select(*cell, "_l", F.explode("_l").alias("_a"))
    pairs = each.select(*cell, "_a", F.explode("_l").alias("_b")).select(
        *cell, *[F.col(f"_a.{c}").alias(c) for c in columns], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in columns]
    ).filter(met)
    pairs = pairs.withColumns({"gap_m": g.rect_gap(g.rect_of(), box_b), "overlap_sqm": g.rect_overlap(g.rect_of(), box_b)})
    many = lists.filter(F.size("_l") > few).select(*cell, F.inline("_l"))
    fine = near_pairs(many, many, cell, within, cell_m / 10, condition).filter(here)
    return pairs.unionByName(fine.select(pairs.columns)).drop("_tx", "_ty")


def with_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Bounding box columns of a ring, for items that are not rectangles."""
    return (
        df.withColumn("_b", g.bounds(F.col(ring)))
        .withColumn("x", F.col("_b.minx"))
        .withColumn("y", F.col("_b.miny"))
        .withColumn("w", F.col("_b.maxx") - F.col("_b.minx"))
        .withColumn("h", F.col("_b.maxy") - F.col("_b.miny"))
        .drop("_b")
    )
