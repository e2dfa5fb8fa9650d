"""Candidate sweeps and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.functions import geometry as g
from parcelgrid.operators.bucket import spread
from parcelgrid.operators.generate import grid_candidates, grid_network
from parcelgrid.operators.prefix import ranked
from parcelgrid.operators.raster import dead_area
from parcelgrid.session import cut_lineage


def sweep_grid(
    sites: DataFrame, spacings: Sequence[float], turns: Sequence[tuple[int, float, float]], good: float = 0.65,
    fragment: float = 0.1,
) -> DataFrame:
    """Best spacing and turn per site: most usable area in good cells, then fewest fragments.

    The candidate list is a literal array exploded per site, so nothing is joined; the cells are counted on
    the map side before they are shuffled by candidate.
    """
    options = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("spacing"), F.lit(no).alias("quarter"), F.lit(c).alias("cos"), F.lit(n).alias("sin")
            )
            for s in spacings
            for no, c, n in turns
        ]
    )
    # heavy rows: spread candidates over all tasks before cells are cut
    cand = sites.select("*", F.explode(options).alias("_o")).select("site_id", "ring", "_o.*")
    cand = cand.repartition("site_id", "spacing", "quarter")
    cells = grid_candidates(cand, F.col("spacing"), F.col("cos"), F.col("sin"))
    r = F.col("ratio")
    scored = cells.groupBy("site_id", "spacing", "quarter").agg(
        F.round(F.sum(F.when(r > good, F.col("usable_sqm")).otherwise(0.0)), 2).alias("good_sqm"),
        F.count_if((r > fragment) & (r <= good)).alias("fragments"),
    )
    best = F.max_by(
        F.struct("spacing", "quarter", "good_sqm", "fragments"),
        F.struct(F.col("good_sqm"), -F.col("fragments"), -F.col("spacing"), -F.col("quarter")),
    )
    return scored.groupBy("site_id").agg(best.alias("_b")).select("site_id", "_b.*")


def _dominates(p: Column, q: Column, k: int) -> Column:
    """``p`` is at least as good as ``q`` everywhere and better somewhere (smaller is better)."""
    le, lt = F.lit(True), F.lit(False)
    for i in range(1, k + 1):
        le = le & (p[f"f{i}"] <= q[f"f{i}"])
        lt = lt | (p[f"f{i}"] < q[f"f{i}"])
    return le & lt


#: Vectors of a block of the Pareto front; a block is compared with itself by all pairs.
BLOCK_VECTORS = 512


def _blocks(vectors: DataFrame, key: str, fs: Sequence[str]) -> DataFrame:
    """Vectors with ``_s, _b``: even stripes by the first objective, even blocks of a stripe by the second."""
    r = ranked(vectors, [key], fs)
    stripes = F.ceil(F.sqrt(F.col("n") / BLOCK_VECTORS))
    r = r.withColumn("_s", F.floor((F.col("rn") - 1) * stripes / F.col("n"))).drop("rn", "n")
    stripe = Window.partitionBy(key, "_s")
    n, at = F.count("*").over(stripe), F.row_number().over(stripe.orderBy(*fs[1:], fs[0])) - 1
    r = r.withColumns({"_n": n, "_at": at})
    return r.withColumn("_b", F.floor(F.col("_at") * F.ceil(F.col("_n") / BLOCK_VECTORS) / F.col("_n"))).drop("_n", "_at")


def pareto_front(objectives: DataFrame, k: int, key: str = "site_id") -> DataFrame:
    """Candidates no other candidate of the same key dominates (smaller is better); a null objective is the best one.

    Equal objective vectors are tested once.  A few strong vectors per key - the best by each objective and by their
    sums, found by one aggregate - remove almost everything.  The rest is cut into even blocks by its first two
    objectives: each block keeps its own front, and a vector then goes to those other blocks only whose worst corner it
    could dominate.  Blocks are compared by their corners, vectors never by their site.
    """
    fs = [f"f{i}" for i in range(1, k + 1)]
    objectives = cut_lineage(objectives)  # read three times
    low = objectives.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in fs})
    vectors = low.select(key, *fs).distinct()
    v = F.struct(*fs)
    orders = [F.struct(F.col(f), *[F.col(x) for x in fs]) for f in fs]
    orders += [F.struct(F.col(a) + F.col(b), *[F.col(x) for x in fs]) for i, a in enumerate(fs) for b in fs[i + 1:]]
    strong = vectors.groupBy(key).agg(F.array_distinct(F.array(*[F.min_by(v, o) for o in orders])).alias("_strong"))
    left = vectors.join(strong, vectors[key].eqNullSafe(strong[key])).drop(strong[key]).filter(
        ~F.exists("_strong", lambda s: _dominates(s, v, k))
    ).drop("_strong")
    block = [key, "_s", "_b"]
    cut = cut_lineage(_blocks(left, key, fs))

    def beaten(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows that none of ``others(_k0, _k1, _k2, _q)`` in the same block dominates."""
        same = F.col(key).eqNullSafe(F.col("_k0")) & (F.col("_s") == F.col("_k1")) & (F.col("_b") == F.col("_k2"))
        return rows.withColumn("_p", v).join(others, same & _dominates(F.col("_q"), F.col("_p"), k), "left_anti").drop("_p")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(block)], v.alias("_q"))

    own = cut_lineage(beaten(cut, renamed(cut)))
    corners = own.groupBy(*block).agg(*[F.min(f).alias(f"lo_{f}") for f in fs], *[F.max(f).alias(f"hi_{f}") for f in fs])
    worst = corners.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(block)], *[f"hi_{f}" for f in fs])
    reach = F.col(key).eqNullSafe(F.col("_k0")) & ((F.col("_s") != F.col("_k1")) | (F.col("_b") != F.col("_k2")))
    for f in fs:
        reach &= F.col(f"lo_{f}") <= F.col(f"hi_{f}")
    targets = corners.select(*block, *[f"lo_{f}" for f in fs]).join(worst, reach).select(
        *block, "_k0", "_k1", "_k2", *[f"hi_{f}" for f in fs]
    ).withColumnRenamed(key, "_from")
    sent = own.join(
        targets, own[key].eqNullSafe(targets["_from"]) & (own["_s"] == targets["_s"]) & (own["_b"] == targets["_b"])
    )
    for f in fs:
        sent = sent.filter(F.col(f) <= F.col(f"hi_{f}"))
    front = beaten(own, sent.select("_k0", "_k1", "_k2", v.alias("_q"))).select(
        F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fs]
    )
    on = F.col(key).eqNullSafe(F.col("_key"))
    for f in fs:
        on &= F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) == F.col(f"_{f}")
    return objectives.join(front, on, "left_semi")


def road_spacing_sweep(
    sites: DataFrame, max_distance: float = 200.0, setback: float = 50.0, max_ratio: float = 0.25, size: float = 20.0
) -> DataFrame:
    """Spacings 2d, x0.8 while >= d/2 as rows: the first whose dead area is below 5 % of the buildable area and
    whose roads fit the budget, else the last one.  All steps of all sites run as one plan."""
    steps, s = [], 2.0 * max_distance
    while s >= max_distance / 2:
        steps.append(s)
        s *= 0.8
    options = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(v).alias("spacing")) for i, v in enumerate(steps)])
    cand = sites.withColumn("_o", F.explode(options)).select("site_id", "ring", "_o.step", "_o.spacing")
    net = cut_lineage(grid_network(
        spread(cand, "site_id", "step"), F.col("spacing"), F.col("spacing") * 2, setback, extra=["step", "spacing"]
    ))
    road = net.groupBy("site_id", "step", "spacing").agg(
        F.sum(F.col("length_m") * F.col("width_m")).alias("road_sqm"), F.sum("length_m").alias("road_m")
    )
    lines = net.select("site_id", "step", "path")
    dead = dead_area(spread(sites, "site_id"), lines, max_distance, size, cand.select("site_id", "step"))
    base = g.materialize(sites, buildable_sqm=g.area(g.inset(F.col("ring"), setback))).select("site_id", "buildable_sqm")
    every = cand.select("site_id", "step", "spacing").join(base, "site_id")
    j = every.join(road.drop("spacing"), ["site_id", "step"], "left").join(dead, ["site_id", "step"], "left")
    zero = F.lit(0.0)
    dead_sqm, road_sqm = F.coalesce("dead_sqm", zero), F.coalesce("road_sqm", zero)
    ok = (dead_sqm < F.col("buildable_sqm") * 0.05) & (road_sqm <= F.col("buildable_sqm") * max_ratio)
    pick = F.struct("step", "spacing", road_sqm.alias("road_sqm"), dead_sqm.alias("dead_sqm"), ok.alias("accepted"))
    rank = F.when(ok, F.col("step")).otherwise(F.lit(10_000) - F.col("step"))
    return j.groupBy("site_id").agg(F.min_by(pick, rank).alias("_p")).select("site_id", "_p.*")
