"""Ordering, naming, allocation and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.operators.prefix import ranked


def allocate_service_blocks(blocks: DataFrame, keys: Sequence[str], block_id: str, ratio: float = 0.1) -> DataFrame:
    """Lowest blocks become service land while the area before them is below ``ratio`` of the total.

    The highest block stays commercial: it could only be service when every other block is, and then the
    rule gives it back.
    """
    r = ranked(blocks, keys, "z", block_id, ["area_sqm"])
    service = (F.col("area_sqm_before") < F.col("area_sqm_total") * ratio) & (F.col("rn") < F.col("n"))
    return r.withColumn("use", F.when(service, "service").otherwise("commercial"))


def classify_blocks(
    blocks: DataFrame, keys: Sequence[str], block_id: str, ratio: float = 0.1, cap: float = 0.3
) -> DataFrame:
    """Lowest block treats wastewater, service blocks are spread evenly over the rest, others are commercial."""
    r = ranked(blocks, keys, "z", block_id, ["area_sqm"])
    lowest = r.filter("rn = 1").select(*keys, F.col("area_sqm").alias("_low"))
    r = r.join(lowest, list(keys))
    rest = (F.col("n") - 1).cast("double")
    avg = F.try_divide(F.col("area_sqm_total") - F.col("_low"), rest)
    wanted = F.floor(F.try_divide(F.col("area_sqm_total") * ratio, avg))
    k = F.greatest(F.lit(1), F.least(wanted, F.floor(rest * cap)))
    r = r.withColumn("_k", k.cast("double")).withColumn("_step", F.try_divide(rest, F.col("_k")))
    i = (F.col("rn") - 2).cast("double")
    near = F.floor(F.try_divide(i, F.col("_step")))
    chosen = F.exists(
        F.array(near, near + 1),
        lambda j: (j < F.col("_k")) & (F.floor(j * F.col("_step")) == i),
    )
    use = (
        F.when(F.col("rn") == 1, "xlnt")
        .when((F.col("_k") >= rest) | chosen, "service")
        .otherwise("commercial")
    )
    return r.withColumn("use", use).drop("_low", "_k", "_step")


def name_elements(elements: DataFrame, keys: Sequence[str], order: str, tie: str, prefix: Column) -> DataFrame:
    """``L1, L2, ..`` per group and prefix, renumbered whenever it runs."""
    r = ranked(elements.withColumn("_p", prefix), [*keys, "_p"], order, tie)
    return (
        r.withColumn("name", F.concat(F.col("_p"), F.col("rn").cast("string")))
        .withColumn("label", F.format_string("%s_%03d", F.when(F.col("_p") == "G", "green").otherwise("plot"),
                                             F.col("rn") - 1))
        .drop("_p", "n")
    )


def largest_part(parts: DataFrame, keys: Sequence[str], part_no: str, value: str, area: str = "area_sqm") -> DataFrame:
    """The part of largest area per group; the first one wins a tie."""
    return parts.groupBy(*keys).agg(
        F.max_by(F.struct(part_no, value, area), F.struct(F.col(area), -F.col(part_no))).alias("_m")
    ).select(*keys, f"_m.{part_no}", f"_m.{value}", f"_m.{area}")


# fixed values: names of the options, best first
OPTION_NAMES = ("Maximum Profit", "Balanced", "Premium")


def top_options(scored: DataFrame, keys: Sequence[str], score: str, tie: str, k: int = 3) -> DataFrame:
    """Best ``k`` per group, named; Spark prunes to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    top = scored.withColumn("option_no", F.row_number().over(w)).filter(F.col("option_no") <= k)
    names = F.array(*[F.lit(n) for n in OPTION_NAMES])
    return top.withColumn(
        "option_name",
        F.coalesce(F.try_element_at(names, F.col("option_no")), F.concat(F.lit("Option "), F.col("option_no"))),
    )


def first_violation(pairs: DataFrame, keys: Sequence[str], a: str, b: str, extra: str) -> DataFrame:
    """First offender in plot order per group: an aggregate, so groups are reduced before the shuffle."""
    return pairs.groupBy(*keys).agg(
        F.min(F.struct(a, b, extra)).alias("_f"), F.count("*").alias("n_violations")
    ).select(*keys, f"_f.{a}", f"_f.{b}", f"_f.{extra}", "n_violations")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per group with their ``rn``; Spark prunes each task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def list_elements(
    elements: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 10, prefix: str = "L"
) -> DataFrame:
    """Names of the first ``limit`` elements per group, and one line for the remaining ones.

    Nothing is ranked beyond the listed rows: the rest is the group's count and area less theirs.
    """
    head = first_rows(elements.select(*keys, *order, "area_sqm"), keys, order, limit)
    lines = head.select(
        *keys, F.col("rn").cast("long").alias("line_no"), F.concat(F.lit(prefix), F.col("rn").cast("string")).alias("line"),
        "area_sqm",
    )
    total = elements.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("area_sqm").alias("_area"))
    listed = lines.groupBy(*keys).agg(F.sum("area_sqm").alias("_listed"))
    tail = total.filter(F.col("_n") > limit).join(listed, list(keys)).select(
        *keys, F.lit(limit + 1).cast("long").alias("line_no"),
        F.format_string(f"{prefix}{limit + 1}-{prefix}%d", "_n").alias("line"),
        (F.col("_area") - F.col("_listed")).alias("area_sqm"),
    )
    return lines.unionByName(tail)


def element_info(named: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look up names; a malformed or unknown name gives an error row."""
    clean = F.upper(F.trim(F.col("asked")))
    a = asked.withColumn("name", F.when(clean.rlike("^[RBL][0-9]+$"), clean))
    j = a.join(named.select(*keys, "name", "area_sqm", "cx", "cy"), [*keys, "name"], "left")
    status = (
        F.when(F.col("name").isNull(), "bad name").when(F.col("area_sqm").isNull(), "not found").otherwise("ok")
    )
    return j.withColumn("status", status)


def evict_oldest(sessions: DataFrame, order: str, session_id: str, limit: int = 1000) -> DataFrame:
    """Sessions that stay: once ``limit`` is reached the oldest tenth, at least one, goes.

    Two estimated quantiles enclose the last session to go; only sessions between them are ranked, and they count from
    the exact number of those before.  The estimate decides how many rows that are, never which sessions go.
    """
    n = sessions.count()
    if n < limit:
        return sessions
    drop = max(1, n // 10)
    share, error = drop / n, 0.001
    low, high = sessions.agg(
        F.percentile_approx(order, [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], round(1 / error)).alias("q")
    ).first().q
    before = sessions.filter(F.col(order) < low).count() + sessions.filter(F.col(order).isNull()).count()
    if before >= drop or sessions.filter(F.col(order) <= high).count() + before < drop:
        low, high, before = None, None, 0
    near = sessions if low is None else sessions.filter(F.col(order).between(low, high))
    stay = ranked(near, [], order, session_id).filter(F.col("rn") > drop - before).select(*sessions.columns)
    return stay if low is None else stay.unionByName(sessions.filter(F.col(order) > high))
