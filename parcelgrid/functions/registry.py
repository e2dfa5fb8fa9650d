"""Functions and actions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

# SQL functions over a rectangle or a pair of them; their bodies stay visible to Catalyst
SQL_FUNCTIONS: dict[str, str] = {
    "elevation_at": "(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN 50 - 0.02D * x - 0.03D * y",
    "legal_density": "(area DOUBLE) RETURNS DOUBLE RETURN CASE WHEN area < 3000 THEN 0.70D WHEN area < 10000 THEN 0.65D ELSE 0.60D END",
    "rect_gap_m": (
        "(ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE) RETURNS DOUBLE RETURN "
        "hypot(greatest(0D, ax - bx - bw, bx - ax - aw), greatest(0D, ay - by - bh, by - ay - ah))"
    ),
    "lot_class": (
        "(area DOUBLE, is_valid BOOLEAN, min_area DOUBLE) RETURNS STRING RETURN "
        "CASE WHEN area < min_area THEN 'unusable' WHEN is_valid THEN 'commercial' ELSE 'green_space' END"
    ),
}


def register(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def run_actions(
    requests: DataFrame, actions: dict[str, Callable[[DataFrame], DataFrame]], action: str = "action"
) -> DataFrame:
    """Send every row to the function its action names; an unknown action gives an error row.

    All functions must return the same columns; ``error`` is added.
    """
    out = None
    for name, fn in actions.items():
        part = fn(requests.filter(F.col(action) == name)).withColumn("error", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    unknown = requests.filter(F.col(action).isNull() | ~F.col(action).isin(*actions))
    failed = unknown.withColumn("error", F.concat(F.lit("unknown action "), F.coalesce(action, F.lit("null"))))
    return out.unionByName(failed, allowMissingColumns=True)
