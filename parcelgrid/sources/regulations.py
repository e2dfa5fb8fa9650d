"""Regulation table: one row of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: default thresholds of the planning rules
DEFAULTS: dict[str, float] = {
    "setback_m": 50.0,
    "fire_m": 30.0,
    "waterway_m": 100.0,
    "far_min": 0.3,
    "far_max": 0.7,
    "green_min": 0.15,
    "plot_min_sqm": 1000.0,
    "plot_min_width_m": 20.0,
    "road_max_m": 200.0,
}


def load_regulations(spark: SparkSession, path: str | None = None, **overrides: float) -> DataFrame:
    """One row of thresholds; a JSON document at ``path`` and keywords override the defaults."""
    row = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in {**DEFAULTS, **overrides}.items()])
    if path is None:
        return row
    schema = ", ".join(f"{k} double" for k in DEFAULTS)
    given = spark.read.schema(schema).json(path, multiLine=True)
    renamed = given.select(*[F.col(k).alias(f"g_{k}") for k in DEFAULTS])
    if len(renamed.take(2)) > 1:
        raise ValueError(f"{path} holds more than one rule document")
    both = row.join(F.broadcast(renamed), F.lit(True), "left")
    return both.select(*[F.coalesce(f"g_{k}", k).alias(k) for k in DEFAULTS])


def thresholds(**overrides: float) -> dict[str, float]:
    return {**DEFAULTS, **overrides}
