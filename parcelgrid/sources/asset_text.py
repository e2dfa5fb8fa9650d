"""Assets out of free text that carries a JSON object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_SCHEMA = "action string, explanation string, new_assets array<struct<type:string,polygon:array<array<double>>>>"


def parse_assets_from_text(rows: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Fenced block first, else first ``{`` to last ``}``; missing ``]`` are added before the closing brace.

    Unknown asset types are dropped, broken JSON gives one row with ``error``.
    """
    fenced = F.regexp_extract(F.col(text), r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    loose = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    raw = F.when(F.length(fenced) > 0, fenced).otherwise(loose)
    missing = F.regexp_count(F.col("_raw"), F.lit(r"\[")) - F.regexp_count(F.col("_raw"), F.lit(r"\]"))
    fixed = F.when(
        missing > 0, F.concat(F.regexp_replace("_raw", r"\}\s*$", ""), F.repeat(F.lit("]"), missing), F.lit("}"))
    ).otherwise(F.col("_raw"))
    r = rows.withColumn("_raw", raw).withColumn("_j", F.from_json(fixed, _SCHEMA))
    # a broken object parses to nulls throughout; a valid one may simply have no assets
    bad = F.coalesce(F.col("_j.new_assets").isNull() & F.col("_j.action").isNull() & F.col("_j.explanation").isNull(), F.lit(True))
    keep = F.filter("_j.new_assets", lambda a: a.type.isin(*keywords))
    ids = [c for c in rows.columns if c != text]
    good = r.filter(~bad).select(
        *ids, F.lower(F.coalesce("_j.action", F.lit("add"))).alias("action"), F.posexplode(keep).alias("asset_no", "_a")
    ).select(*ids, "action", "asset_no", "_a.type", F.col("_a.polygon").alias("polygon"), F.lit(None).cast("string").alias("error"))
    errors = r.filter(bad).select(
        *ids, F.lit("add").alias("action"), F.lit(None).cast("int").alias("asset_no"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("array<array<double>>").alias("polygon"), F.lit("bad json").alias("error"),
    )
    return good.unionByName(errors)
