"""Streaming jobs: asset gate, design state, session activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelgrid.functions import geometry as g
from parcelgrid.operators import design_fold as df, edits as ed, pairs as pr
from parcelgrid.operators.bucket import with_box
from parcelgrid.session import cut_lineage
from parcelgrid.streaming.state_table import SEED, StateTable


def session_activity(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Messages per session and activity window; works on a stream and on a table alike.

    On a stream, rows older than the watermark are dropped.
    """
    m = messages.withWatermark("created_at", late) if messages.isStreaming else messages
    return m.groupBy("session_id", F.session_window("created_at", gap).alias("_w")).agg(
        F.count("*").alias("n_messages")
    ).select("session_id", F.col("_w.start").alias("started_at"), F.col("_w.end").alias("ended_at"), "n_messages")


def design_state(edits: DataFrame) -> DataFrame:
    """Current fold of the edit log per element.  The state is a handful of sums and flags per element, kept by
    Spark's own streaming aggregation, so a design of any size is spread over its elements."""
    return ed.fold_edits(edits)


DESIGNS = "design_id long, scale double, last_no long"
ELEMENTS = (
    "design_id long, target string, moved_x double, moved_y double, deleted boolean, to_green boolean, n_edits long, n_late long"
)
ASSETS = (
    "site_id long, asset_id long, type string, x double, y double, w double, h double, whole boolean, "
    "ring array<struct<x:double,y:double>>, kept_sqm double"
)


def _fold_tables(spark: SparkSession, folder: str, buckets: int) -> tuple[StateTable, StateTable]:
    return (
        StateTable(spark, f"{folder}/designs", "design_id", DESIGNS, buckets),
        StateTable(spark, f"{folder}/elements", "design_id", ELEMENTS, buckets),
    )


def start_design_fold(edits: DataFrame, folder: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Keep the fold of the edit log (``design_fold.fold_log``) of every design up to date in ``folder``.

    Batches follow the log: an edit whose number is not above the last one folded for its design was sent again or came
    too late; it changes nothing and is written to ``repeated`` in the folder.  A batch reads and rewrites only the
    buckets of its own designs.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        designs, elements = _fold_tables(spark, folder, buckets)
        rows = cut_lineage(batch.dropDuplicates(["design_id", "edit_no"]))
        touched = elements.touched(rows)
        before = designs.read(batch_id, touched), elements.read(batch_id, touched)
        seen = rows.join(before[0].select("design_id", "last_no"), "design_id", "left")
        known = F.coalesce(F.col("edit_no") <= F.col("last_no"), F.lit(False))
        seen.filter(known).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/repeated/batch={batch_id}")
        after = df.then(before, df.fold_log(seen.filter(~known).select(*batch.columns)))
        designs.write(batch_id, after[0], touched)
        elements.write(batch_id, after[1], touched)

    for table in _fold_tables(edits.sparkSession, folder, buckets):
        if table.last_batch() is None:
            table.write(SEED, table.empty())
    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_design_fold(spark: SparkSession, folder: str, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """``(designs, elements)`` as of the last batch."""
    designs, elements = _fold_tables(spark, folder, buckets)
    last = elements.last_batch()
    return designs.read(SEED if last is None else last + 1), elements.read(SEED if last is None else last + 1)


def stored_assets(spark: SparkSession, folder: str, buckets: int = 256) -> StateTable:
    return StateTable(spark, folder, "site_id", ASSETS, buckets)


def seed_assets(spark: SparkSession, assets: DataFrame, folder: str, buckets: int = 256) -> None:
    """Start the store of an asset gate from ``assets(site_id, asset_id, type, x, y, w, h)``, which are not checked."""
    x, y, w, h = (F.col(k) for k in "xywh")
    whole = assets.withColumn("whole", F.lit(True)).withColumn("ring", g.rect_ring(x, y, w, h)).withColumn("kept_sqm", w * h)
    stored_assets(spark, folder, buckets).write(SEED, whole)


def start_asset_gate(
    arriving: DataFrame, sites: DataFrame, store: str, quarantine: str, checkpoint: str, buckets: int = 256
) -> StreamingQuery:
    """Check every micro-batch of new assets against the stored ones; a site's new assets are stored or none of them.

    ``store`` was started by ``seed_assets`` and keeps what lies inside the site: an asset across the outline is stored
    as its clipped ring.  A batch reads and rewrites only the buckets of its sites; refused assets, also those of
    unknown sites, go to ``quarantine`` by batch.  A repeated batch replaces what it wrote before.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        table = stored_assets(batch.sparkSession, store, buckets)
        rows = cut_lineage(batch)
        touched = table.touched(rows)
        old = table.read(batch_id, touched)
        gated = pr.gate_assets(sites, rows.select("site_id", "asset_id", "type", *"xywh"))
        good = cut_lineage(pr.gate_result(gated, pr.gate_findings(gated, old)).filter("success").select("site_id"))
        new = gated.join(good, "site_id", "left_semi").select("site_id", "asset_id", "type", "whole", "ring", "kept_sqm")
        table.write(batch_id, old.unionByName(with_box(new)), touched)
        refused = rows.join(good, "site_id", "left_anti").select(*batch.columns)
        refused.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_assets(spark: SparkSession, store: str, buckets: int = 256) -> DataFrame:
    """All stored assets as of the last batch."""
    table = stored_assets(spark, store, buckets)
    last = table.last_batch()
    return table.read(SEED if last is None else last + 1)
