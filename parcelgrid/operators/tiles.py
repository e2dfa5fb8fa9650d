"""Tile compatibility and audits of tiled sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIDES = ("n", "e", "s", "w")


def rotate_tile(tiles: DataFrame, quarter: Column) -> DataFrame:
    """Turn clockwise: the west edge becomes the north edge."""
    edges = F.array(*[F.col(f"edge_{s}") for s in SIDES])
    turned = [F.element_at(edges, (F.pmod(F.lit(k) - quarter, F.lit(4)) + 1).cast("int")) for k in range(4)]
    return tiles.select(
        *[c for c in tiles.columns if not c.startswith("edge_")], *[t.alias(f"edge_{s}") for t, s in zip(turned, SIDES)]
    )


def unpivot_edges(tiles: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{s}', edge_{s}" for s in SIDES)
    return tiles.select("tile_id", F.expr(f"stack(4, {pairs}) AS (side, edge)"))


def tile_compatibility(tiles: DataFrame) -> DataFrame:
    """(tile, side, other) where the facing edges are equal."""
    e = unpivot_edges(tiles)
    facing = F.create_map(*[F.lit(v) for v in ("n", "s", "s", "n", "e", "w", "w", "e")])
    other = e.select(F.col("tile_id").alias("other"), facing[F.col("side")].alias("side"), "edge")
    return e.join(other, ["side", "edge"]).select("tile_id", "side", "other")


def adjacency_audit(grid: DataFrame, tiles: DataFrame) -> DataFrame:
    """Neighbouring cells whose facing edges differ."""
    g = grid.select("site_id", "row", "col", "tile_id")
    b = g.withColumnRenamed("tile_id", "other")
    east = g.select("site_id", "row", (F.col("col") + 1).alias("col"), "tile_id", F.lit("e").alias("side"))
    north = g.select("site_id", (F.col("row") + 1).alias("row"), "col", "tile_id", F.lit("n").alias("side"))
    pairs = east.unionByName(north).join(b, ["site_id", "row", "col"])
    return pairs.join(tile_compatibility(tiles), ["tile_id", "side", "other"], "left_anti")


def kind_areas(grid: DataFrame, kinds: DataFrame, cell_m: float) -> DataFrame:
    """Area of each kind of tile on a site: ``site_id, kind, n_cells, area_sqm``; kinds that a site lacks have zero.

    ``grid(site_id, row, col, tile_id)``, ``kinds(tile_id, kind)``.  A tile without a kind counts as ``unknown``.
    """
    counted = grid.groupBy("site_id", "tile_id").agg(F.count("*").alias("_n"))
    kind = F.coalesce("kind", F.lit("unknown")).alias("kind")
    have = counted.join(kinds, "tile_id", "left").groupBy("site_id", kind).agg(F.sum("_n").alias("n_cells"))
    names = F.array_sort(F.collect_set("kind")).alias("_kinds")
    every = grid.select("site_id").distinct().crossJoin(kinds.select(names)).select("site_id", F.explode("_kinds").alias("kind"))
    full = every.join(have, ["site_id", "kind"], "full").select("site_id", "kind", F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"))
    return full.withColumn("area_sqm", F.col("n_cells") * float(cell_m * cell_m))
