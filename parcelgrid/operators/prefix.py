"""Row numbers and running sums inside groups of any size.

A window partitioned by the group alone puts a whole group into one task.  Here the rows are cut into ranges of
``(group, order, tie)`` at sampled quantiles, so a dominant group, a dominant order value or a far outlier changes
nothing about the size of a range: only rows that are equal in all of these columns stay together.  Sorted ranges are
written once; a row's place in its range comes with the write, and the totals of the ranges, one row for each group and
range that meet, give the offsets.  The rows are shuffled once; they meet their offsets in a join whose small side is
broadcast when its measured size allows that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from parcelgrid.session import cut_lineage

#: ``monotonically_increasing_id`` keeps the partition above this bit and the row below it.
PLACE_BITS = 33


def ordered_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows sorted within ranges of ``columns``, nulls first, with ``_at``: range and place as one number."""
    return (
        df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    )


def _running(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Adds ``_i_<c>``: the sum of the earlier rows of the same group in the same range; rows come sorted."""
    names = [f"_i_{c}" for c in sums]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0.0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            opens = np.zeros(n, bool)
            for k in keys:
                col = batch.column(k)
                code = np.asarray(col.dictionary_encode(null_encoding="encode").indices)
                opens[1:] |= code[1:] != code[:-1]
            head = tuple(batch.column(k)[0].as_py() for k in keys)
            opens[0] = last is None or head != last
            last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            columns = []
            for c, name in enumerate(sums):
                value = batch.column(name).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                before = np.concatenate(([0.0], np.cumsum(value)))
                base = np.where(opens[first], before[first], -carry[c])
                columns.append(pa.array(before[:-1] - base))
                carry[c] = float(before[n] - base[n - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def ranked(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], tie: str | Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """Adds ``rn`` (1-based), ``n`` (group size), and per summed column ``<c>_before`` and ``<c>_total``.

    Rows are ordered by ``(order, tie)``, columns of any sortable type, nulls first; rows equal in all of them are
    numbered in any order.  Null keys form a group of their own.  Empty ``keys`` rank the whole table.  A null counts
    as 0 in a sum.
    """
    by = list(keys)
    columns = list(dict.fromkeys([*by, *([order] if isinstance(order, str) else order), *([tie] if isinstance(tie, str) else tie)]))
    # cutting at quantiles reads the rows twice: once for the sample
    placed = ordered_ranges(cut_lineage(df), columns)
    if sums:
        placed = _running(placed, by, sums)
    placed = cut_lineage(placed).withColumn("_range", F.shiftright("_at", PLACE_BITS))

    totals = placed.groupBy(*by, "_range").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        F.col("_range").alias("_k_range"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), zero).alias(f"_b_{c}") for c in sums],
        *[F.coalesce(F.sum(f"_s_{c}").over(whole), zero).alias(f"{c}_total") for c in sums],
    )
    on = F.col("_range") == F.col("_k_range")
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(offsets, on).select(
        *df.columns,
        (F.col("_at") + F.col("_shift")).alias("rn"),
        "n",
        *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"{c}_before") for c in sums],
        *[F.col(f"{c}_total") for c in sums],
    )
