"""Positions within a group that scale past one task per group.

A plain ``row_number`` over a group sorts the whole group in one task.  Here rows are cut
into buckets by the order column, buckets are counted, and a row's position is the number of rows in the
buckets before its own plus its row number inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000


def with_positions(df: DataFrame, keys: list[str], order: str, buckets: int = 1, position: str = "row_idx", total: str | None = None) -> DataFrame:
    """Adds the 0-based position by ``order`` within ``keys`` (and the group's size as ``total``).

    ``order`` must be a number without ties in a group.  buckets: about rows of the largest group / BUCKET_ROWS.
    """
    if buckets <= 1:
        w = Window.partitionBy(*keys)
        out = df.withColumn(position, F.row_number().over(w.orderBy(order)) - 1)
        return out.withColumn(total, F.count("*").over(w)) if total else out
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = max((high - low + 1) / buckets, 1) if low is not None else 1
    cut = df.withColumn("_bucket", F.floor((F.col(order) - low) / width) if low is not None else F.lit(0))
    counts = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_bucket", before.alias("_before"), F.sum("_n").over(w).alias("_total"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    out = cut.join(offsets, [*keys, "_bucket"]).withColumn(position, F.col("_before") + F.row_number().over(inner) - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, position, *([total] if total else []))


def dense_ids(df: DataFrame, column: str, name: str, partitions: int, store) -> DataFrame:
    """df plus the 0-based rank of ``column`` among its distinct values, without sorting all of them in one task.

    Distinct values are range-partitioned and stored with the number of their part, so that both passes see the same parts.
    """
    parts = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(max(1, partitions), column)
    stored = store.save(parts.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inner = Window.partitionBy("_part").orderBy(column)
    ranked = stored.join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.row_number().over(inner) - 1).cast("long").alias(name))
    return df.join(ranked, column, "left")
