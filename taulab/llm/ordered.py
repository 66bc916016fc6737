"""Places of rows in a total order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, fresh

#: ``monotonically_increasing_id`` holds a partition's number above this bit and the row's place in it below.
PARTITION_BIT = 33


def numbered(df: DataFrame, order: list[Column], work: Workspace, place: str = "place") -> DataFrame:
    """df, a stored table, with each row's place (from 0) in the given order, which should have no long ties.

    Rows are dealt to ranges of the order and sorted inside; places are those inside the range plus the sizes of the ranges before it.
    """
    spot = fresh(df, "spot")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(spot, F.monotonically_increasing_id())
    return placed(work.save(ranged, "ordered"), spot, place)


def placed(stored: DataFrame, spot: str, place: str) -> DataFrame:
    """The stored table with places instead of ``spot``, an id of ordered partitions and ordered rows in them."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = F.shiftright(F.col(spot), PARTITION_BIT)
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # one row for each partition of the table, so of a bounded size
    offsets = sizes.select(F.col("part").alias(f"{spot}_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(f"{spot}_before"))
    joined = stored.join(F.broadcast(offsets), part == F.col(f"{spot}_part"))
    inside = F.col(spot).bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    return joined.withColumn(place, F.col(f"{spot}_before") + inside).drop(spot, f"{spot}_part", f"{spot}_before")
