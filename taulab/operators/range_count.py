"""How many values of a group lie above each of many thresholds.

A theta join compares every threshold with every value.  Here values are cut into ranges of equal
width per group; a threshold meets only the values of its own range, and the ranges above it contribute their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def count_above(values: DataFrame, taus: DataFrame, keys: list[str], value: str, tau: str, name: str, ranges: int = RANGES) -> DataFrame:
    """taus plus ``name``: the values of the same keys with value > tau (strictly; null taus give null).

    taus needs a column ``tau_id`` that tells its rows apart.  Groups without values give 0.
    """
    bounds = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / ranges

    def bucket(x: str) -> F.Column:
        at = F.when(width > 0, F.floor((F.col(x) - F.col("_lo")) / width)).otherwise(F.when(F.col(x) < F.col("_lo"), -1).otherwise(0))
        return F.least(F.lit(ranges), F.greatest(F.lit(-1), at)).cast("int")

    cut = values.join(bounds, keys).select(*keys, F.col(value).alias("_v"), bucket(value).alias("_b"))
    counts = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.withColumn("_from", F.sum("_n").over(above)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_from"))).alias("_ladder"))
    placed = taus.join(bounds, keys, "left").withColumn("_b", bucket(tau)).join(ladder, keys, "left")
    higher = F.filter("_ladder", lambda x: x["_b"] > F.col("_b"))
    placed = placed.withColumn("_higher", F.when(F.col("_ladder").isNull() | (F.size(higher) == 0), F.lit(0)).otherwise(F.element_at(higher, 1)["_from"]))
    own = (
        placed.select(*keys, "tau_id", tau, "_b")
        .join(cut, [*keys, "_b"])
        .groupBy("tau_id")
        .agg(F.count_if(F.col("_v") > F.col(tau)).alias("_own"))
    )
    out = placed.join(own, "tau_id", "left")
    return out.select(*taus.columns, F.when(F.col(tau).isNotNull(), F.col("_higher") + F.coalesce("_own", F.lit(0))).cast("long").alias(name))
