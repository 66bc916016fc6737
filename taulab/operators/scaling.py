"""Scaling and reconstruction errors of feature arrays, without one column per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_stats(rows: DataFrame, key: str, features: str) -> DataFrame:
    """(key, mean, std): arrays of the mean and population deviation (0 becomes 1) of each feature."""
    long = rows.select(key, F.posexplode(F.col(features).cast("array<double>")).alias("i", "v"))
    each = long.groupBy(key, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    packed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("a"))
    return packed.select(key, F.col("a.m").alias("mean"), F.col("a.s").alias("std"))


def scale_splits(rows: DataFrame, key: str, features: str, train: Column) -> DataFrame:
    """rows plus ``scaled``: every row by the statistics of its key's training rows."""
    return scale_by(rows, key, features, feature_stats(rows.where(train), key, features))


def scale_by(rows: DataFrame, key: str, features: str, stats: DataFrame) -> DataFrame:
    """rows plus ``scaled``, by the statistics (key, mean, std) of their key; rows of a key without any go."""
    joined = rows.join(stats, key)
    centered = F.zip_with(F.col(features).cast("array<double>"), "mean", lambda x, m: x - m)
    return joined.withColumn("scaled", F.zip_with(centered, "std", lambda x, s: x / s)).drop("mean", "std")


def row_errors(rows: DataFrame, key: str, features: str) -> DataFrame:
    """rows plus ``error``: mean squared difference from the key's mean row, the simplest reconstruction."""
    joined = rows.join(feature_stats(rows, key, features), key)
    squares = F.zip_with(F.col(features).cast("array<double>"), "mean", lambda x, m: (x - m) * (x - m))
    return joined.withColumn("error", F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.size(features)).drop("mean", "std")
