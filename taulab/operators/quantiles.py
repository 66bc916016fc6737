"""Exact interpolated percentiles per group, also for groups that fit in no task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taulab.sources.store import Store

#: Groups above this many rows are searched by rounds of histograms; no more rows of a bracket are ever gathered.
LARGE = 20_000_000
#: Ranges that a bracket is cut into in one round.
BINS = 1024


def percentile(df: DataFrame, keys: list[str], value: str, q: float, name: str, large: bool = False) -> DataFrame:
    """(keys, name): linear interpolation between order statistics; nulls don't count.  See ``percentiles``."""
    return percentiles(df, keys, value, {name: q}, LARGE + 1 if large else 0)


def percentiles(df: DataFrame, keys: list[str], value: str, names: dict[str, float], largest: int = 0) -> DataFrame:
    """(keys, names): a column for each percentile; groups without values have no row.

    largest: rows of the largest group, known from where the rows come from.  Up to ``LARGE`` the plain aggregate serves;
    beyond it ``order_statistics`` finds the ranks.  Both give the same values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    if largest <= LARGE:
        return rows.groupBy(*keys).agg(*(F.percentile("_v", F.lit(q)).alias(name) for name, q in names.items()))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return interpolated(order_statistics(rows, keys, "_v", wanted_ranks(sizes, "_n", {name: F.lit(q) * (F.col("_n") - 1) for name, q in names.items()})), keys, list(names))


def wanted_ranks(sizes: DataFrame, n: str, places: dict[str, Column]) -> DataFrame:
    """sizes, for each name and for the ranks on both sides of its place: columns name, rank (from 0) and share of that rank in the result."""
    each = []
    for name, place in places.items():
        low = F.floor(place).cast("long")
        each += [F.struct(F.lit(name).alias("name"), low.alias("rank"), (1 - (place - low)).alias("share")), F.struct(F.lit(name).alias("name"), F.least(low + 1, F.col(n) - 1).alias("rank"), (place - low).alias("share"))]
    return sizes.withColumn("_w", F.explode(F.array(*each))).select(*sizes.columns, "_w.*")


def interpolated(found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """found (keys, name, rank, share, value) -> (keys, names): low + share of high * (high - low)."""
    low, high = (lambda name, end: F.min_by("value", F.when(F.col("name") == name, F.struct(F.col("rank") * end, F.col("share") * end))) for end in (1, -1))
    share = lambda name: F.min_by("share", F.when(F.col("name") == name, F.struct(-F.col("rank"), F.col("share"))))
    top = lambda name: F.max(F.when(F.col("name") == name, F.col("rank"))) > F.min(F.when(F.col("name") == name, F.col("rank")))
    columns = [F.when(top(name), low(name, 1) + share(name) * (high(name, -1) - low(name, 1))).otherwise(low(name, 1)).alias(name) for name in names]
    return found.groupBy(*keys).agg(*columns)


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, gather: int | None = None, bins: int = BINS) -> DataFrame:
    """wanted (keys, rank, ...) plus value, the rank-th smallest value of the keys' rows, from 0.

    A bracket holds a wanted rank: its lowest and highest value, the rows below it and the rows in it.  Every round
    counts the rows of the open brackets in ranges of equal width, with the least and greatest value of each, and goes on with the range that holds the rank,
    until a bracket is one value or has at most ``gather`` rows, which are sorted.  Only counts are shuffled before that.
    """
    gather = LARGE if gather is None else gather
    store = Store(rows.sparkSession, "ranks")
    whole = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("inside"))
    brackets = store.save(wanted.join(whole, keys).withColumn("below", F.lit(0).cast("long")), "brackets")
    bracket = [*keys, "lo", "hi"]
    is_open = (F.col("inside") > gather) & (F.col("lo") < F.col("hi"))
    closed: list[DataFrame] = []
    while True:
        closed.append(brackets.where(~is_open))
        brackets = brackets.where(is_open)
        if brackets.isEmpty():
            break
        # quotients before the difference, which may be too large for a double
        width = F.col("hi") / bins - F.col("lo") / bins
        at = F.when(width > 0, (F.col(value) / bins - F.col("lo") / bins) / width).otherwise((F.col(value) > F.col("lo")).cast("double"))
        spans = brackets.select(*bracket).distinct()
        held = rows.join(spans, keys).where(F.col(value).between(F.col("lo"), F.col("hi"))).withColumn("bin", F.least(F.lit(bins - 1), F.floor(at * bins)).cast("int"))
        counts = held.groupBy(*bracket, "bin").agg(F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*bracket).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = brackets.join(counts.withColumn("before", before), bracket).withColumn("_at", F.col("rank") - F.col("below") - F.col("before")).where("_at >= 0 AND _at < rows")
        rest = [c for c in brackets.columns if c not in ("lo", "hi", "below", "inside")]
        brackets = store.save(met.select(*rest, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("rows").alias("inside"), (F.col("below") + F.col("before")).alias("below")), "brackets")
    done = reduce(DataFrame.unionByName, closed)
    one = done.where("lo = hi").withColumn("value", F.col("lo"))
    few = done.where("lo < hi")
    lists = rows.join(few.select(*bracket).distinct(), keys).where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(*bracket).agg(F.sort_array(F.collect_list(value)).alias("_values"))
    some = few.join(lists, bracket).withColumn("value", F.element_at("_values", (F.col("rank") - F.col("below") + 1).cast("int"))).drop("_values")
    return one.unionByName(some).drop("lo", "hi", "below", "inside")
