"""Ladders: rank -> value of groups, stored once, and order statistics of groups that differ from a stored one in some rows.

``ranked`` sorts by ranges over all groups at once, so a group of any size takes as many tasks as it needs.  A perturbed group is
a ladder without some of its ranks and with values put in between: ``merged`` finds ranks in it from the changes alone.  Changes
are counted in blocks of ranks; from the counts follows the block of a wanted rank, and only the changes of that block are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taulab.sources.store import Store

from . import quantiles

#: Changes of a group of n rows are counted in about sqrt(n) blocks of ranks, within these bounds.
BLOCKS = (8, 65_536)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], store: Store, name: str = "rank", largest: int | None = None, **counted: Column) -> DataFrame:
    """df plus each row's 0-based place by order within keys and, for each of counted, how many earlier rows it holds for.

    Rows are dealt to ranges of (keys, order); a place is the number of rows of the keys in earlier ranges plus that in the own range.
    Groups that are known to have at most ``quantiles.LARGE`` rows are sorted whole instead, with the same places.
    """
    counted = {name: F.lit(1), **counted}
    if largest is not None and largest <= quantiles.LARGE:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0)).cast("long") for k, c in counted.items()})
    ordered = df.withColumns({f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)} | {f"_c_{k}": c.cast("int") for k, c in counted.items()})
    names = [c for c in ordered.columns if c.startswith("_o")]
    ranges = store.save(ordered.repartitionByRange(*keys, *names).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*keys, "_part").agg(*(F.sum(f"_c_{k}").alias(f"_c_{k}") for k in counted))
    before = sums.select(*keys, "_part", *(F.coalesce(F.sum(f"_c_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in counted))
    inner = Window.partitionBy(*keys, "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    places = {k: (F.col(f"_before_{k}") + F.coalesce(F.sum(f"_c_{k}").over(inner), F.lit(0))).cast("long") for k in counted}
    kept = [c for c in df.columns if c not in counted]
    return ranges.join(before, [*keys, "_part"]).select(*kept, *(c.alias(k) for k, c in places.items()))


def at_ranks(ladder: DataFrame, wanted: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """wanted (keys, rank, ...) plus value, from a ladder (keys, rank, value)."""
    return wanted.join(ladder.select(*keys, "rank", F.col(value).alias("value")), [*keys, "rank"])


def merged(ladder: DataFrame, changes: DataFrame, wanted: DataFrame, keys: list[str], cell: list[str], value: str = "score", blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """wanted (cell, n, rank, ...) plus value: the rank-th smallest value, from 0, of each cell's perturbed group.

    ladder (keys, rank, value): the clean groups, of n rows each; cell includes keys.
    changes (cell, n, at, added): without a value, the clean rank ``at`` is taken out; with one, it is put in before the clean rank ``at``.
    Cells without changes have their clean values.
    """
    many = f"greatest({blocks[0]}L, least({blocks[1]}L, ceil(sqrt(n))))"
    wanted = wanted.withColumn("blocks", F.expr(many))
    start = lambda b: f"(({b}) * n + blocks - 1) div blocks"
    marked = changes.withColumn("block", F.expr(f"least({many} - 1, at * {many} div n)").cast("int")).withColumn("net", F.when(F.col("added").isNull(), -1).otherwise(1))
    # at most one entry for each block
    nets = marked.groupBy(*cell, "block").agg(F.sum("net").alias("net")).groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("block", "net"))).alias("nets"))
    find = f"""aggregate(coalesce(nets, array()), named_struct('moved', 0L, 'block', CAST(NULL AS int), 'own', CAST(NULL AS long)),
      (a, x) -> CASE WHEN a.own IS NOT NULL THEN a
        WHEN rank < {start('x.block')} + a.moved THEN named_struct('moved', a.moved, 'block', CAST(NULL AS int), 'own', rank - a.moved)
        WHEN rank < {start('x.block + 1')} + a.moved + x.net THEN named_struct('moved', a.moved, 'block', x.block, 'own', rank - a.moved)
        ELSE named_struct('moved', a.moved + x.net, 'block', CAST(NULL AS int), 'own', CAST(NULL AS long)) END,
      a -> named_struct('block', a.block, 'own', coalesce(a.own, rank - a.moved)))"""
    found = wanted.join(nets, cell, "left").withColumn("_f", F.expr(find)).withColumns({"block": F.col("_f.block"), "_own": F.col("_f.own")}).drop("_f", "nets", "blocks")
    # in a block, _own is the wanted place in it, counted as if it began with the clean rank at its start
    listed = marked.join(found.where("block IS NOT NULL").select(*cell, "block").distinct(), [*cell, "block"], "left_semi")
    listed = listed.groupBy(*cell, "block").agg(F.sort_array(F.collect_list(F.struct("at", F.col("added").isNull().alias("out"), "added"))).alias("events"))
    walk = """aggregate(coalesce(events, array()), named_struct('moved', 0L, 'own', CAST(NULL AS long), 'value', CAST(NULL AS double)),
      (a, x) -> CASE WHEN a.own IS NOT NULL OR a.value IS NOT NULL THEN a
        WHEN _own < x.at + a.moved THEN named_struct('moved', a.moved, 'own', _own - a.moved, 'value', a.value)
        WHEN x.out THEN named_struct('moved', a.moved - 1, 'own', a.own, 'value', a.value)
        WHEN _own = x.at + a.moved THEN named_struct('moved', a.moved, 'own', a.own, 'value', x.added)
        ELSE named_struct('moved', a.moved + 1, 'own', a.own, 'value', a.value) END,
      a -> named_struct('own', CASE WHEN a.value IS NULL THEN coalesce(a.own, _own - a.moved) END, 'value', a.value))"""
    walked = found.join(listed, [*cell, "block"], "left").withColumn("_w", F.expr(walk)).withColumns({"_clean": F.col("_w.own"), "_value": F.col("_w.value")}).drop("_w", "events", "block", "_own")
    steps = ladder.select(*keys, F.col("rank").alias("_clean"), F.col(value).cast("double").alias("_of"))
    return walked.join(steps, [*keys, "_clean"], "left").withColumn("value", F.coalesce("_value", "_of")).drop("_clean", "_value", "_of")
