"""Replacement of part of a victim's calibration scores by draws from a reservoir.

``replacements`` draws by integer arithmetic on positions, so that any SQL engine gives the same rows, and makes the replaced rows only;
``injected_rng`` draws with numpy's generators from the recorded seeds, in grouped Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taulab.constants import DISJOINT, FEATURE_TAIL_MASS, FRACTIONS, INTERPOLATED, OBJECTIVES, PAIRS, SOURCES, TAIL_MASS, TRAIN_FEATURE_SOURCES, WITH_REPLACEMENT, WITHOUT_REPLACEMENT
from taulab.sources.store import Store

from .ladder import merged, ranked

CELL = ["seed", "victim", "source", "objective", "fraction"]
PRIME = 1_000_003


def pair_table(spark: SparkSession) -> DataFrame:
    """(source, objective, stream): stream numbers the generator of a pair."""
    rows = [(s, o, SOURCES.index(s) * len(OBJECTIVES) * 1000 + OBJECTIVES.index(o) * 1000) for s, o in PAIRS]
    return spark.createDataFrame(rows, "source string, objective string, stream long")


def grid(eligible: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """eligible (seed, client_id) x pairs x fractions -> the cells, with the stream number of each."""
    spark = eligible.sparkSession
    f = spark.createDataFrame([(x,) for x in fractions], "fraction double")
    cells = eligible.select("seed", F.col("client_id").alias("victim")).crossJoin(F.broadcast(pair_table(spark))).crossJoin(F.broadcast(f))
    return cells.withColumn("child", F.col("stream") + F.bround(F.col("fraction") * 1000).cast("long"))


def budget(fraction: str | Column, n: str | Column) -> Column:
    """Rows to replace: half-even rounding, one at least; none for fraction 0."""
    f, n = (F.col(x) if isinstance(x, str) else x for x in (fraction, n))
    return F.when(f > 0, F.greatest(F.lit(1), F.bround(f * n).cast("long"))).otherwise(0)


def tail_size(n: str | Column, mass: float) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.floor(F.lit(mass) * n))


def _order(of: str, child: str) -> Column:
    return F.pmod((F.col(of) + 1) * 7919 + (F.col(child) + 1) * 104729 + (F.col("seed") + 1) * 15485863, F.lit(PRIME))


def reservoirs(ladder: DataFrame) -> DataFrame:
    """A client ladder -> the pool of each benign source with pool_index from 0 and pool_n: a range of its ranks."""
    tail, top = tail_size("n", TAIL_MASS), F.col("n")
    pools = (("random_benign", F.lit(0), top), ("high_score_benign", top - tail, tail), ("low_score_benign", F.lit(0), tail))
    each = F.array(*(F.struct(F.lit(name).alias("source"), (F.col("rank") - first).cast("long").alias("pool_index"), size.cast("long").alias("pool_n")) for name, first, size in pools))
    inside = ladder.withColumn("_p", F.explode(each)).where("_p.pool_index >= 0 AND _p.pool_index < _p.pool_n")
    return inside.select("_p.source", "seed", "client_id", "pos", "score", "_p.pool_index", "_p.pool_n")


def donor_problems(pool: DataFrame, cal: DataFrame, budgets: DataFrame, stages: tuple[str, ...] = ("train",)) -> DataFrame:
    """(seed, victim, rule, n): what keeps a victim from drawing donors without replacement from other clients; no row is a sound setting.

    pool (seed, client_id, stage, row_id, score), cal (seed, client_id, score), budgets (seed, victim, most).  n counts rows of other clients from a
    stage that is no reservoir (``stage``) or without a finite score (``not finite``), and the victim's own calibration rows without one
    (``calibration``, also with n = 0 if it has none); ``too few`` has the number of different row ids of others whose highest part is smaller than the budget.
    Others' figures are those of all clients less the victim's own, so no row meets a victim.
    """
    bad = ~F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    keys = ["seed", "client_id"]
    figures = {"stage": F.count_if(~F.coalesce(F.col("stage").isin(*stages), F.lit(False))), "not finite": F.count_if(bad)}
    own = pool.groupBy(*keys).agg(*(c.alias(name) for name, c in figures.items()))
    ids = pool.groupBy("seed", "row_id").agg(F.min("client_id").alias("client_id"), F.max("client_id").alias("last"))
    alone = ids.where("client_id = last").groupBy(*keys).agg(F.count("*").alias("ids"))
    own = own.join(alone, keys, "left").na.fill(0, ["ids"])
    total = own.groupBy("seed").agg(*(F.sum(c).alias(f"all {c}") for c in figures)).join(ids.groupBy("seed").agg(F.count("*").alias("all ids")), "seed")
    calibration = cal.groupBy(*keys).agg(F.count("*").alias("n_cal"), F.count_if(bad).alias("bad_cal"))
    rows = budgets.withColumnRenamed("victim", "client_id").join(total, "seed", "left").join(own, keys, "left").join(calibration, keys, "left").na.fill(0)
    less = lambda c: F.col(f"all {c}") - F.col(c)
    row = lambda when, rule, n: F.when(when, F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n")))
    found = [row(less(c) > 0, c, less(c)) for c in figures]
    found.append(row((F.col("n_cal") == 0) | (F.col("bad_cal") > 0), "calibration", F.col("bad_cal")))
    rest = less("ids")
    found.append(row((rest == 0) | (tail_size(rest, FEATURE_TAIL_MASS) < F.col("most")), "too few", rest))
    return rows.select("seed", F.col("client_id").alias("victim"), F.explode(F.array_compact(F.array(*found))).alias("p")).select("seed", "victim", "p.*")


def _shift(child: str) -> Column:
    return F.pmod((F.col(child) + 1) * 104729 + (F.col("seed") + 1) * 15485863, F.lit(PRIME))


def _order_value(pos: str) -> Column:
    """The part of a row's draw order that all cells of a client share."""
    return F.pmod((F.col(pos) + 1) * 7919, F.lit(PRIME))


def donor_rows(train: DataFrame, store: Store, largest: int | None = None) -> DataFrame:
    """One row for each row id of a seed, in two global orders; stored.

    (seed, row_id, owner, score, place, rank, score2, place2, at2, turn): owner and score are those of the first client that has the id, score2 that of the first
    other one, if there is one: it stands in for the owner's own when the owner is the victim.  place counts both scores of all ids, highest
    first; rank counts first scores only, and at2 those before score2.  turn is the place in the draw order that all sources share.
    """
    own = train.groupBy("seed", "row_id", "client_id").agg(F.min(F.struct("pos", "score")).alias("x")).select("seed", "row_id", F.struct("client_id", "x.pos", "x.score").alias("x"))
    own = store.save(own, "owned")
    first = own.groupBy("seed", "row_id").agg(F.min("x").alias("x"), F.count("*").alias("owners"))
    other = own.join(first.where("owners > 1").select("seed", "row_id", F.col("x.client_id").alias("owner")), ["seed", "row_id"]).where("x.client_id <> owner")
    second = other.groupBy("seed", "row_id", "owner").agg(F.min("x").alias("x")).select("seed", "row_id", "owner", "x.score", F.lit(1).alias("stand_in"))
    both = first.select("seed", "row_id", F.col("x.client_id").alias("owner"), "x.score", F.lit(0).alias("stand_in")).unionByName(second)
    down = [F.col("score").isNull(), ~F.isnan("score"), -F.col("score")]  # like descending: NaN first, nulls last
    placed = ranked(both, ["seed"], [*down, "row_id", "stand_in"], store, "place", largest, rank=F.col("stand_in") == 0)
    pick = lambda c, k: F.max(F.when(F.col("stand_in") == k, F.col(c)))
    each = placed.groupBy("seed", "row_id", "owner").agg(*(pick(c, 0).alias(c) for c in ("score", "place", "rank")), *(pick(c, 1).alias(name) for c, name in (("score", "score2"), ("place", "place2"), ("rank", "at2"))))
    return store.save(ranked(each, ["seed"], [_order_value("row_id"), "row_id"], store, "turn", largest), "donors")


def donor_pools(rows: DataFrame, victims: DataFrame, store: Store) -> DataFrame:
    """victims (seed, victim, ...) and sources, from ``donor_rows``: n ids of the seed, last of their places, to, the place the pool ends with, and turn0, the turn its draws begin with; stored.

    The last place of a victim's high tail is found from its own rows (see ``merged``).
    """
    seed, cell = ["seed"], ["seed", "victim"]
    own = rows.select("seed", F.col("owner").alias("victim"), "rank", "place", "score2", "place2", "at2", "turn")
    sizes = rows.groupBy("seed").agg(F.count("*").alias("n"), F.max(F.greatest("place", F.coalesce("place2", "place"))).alias("last"))
    less = own.groupBy(*cell).agg((F.count("*") - F.count("place2")).alias("less"))
    pools = victims.join(sizes, "seed").join(less, cell, "left").withColumn("pool", F.col("n") - F.coalesce("less", F.lit(0))).where("pool > 0")
    wanted = pools.select(*cell, "n", (tail_size("pool", FEATURE_TAIL_MASS) - 1).cast("long").alias("rank"))
    gone = own.join(sizes.select("seed", "n"), "seed").join(victims.select(*cell), cell, "left_semi")
    moved = gone.select(*cell, "n", F.col("rank").alias("at"), F.lit(None).cast("double").alias("added"))
    moved = moved.unionByName(gone.where("place2 IS NOT NULL").select(*cell, "n", F.col("at2").alias("at"), F.col("place2").cast("double").alias("added")))
    tails = merged(rows.select("seed", "rank", F.col("place").cast("double").alias("score")), moved, wanted, seed, cell).select(*cell, F.col("value").cast("long").alias("tail_place"))
    pairs = pair_table(rows.sparkSession).where(F.col("source").isin(*TRAIN_FEATURE_SOURCES)).select("source", "stream")
    asked = pools.join(tails, cell).crossJoin(F.broadcast(pairs))
    asked = asked.withColumn("to", F.when(F.col("source") == TRAIN_FEATURE_SOURCES[0], F.col("last")).otherwise(F.col("tail_place")))
    begins = sizes.select("seed").crossJoin(F.broadcast(pairs)).select("seed", "stream", (F.lit(PRIME) - _shift("stream")).alias("begin"))
    turns = rows.select("seed", _order_value("row_id").alias("turn_value")).join(begins, "seed").groupBy("seed", "stream").agg(F.count_if(F.col("turn_value") < F.col("begin")).alias("turn0"))
    asked = asked.join(turns, ["seed", "stream"])
    return store.save(asked.withColumn("turn0", F.pmod(F.col("turn0"), F.col("n"))).drop("less"), "asked")


#: Rows of the draw order in a block of ``donors``.
DRAW_BLOCK = 1024


def donors(train: DataFrame, victims: DataFrame, store: Store | None = None, digits: int | None = None) -> DataFrame:
    """Feature-row donors of each victim from all other clients, in draw order.

    train (seed, client_id, row_id, pos, score); a row id counts once among all of a victim's candidates.
    (seed, victim, source, draw, row_id, score, donor_n); digits: scores are rounded to so many, after they are ordered.

    All victims share one draw order for each source, cut into blocks that are sorted once.  A victim takes of each block what is in its pool; its draws
    go on from the number of rows that it takes of earlier blocks.  So what is made for a victim is neither sorted nor shuffled.
    """
    store = Store(train.sparkSession, "donors") if store is None else store
    block, cell = ["seed", "source", "block"], ["seed", "victim", "source"]
    rows = donor_rows(train, store)
    asked = donor_pools(rows, victims.select("seed", F.col("client_id").alias("victim")).distinct(), store)
    orders = asked.groupBy("seed", "source").agg(F.max("n").alias("n"), F.max("turn0").alias("turn0"), F.max("to").alias("furthest"))
    dealt = rows.join(orders, "seed").where(F.least("place", "place2") <= F.col("furthest")).withColumn("t", F.pmod(F.col("turn") - F.col("turn0"), F.col("n")))
    value = lambda c: F.col(c) if digits is None else F.round(c, digits).alias(c)
    items = F.sort_array(F.collect_list(F.struct("t", "row_id", "owner", value("score"), "place", value("score2"), "place2")))
    blocks = store.save(dealt.withColumn("block", F.floor(F.col("t") / DRAW_BLOCK)).groupBy(*block).agg(items.alias("items")), "blocks")
    taken = F.filter("items", lambda x: F.coalesce(F.when(x["owner"] == F.col("victim"), x["place2"]).otherwise(x["place"]) <= F.col("to"), F.lit(False)))
    counts = store.save(blocks.join(asked.select(*cell, "to"), ["seed", "source"]).select(*block, "victim", "to", F.size(taken).cast("long").alias("c")), "counts")
    w = Window.partitionBy(*cell)
    begin = F.coalesce(F.sum("c").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumns({"begin": begin, "donor_n": F.sum("c").over(w)}).where("c > 0")
    each = blocks.join(offsets, block).select(*cell, "begin", "donor_n", F.posexplode(taken).alias("k", "x"))
    score = F.when(F.col("x.owner") == F.col("victim"), F.col("x.score2")).otherwise(F.col("x.score"))
    return each.select(*cell, (F.col("begin") + F.col("k") + 1).alias("draw"), "x.row_id", score.alias("score"), "donor_n")


def first_donors(train: DataFrame, budgets: DataFrame, store: Store, largest: int | None = None) -> DataFrame:
    """(seed, victim, source, draw, row_id, score): the first donors of each victim, as many as budgets (seed, victim, most) say.

    Equal to the rows of ``donors`` with draw <= most, but no victim is joined with all rows: its pool is the global order without its
    own rows (see ``donor_pools``), and how many turns of the
    draw order hold enough of its pool follows from counts by ranges of turns and places; only the rows of these turns are looked at.
    """
    cell = ["seed", "victim"]
    rows = donor_rows(train, store, largest)
    sizes = rows.groupBy("seed").agg(F.count("*").alias("n"), F.max(F.greatest("place", F.coalesce("place2", "place"))).alias("last"))
    asked = donor_pools(rows, budgets, store)
    # ranges of turns about as long as the smallest budget; as many ranges of places
    n, most = asked.agg(F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.min("most"), F.lit(1))).first()
    ranges = max(16, min(TURN_RANGES, n // max(1, most)))
    cut = lambda x, of: F.floor(x * F.lit(ranges) / of).cast("int")
    near = rows.join(sizes, "seed").withColumns({"tb": cut(F.col("turn"), F.col("n")), "pb": cut(F.col("place"), F.col("last") + 1)})
    up_to = Window.partitionBy("seed", "tb").orderBy("pb")
    filled = near.groupBy("seed", "tb", "pb").agg(F.count("*").alias("c")).withColumn("c", F.sum("c").over(up_to)).groupBy("seed", "tb").agg(F.sort_array(F.collect_list(F.struct("pb", "c"))).alias("filled"))
    mine = near.withColumnRenamed("owner", "victim").join(asked.select(*cell, "source", "to"), cell).where(F.col("place") <= F.col("to")).groupBy(*cell, "source", "tb").agg(F.count("*").alias("own"))
    cap = cut(F.col("to") + 1, F.col("last") + 1)
    least = asked.join(filled, "seed").join(mine, [*cell, "source", "tb"], "left")
    whole = F.coalesce(F.try_element_at(F.filter("filled", lambda x: x["pb"] < F.col("cap")), F.lit(-1))["c"], F.lit(0))
    first = cut(F.col("turn0"), F.col("n"))
    least = least.withColumn("cap", cap).withColumn("sure", F.greatest(F.lit(0), whole - F.coalesce("own", F.lit(0))))
    least = least.withColumn("turn_no", F.pmod(F.col("tb") - first, F.lit(ranges)))
    # the first range counts for nothing, as its beginning comes last
    so_far = F.sum(F.when(F.col("turn_no") > 0, F.col("sure")).otherwise(0)).over(Window.partitionBy(*cell, "source").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1))
    taken = least.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where("so_far < most OR turn_no = 0")
    # where all ranges are taken, the first one's beginning is too
    full = F.max("turn_no").over(Window.partitionBy(*cell, "source")) == ranges - 1
    taken = taken.withColumn("full", full).select(*cell, "source", "most", "to", "turn0", "tb", "full")
    met = near.select("seed", "tb", "turn", "row_id", "owner", "score", "place", "score2", "place2", "n").join(taken, ["seed", "tb"])
    stands = F.col("owner") == F.col("victim")
    met = met.withColumns({"used": F.when(stands, F.col("score2")).otherwise(F.col("score")), "at_place": F.when(stands, F.col("place2")).otherwise(F.col("place"))})
    met = met.where((F.col("at_place") <= F.col("to")) & (F.col("full") | (F.col("tb") != first) | (F.col("turn") >= F.col("turn0"))))
    draw = F.row_number().over(Window.partitionBy(*cell, "source").orderBy(F.pmod(F.col("turn") - F.col("turn0"), F.col("n"))))
    return met.withColumn("draw", draw.cast("long")).where("draw <= most").select(*cell, "source", "draw", "row_id", F.col("used").alias("score"))


#: At most so many ranges of turns in ``first_donors``.
TURN_RANGES = 4096


def client_ladder(cal: DataFrame, sizes: DataFrame, store: Store, largest: int | None = None) -> DataFrame:
    """cal (seed, client_id, stage, pos, event_id, score) plus n (from sizes), rank by score and turn, the place in the shared draw order; stored.

    The rows a cell replaces are consecutive turns from a start of its own, so no cell sorts the client's rows again.
    """
    keys = ["seed", "client_id"]
    by_score = ranked(cal.join(sizes.select(*keys, "n"), keys), keys, ["score", "pos"], store, "rank", largest)
    return store.save(ranked(by_score, keys, [_order_value("pos"), "pos"], store, "turn", largest), "ladder")


def places_in(values: DataFrame, asked: DataFrame, keys: list[str], value: str, store: Store, name: str, largest: int | None = None, after: bool = True) -> DataFrame:
    """asked (keys, value, ...) plus how many rows of values (keys, value) come before, equal ones included if after: from one order of both."""
    both = values.select(*keys, value, F.lit(not after).cast("int").alias("_asked")).unionByName(asked.withColumn("_asked", F.lit(after).cast("int")), allowMissingColumns=True)
    kind = int(after)
    placed = ranked(both, keys, [value, "_asked"], store, "_place", largest, **{name: F.col("_asked") != kind})
    return placed.where(F.col("_asked") == kind).drop("_asked", "_place")


#: Ranges of turns that a cell meets rows by in ``taken_turns``.
SPANS = 64


def taken_turns(cells: DataFrame, m: str, steps: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell with the rows of its victim at the turns turn0, turn0 + 1, ... (modulo n), m of them: k, from 1, and these columns of steps.

    A cell meets the ranges of turns that it reaches into, and in a range its own turns are kept.  The planner sees sizes before rows are
    multiplied, so the join is hinted: no range is sent through the driver.
    """
    keys = ["seed", "victim"]
    span = lambda turn: F.floor(turn * F.lit(SPANS) / F.col("n")).cast("long")
    first, last = span(F.col("turn0")), span(F.col("turn0") + F.col(m) - 1)
    reached = cells.withColumn("_span", F.explode(F.sequence(first, F.least(last, first + SPANS - 1)))).withColumn("_span", F.pmod("_span", F.lit(SPANS)))
    rows = steps.withColumn("_span", span(F.col("turn"))).select(*keys, "_span", "turn", *columns)
    met = reached.hint("merge").join(rows, [*keys, "_span"]).withColumn("k", F.pmod(F.col("turn") - F.col("turn0"), F.col("n")) + 1)
    return met.where(F.col("k") <= F.col(m)).drop("_span")


def starts(cells: DataFrame, ladder: DataFrame, store: Store, largest: int | None = None) -> DataFrame:
    """cells plus turn0: the turn of the first row that a cell replaces.

    A cell's order is the shared one shifted by a number of its own and taken modulo PRIME: it begins with the values that the shift carries
    past PRIME, so after as many turns as there are lower values.
    """
    values = ladder.select("seed", F.col("client_id").alias("victim"), _order_value("pos").alias("turn_value"))
    placed = places_in(values, cells.withColumn("turn_value", F.lit(PRIME) - _shift("child")), ["seed", "victim"], "turn_value", store, "turn0", largest, after=False)
    return placed.withColumn("turn0", F.pmod(F.col("turn0"), F.col("n"))).drop("turn_value")


def replacements(cells: DataFrame, ladder: DataFrame, train: DataFrame, store: Store, largest: int | None = None, largest_seed: int | None = None) -> DataFrame:
    """The replaced calibration rows of all cells with fraction > 0, and no others; stored.

    CELL, n, stage, pos, rank and clean_score of the row, score that takes its place, at (the clean rank before which that stands), donor_id.
    Benign sources draw with replacement, train-feature sources without; these have the row id of the donor.
    largest, largest_seed: rows of the largest ladder and of all donors of a seed, where known (see ``ranked``).
    """
    keys = ["seed", "victim"]
    steps = ladder.withColumnRenamed("client_id", "victim")
    sizes = steps.select(*keys, "n").distinct()
    asked = cells.where("fraction > 0").join(sizes, keys).withColumn("m", budget("fraction", "n"))
    hits = taken_turns(starts(asked, ladder, store, largest), "m", steps.withColumn("clean_score", F.col("score")), ["stage", "pos", "rank", "clean_score"])
    kept = [*CELL, "n", "stage", "pos", "rank", "clean_score"]
    tail = tail_size("n", TAIL_MASS)
    pool = F.when(F.col("source") == "random_benign", F.col("n")).otherwise(tail)
    place = F.pmod(F.col("k") * 48271 + F.col("child") * 13 + F.col("seed") * 7, pool)
    drawn = F.when(F.col("source") == "high_score_benign", F.col("n") - tail + place).otherwise(place)
    own = hits.where(~F.col("source").isin(*TRAIN_FEATURE_SOURCES)).withColumn("drawn", drawn)
    benign = own.join(steps.select(*keys, F.col("rank").alias("drawn"), "score"), [*keys, "drawn"]).select(*kept, "score", (F.col("drawn") + 1).alias("at"), F.lit(None).cast("long").alias("donor_id"))
    most = asked.where(F.col("source").isin(*TRAIN_FEATURE_SOURCES)).groupBy(*keys).agg(F.max("m").alias("most"))
    gifts = store.save(first_donors(train, store.save(most, "budgets"), store, largest_seed).withColumnRenamed("draw", "k"), "gifts")
    # a donor's place among the victim's rows: how many of them come before it in one order of both
    placed = places_in(steps.select(*keys, "score"), gifts, keys, "score", store, "at", largest)
    feature = hits.where(F.col("source").isin(*TRAIN_FEATURE_SOURCES)).join(placed.select(*keys, "source", "k", "score", "at", F.col("row_id").alias("donor_id")), [*keys, "source", "k"])
    return store.save(benign.unionByName(feature.select(*kept, "score", "at", "donor_id")), "replaced")


def changes(replaced: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """cell, n, at, added: what the replacements take out of a victim's ladder and put into it (see ``merged``)."""
    out = replaced.select(*cell, "n", F.col("rank").alias("at"), F.lit(None).cast("double").alias("added"))
    return out.unionByName(replaced.select(*cell, "n", "at", F.col("score").alias("added")))


def injected(cells: DataFrame, cal: DataFrame, replaced: DataFrame) -> DataFrame:
    """All calibration rows of the victims of all cells with fraction > 0: CELL, pos, score, clean_score, replaced, donor_id.

    As many rows as cells times rows: for looking at them; nothing else is computed from it.
    """
    rows = cells.where("fraction > 0").join(cal.select("seed", F.col("client_id").alias("victim"), "pos", F.col("score").alias("clean_score")), ["seed", "victim"])
    new = replaced.select(*CELL, "pos", F.col("score").alias("drawn"), "donor_id")
    out = rows.select(*CELL, "pos", "clean_score").join(new, [*CELL, "pos"], "left")
    return out.select(*CELL, "pos", F.coalesce("drawn", "clean_score").alias("score"), "clean_score", F.col("drawn").isNotNull().alias("replaced"), "donor_id")


def disjoint_budget(n: Column, requested: Column, source: Column) -> Column:
    """The largest m <= requested for which the pool of the other n - m rows has m rows; 0 if none.

    The pool shrinks and m grows, so it is half of all rows, or about what solves m = mass * (n - m): one of a few numbers.
    """
    tail = lambda m: F.greatest(F.lit(1), F.floor(F.lit(TAIL_MASS) * (n - m)))
    near = F.floor(F.lit(TAIL_MASS) * n / (1 + TAIL_MASS))
    tries = F.array(F.lit(1).cast("long"), *(F.least(requested, near + d).cast("long") for d in range(-2, 3)))
    fits = F.filter(tries, lambda m: (m >= 1) & (m <= requested) & (tail(m) >= m))
    return F.when(source == "random_benign", F.least(requested, F.floor(n / 2)).cast("long")).otherwise(F.coalesce(F.array_max(fits), F.lit(0).cast("long")))


#: Steps from place to place of draws without replacement: a prime, unless the pool is a multiple of it.
STRIDE = 48_271


def _place(k: Column, pool: Column) -> Column:
    """A place from 0 to pool - 1, another one for each k from 1 to pool."""
    stride = F.when(pool % STRIDE == 0, 1).otherwise(STRIDE)
    return F.pmod(F.col("child") * 13 + F.col("seed") * 7 + (k - 1) * stride, pool)


def variant_replacements(cells: DataFrame, ladder: DataFrame, store: Store, largest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The benign-source cells drawn in three other ways: (CELL, draw, requested, effective, pool_n), and the replaced rows like ``replacements`` with draw.

    Without replacement a pool is used up; a disjoint reservoir is made of the rows that are not replaced; an interpolated tail has values between
    two neighbours of the pool.  Of every cell the rows are those that drawing with replacement takes, as many as the draw allows.
    """
    keys, cell = ["seed", "victim"], [*CELL, "draw"]
    steps = ladder.withColumnRenamed("client_id", "victim")
    n, m, rest = F.col("n"), F.col("requested"), F.col("n") - F.col("effective")
    size = lambda of: F.when(F.col("source") == "random_benign", of).otherwise(tail_size(of, TAIL_MASS)).cast("long")
    asked = cells.where((F.col("fraction") > 0) & ~F.col("source").isin(*TRAIN_FEATURE_SOURCES)).join(steps.select(*keys, "n").distinct(), keys)
    asked = asked.withColumn("requested", budget("fraction", "n")).withColumn("whole", size(n)).withColumn("draw", F.explode(F.array(*map(F.lit, (WITHOUT_REPLACEMENT, DISJOINT, INTERPOLATED)))))
    allowed = F.when(F.col("draw") == WITHOUT_REPLACEMENT, F.least(m, F.col("whole"))).when(F.col("draw") == DISJOINT, disjoint_budget(n, m, F.col("source"))).otherwise(F.when(F.col("whole") >= 2, m).otherwise(0))
    asked = asked.withColumn("effective", allowed.cast("long")).withColumn("pool_n", F.when(F.col("draw") == DISJOINT, size(rest)).otherwise(F.col("whole")))
    asked = store.save(starts(asked, ladder, store, largest), "variants")
    hits = store.save(taken_turns(asked.where("effective > 0"), "effective", steps.withColumn("clean_score", F.col("score")), ["stage", "pos", "rank", "clean_score"]), "hits")
    of = F.when(F.col("draw") == DISJOINT, rest).otherwise(n)
    first = F.when(F.col("source") == "high_score_benign", of - F.col("pool_n")).otherwise(0)
    between = F.col("draw") == INTERPOLATED
    hits = hits.withColumn("drawn", (first + _place(F.col("k"), F.col("pool_n") - between.cast("int"))).cast("long"))
    kept = [*cell, "n", "stage", "pos", "rank", "clean_score"]
    # among the rows left, the j-th is as many ranks further as replaced rows have fewer than j + 1 rows left below them
    lost = ranked(hits.where(F.col("draw") == DISJOINT), cell, ["rank"], store, "i", largest)
    left = places_in(lost.select(*cell, (F.col("rank") - F.col("i")).alias("drawn")), hits.where(F.col("draw") == DISJOINT), cell, "drawn", store, "skipped", largest)
    hits = hits.where(F.col("draw") != DISJOINT).unionByName(left.withColumn("drawn", F.col("drawn") + F.col("skipped")).drop("skipped"))
    values = steps.select(*keys, F.col("rank").alias("drawn"), "score")
    toward = F.pmod(F.col("k") * 7919 + F.col("child"), F.lit(1000)) / 1000.0
    above = steps.select(*keys, (F.col("rank") - 1).alias("drawn"), F.col("score").alias("next"))
    low = hits.join(values, [*keys, "drawn"])
    plain = low.where(~between)
    mixed = low.where(between).join(above, [*keys, "drawn"]).withColumn("score", F.col("score") + toward * (F.col("next") - F.col("score"))).drop("next")
    out = plain.unionByName(mixed).select(*kept, "score", (F.col("drawn") + 1).alias("at"), F.lit(None).cast("long").alias("donor_id"))
    return asked.select(*cell, "requested", "effective", "pool_n"), store.save(out, "replaced")


#: Of each draw mode: places drawn for m values out of n, and how far each value lies towards the next place.
PLACES = {
    WITH_REPLACEMENT: lambda n, m, rng: (rng.choice(n, size=m), 0.0),
    WITHOUT_REPLACEMENT: lambda n, m, rng: (rng.choice(n, size=m, replace=False), 0.0),
    INTERPOLATED: lambda n, m, rng: (rng.integers(n - 1, size=m), rng.random(m)),
}


def drawn(pool: np.ndarray, m: int, rng: np.random.Generator, draw: str) -> np.ndarray:
    """m values at drawn places of a pool (of the sorted pool between places), numpy's generators taking n - 1 < 1 or m > n as errors."""
    place, toward = PLACES[draw](len(pool), m, rng)
    ladder = np.sort(pool) if draw == INTERPOLATED else pool
    step = np.append(np.diff(ladder), 0.0)
    return ladder[place] + toward * step[place]


def pool_of(cal: np.ndarray, source: str) -> np.ndarray:
    if source == "random_benign":
        return cal.copy()
    k = max(1, int(np.floor(TAIL_MASS * len(cal))))
    s = np.sort(cal)
    return s[-k:] if source == "high_score_benign" else s[:k]


def inject_array(cal: np.ndarray, source: str, fraction: float, draw: str, entropy: tuple[int, int, int, int], child: int) -> tuple[np.ndarray, int, bool]:
    """(scores, rows replaced, feasible) of one cell, from the generator of its seeds."""
    if fraction <= 0:
        return cal.copy(), 0, True
    rng = np.random.default_rng(np.random.SeedSequence(list(entropy), spawn_key=(child,)))
    n, m = len(cal), max(1, round(fraction * len(cal)))
    out = cal.copy()
    if draw == "disjoint_reservoir":
        fits = [k for k in range(m, 0, -1) if (n - k if source == "random_benign" else max(1, int(np.floor(TAIL_MASS * (n - k))))) >= k]
        if not fits:
            return out, 0, False
        at = rng.choice(n, size=fits[0], replace=False)
        pool = pool_of(np.delete(cal, at), source)
        if source != "random_benign" and len(np.unique(pool)) < 2:
            return out, 0, False
        out[at] = rng.choice(pool, size=fits[0], replace=False)
        return out, fits[0], True
    pool = pool_of(cal, source)
    if source != "random_benign" and len(np.unique(pool)) < 2:
        return out, 0, False
    if draw == "without_replacement":
        m = min(m, len(pool))
    at = rng.choice(n, size=m, replace=False)
    out[at] = drawn(pool, m, rng, draw)
    return out, m, True


def injected_rng(cells: DataFrame, cal: DataFrame, draws: tuple[str, ...] = ("with_replacement",)) -> DataFrame:
    """CELL, draw, n_replaced, feasible, tau, duplicate_rate of benign-source cells, drawn with numpy's generators.

    One Arrow row per cell, whose calibration scores are one array; client_idx is the victim's place among sorted ids.
    """
    arrays = cal.groupBy("seed", "client_id").agg(F.sort_array(F.collect_list(F.struct("pos", "score")))["score"].alias("cal"))
    arrays = arrays.withColumn("client_idx", F.row_number().over(Window.partitionBy("seed").orderBy("client_id")) - 1).withColumnRenamed("client_id", "victim")
    rows = cells.where(~F.col("source").isin(*TRAIN_FEATURE_SOURCES)).join(arrays, ["seed", "victim"]).withColumn("draw", F.explode(F.array(*map(F.lit, draws))))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                scores, m, ok = inject_array(np.asarray(r.cal, float), r.source, r.fraction, r.draw, (r.seed, 100 + r.seed, r.client_idx, 0), r.child)
                out.append((m, ok, float(np.percentile(scores, 95)), 1 - len(np.unique(scores)) / len(scores)))
            got = pd.DataFrame(out, columns=["n_replaced", "feasible", "tau", "duplicate_rate"])
            yield pd.concat([pdf[[*CELL, "draw"]].reset_index(drop=True), got], axis=1)

    schema = "seed long, victim string, source string, objective string, fraction double, draw string, n_replaced long, feasible boolean, tau double, duplicate_rate double"
    return rows.select(*CELL, "child", "draw", "client_idx", "cal").mapInPandas(run, schema)
