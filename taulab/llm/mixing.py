"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A source's target over its size is the number of copies expected of each of its documents.
The integral part is certain; the fractional parts are rounded together.  Two undecided documents exchange expected words
until one of them is decided, at random so that each keeps its expectation, and the other goes on.

In chunks of bounded size documents meet in order of size, the largest first, and only within a factor of two; what
such a class leaves undecided is decided against all smaller documents of the chunk, whose common chance takes up what is left
over, if it can without any of them being decided by that.  What it can't take up, and the last one of a chunk, meet
those of other chunks in the next levels of a reduction tree, until one is left for each source.  The words taken from a source so
differ from its target by no more than that last document's.

Chances come from hashes of the document, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 are taken as often as the integral part says
(no words either way); null is a source of its own, last in order; repeated rows are
separate documents; a source without words has target 0; an empty table gives an empty
result; other columns are ignored or, in ``mixed_documents``, kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, fresh


@dataclass(frozen=True)
class MixParams:
    """weights: of the sources in code point order, repeating; most: copies of a document."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    chunk: int = 256
    seed: int = 17


def source_targets(sized: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, n, target): weights share all words; what is above ``most`` times a source's size is shared again."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*map(F.lit, map(float, p.weights)))
    cap = F.col("source_size") * float(p.most)
    # sources by how soon they fill up: those before one are full if it is
    by_fill = Window.orderBy("fill", "order")
    return (
        sources.withColumn("order", order)
        .withColumn("weight", F.element_at(weights, F.pmod("order", F.lit(len(p.weights))) + 1))
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("level") >= F.col("fill"))
        .withColumn("common", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(F.lit(0))))
        .select("source", "source_size", "n", F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("common") * F.col("weight"))).alias("target"))
    )


_UNIT = "struct<row: bigint, w: double, p: double, u: double, v: double>"
_DONE = "array<struct<row: bigint, extra: int>>"


def _unit(x: str, p: str) -> str:
    return f"named_struct('row', {x}.row, 'w', {x}.w, 'p', {p}, 'u', {x}.u, 'v', {x}.v)"


def _state(q: str = "acc.q", rest: str = "acc.rest", c: str = "acc.c", left: str = "acc.left", row: str = "", extra: int = 0) -> str:
    done = f"array_append(acc.done, named_struct('row', {row}, 'extra', {extra}))" if row else "acc.done"
    return f"named_struct('q', {q}, 'rest', {rest}, 'c', {c}, 'left', {left}, 'done', {done})"


def _class_ends() -> str:
    """The carried document c is a class larger than the next one x: it is decided against all documents from x on, together of
    acc.rest words and of the common chance acc.q, or put aside if they can't take that up."""
    c, none = "acc.c", f"cast(null AS {_UNIT})"
    taken = _state(q=f"acc.q - (1 - {c}.p) * {c}.w / acc.rest", c=none, row=f"{c}.row", extra=1)
    refused = _state(q=f"acc.q + {c}.p * {c}.w / acc.rest", c=none, row=f"{c}.row", extra=0)
    aside = _state(c=none, left=f"array_append(acc.left, {c})")
    return f"""CASE WHEN {c} IS NULL OR floor(log2({c}.w)) = floor(log2(e.x.w)) THEN acc
      WHEN (1 - {c}.p) * {c}.w >= acc.q * acc.rest OR {c}.p * {c}.w >= (1 - acc.q) * acc.rest THEN {aside}
      WHEN {c}.v < {c}.p THEN {taken} ELSE {refused} END"""


def _meeting(p: str) -> str:
    """The carried document c and the next one x, of chance p, move expected words between them until one is decided."""
    c, x, rest = "acc.c", "e.x", "acc.rest - e.x.w"
    up, down = f"least(1 - {c}.p, {p} * {x}.w / {c}.w)", f"least({c}.p, (1 - {p}) * {x}.w / {c}.w)"
    raised = f"{x}.u * ({up} + {down}) < {down}"
    c_taken = _state(rest=rest, c=_unit(x, f"greatest(0D, {p} - (1 - {c}.p) * {c}.w / {x}.w)"), row=f"{c}.row", extra=1)
    x_refused = _state(rest=rest, c=_unit(c, f"least(1D, {c}.p + {p} * {x}.w / {c}.w)"), row=f"{x}.row", extra=0)
    c_refused = _state(rest=rest, c=_unit(x, f"least(1D, {p} + {c}.p * {c}.w / {x}.w)"), row=f"{c}.row", extra=0)
    x_taken = _state(rest=rest, c=_unit(c, f"greatest(0D, {c}.p - (1 - {p}) * {x}.w / {c}.w)"), row=f"{x}.row", extra=1)
    return f"""CASE WHEN {c} IS NULL THEN {_state(rest=rest, c=_unit(x, p))}
      WHEN {raised} AND 1 - {c}.p <= {p} * {x}.w / {c}.w THEN {c_taken}
      WHEN {raised} THEN {x_refused}
      WHEN {c}.p <= (1 - {p}) * {x}.w / {c}.w THEN {c_refused} ELSE {x_taken} END"""


def _met(level: int) -> str:
    """What becomes of a chunk's units, the largest first: (q, rest, c, left, done)."""
    start = f"named_struct('q', units[0].p, 'rest', aggregate(units, 0D, (a, x) -> a + x.w), 'c', cast(null AS {_UNIT}), 'left', cast(array() AS array<{_UNIT}>), 'done', cast(array() AS {_DONE}))"
    if level:
        return f"aggregate(transform(units, x -> named_struct('x', x)), {start}, (acc, e) -> {_meeting('e.x.p')})"
    events = "flatten(transform(units, x -> array(named_struct('next', false, 'x', x), named_struct('next', true, 'x', x))))"
    return f"aggregate({events}, {start}, (acc, e) -> CASE WHEN e.next THEN {_meeting('acc.q')} ELSE {_class_ends()} END)"


def _draw(level: int, seed: int, salt: str) -> F.Column:
    return F.pmod(F.xxhash64("h", F.lit(seed), F.lit(level), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def _packed(units: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, chunk, units): of each chunk, the largest first, so that what is left over is small."""
    unit = F.struct(F.col("w").alias("w"), F.col("h"), "row", "p", _draw(level, seed, "u").alias("u"), _draw(level, seed, "v").alias("v"))
    met = units.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    return met.withColumn("units", F.expr(f"transform(units, x -> {_unit('x', 'x.p')})"))


def _rounded(units: DataFrame, most_chunks: int, p: MixParams, work: Workspace) -> DataFrame:
    """units (source, chunk, row, w, p, h) -> (row, extra): p rounded to 0 or 1."""
    decided, level = None, 0
    while True:
        met = _packed(units, level, p.seed).withColumn("met", F.expr(_met(level)))
        undecided = F.expr("if(met.c IS NULL, met.left, array_append(met.left, met.c))")
        met = work.save(met.select("source", "chunk", undecided.alias("left"), "met.done"), "met")
        done = met.select(F.explode("done").alias("d")).select("d.row", "d.extra")
        decided = done if decided is None else decided.unionByName(done)
        left = met.select("source", "chunk", F.explode("left").alias("c"))
        if level and most_chunks <= 1:
            return decided.unionByName(left.select("c.row", F.when(F.col("c.v") < F.col("c.p"), 1).otherwise(0).alias("extra")))
        units = left.select("source", F.floor(F.col("chunk") / p.chunk).alias("chunk"), "c.row", "c.w", "c.p", F.xxhash64("source", "chunk", "c.w", "c.v").alias("h"))
        most_chunks, level = -(-most_chunks // p.chunk), level + 1


def _plan(rows: DataFrame, p: MixParams, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, source, size, h) -> with source_size, target and base; and the decisions (row, extra)."""
    targets = work.save(source_targets(rows, p), "targets")
    planned = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(p.most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    planned = planned.withColumn("base", F.floor(expected + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), expected - F.col("base")))
    chunks = F.ceil(F.col("n") / p.chunk)
    units = planned.where("size > 0 AND p > 0").select("source", F.pmod(F.xxhash64("h", F.lit("chunk")), chunks).alias("chunk"), "row", F.col("size").cast("double").alias("w"), "p", "h")
    # rows that are equal in all that is hashed can overfill a chunk: such chunks are subdivided by row
    units = work.save(units, "units")
    heavy = units.groupBy("source", "chunk").agg(F.ceil(F.count("*") / (4 * p.chunk)).alias("parts"))
    heavy = heavy.where("parts > 1").select(F.col("source").alias("of"), F.col("chunk").alias("at"), "parts")
    split = units.join(heavy, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")), "left")
    most = targets.agg(F.max("n")).first()[0] or 0
    most_chunks = math.ceil(most / p.chunk)
    spread = F.when(F.col("parts").isNull(), F.col("chunk")).otherwise(F.col("chunk") + most_chunks * (1 + F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))))
    most_parts = heavy.agg(F.max("parts")).first()[0] or 0
    split = split.withColumn("chunk", spread.cast("long")).select(units.columns)
    return planned, _rounded(split, most_chunks * (1 + most_parts), p, work)


def _key() -> dict[str, F.Column]:
    """Rows with equal ids, sources and texts have equal keys and are interchangeable."""
    text = F.col("text").cast("string")
    id_, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return {"doc_id": id_, "source": source, "h": F.xxhash64(id_, source, F.crc32(F.encode(text, "UTF-8")), F.octet_length(text))}


def _rows(docs: DataFrame, work: Workspace) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    named = [c.alias(k) for k, c in _key().items()]
    return work.save(docs.select(*named, size.alias("size")).withColumn("row", F.monotonically_increasing_id()), "rows")


# The decisions grow with the table and look small to the planner, as they are exploded from packed rows: their joins say merge.


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per document."""
    work = Workspace(docs.sparkSession, "mixing")
    planned, decided = _plan(_rows(docs, work), params, work)
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return planned.join(decided.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The documents of the mix, with all their columns; one taken n times appears n times.

    Rows with equal ids, sources and texts are one document here, which appears as often as they all would.
    """
    work = Workspace(docs.sparkSession, "mixing")
    planned, decided = _plan(_rows(docs, work), params, work)
    copies = planned.join(decided.hint("merge"), "row", "left").groupBy("h", "doc_id", "source").agg(F.sum(F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"), F.count("*").alias("rows"))
    n = {k: fresh(docs, f"mix_{k}") for k in ("h", "doc_id", "source", "of_h", "of_id", "of_source", "copies", "rows", "again")}
    copies = work.save(copies.toDF(n["of_h"], n["of_id"], n["of_source"], n["copies"], n["rows"]), "copies")
    same = (F.col(n["h"]) == F.col(n["of_h"])) & F.col(n["doc_id"]).eqNullSafe(F.col(n["of_id"])) & F.col(n["source"]).eqNullSafe(F.col(n["of_source"]))
    keyed = docs.withColumns({n[k]: c for k, c in _key().items()})
    taken = keyed.join(copies.where(F.col(n["copies"]) > 0), same)
    if not copies.where(F.col(n["rows"]) > 1).isEmpty():
        again = taken.where(F.col(n["rows"]) > 1).dropDuplicates([n["h"], n["doc_id"], n["source"]])
        taken = taken.where(F.col(n["rows"]) == 1).unionByName(again)
    return taken.withColumn(n["again"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(n["copies"])))).select(*docs.columns)
