"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (CRC-32 of the text, a hash of the id), so equal texts are neighbours
and a large group of copies still has distinct keys.  Keys are sampled with chances in proportion
to size; their quantiles are the splitters of many ranges, which are counted exactly, and a
range with more rows than planned is subdivided by splitters from its own keys, by row only if it has one key.  Running sums inside a range and the totals of the
ranges before it give each record its exact place in the whole order, and the shard is
the place in bytes times the number of shards over the total.

The law is ``bytes``: shards differ from each other by at most about the size of one
record at either end, or of a group of equal texts that is kept whole: those of at most
``whole_group_percent`` of a shard's size are; of the larger ones only those at a boundary are cut.

Defined cases: a null text has size 1 and a null CRC; a null id is a record like others;
repeated rows are separate records; an empty table gives an empty result; columns of the input other
than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    range_rows: int = 20_000
    most_ranges: int = 4096
    samples_per_range: int = 16
    whole_group_percent: float = 1.0


def _splitters(keyed: DataFrame, total: int, ranges: int, samples: int) -> list[int]:
    """Quantile boundaries of keys drawn with chances in proportion to size.

    A record larger than a sampling step is drawn surely, so at most about twice
    ``samples`` keys come to the driver, whatever the size of the table.
    """
    step = total / samples
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(step))
    drawn = keyed.where(F.pmod(F.xxhash64("key", "row", F.lit("draw")), F.lit(1 << 30)) < chance * F.lit(float(1 << 30)))
    rows = sorted((r[0], max(float(r[1]), step)) for r in drawn.select("key", "size").collect())
    whole, passed, out = sum(w for _, w in rows), 0.0, []
    for key, weight in rows:
        if passed >= whole * (len(out) + 1) / ranges and (not out or key > out[-1]):
            out.append(key)
        passed += weight
    return out


def _range_of(splitters: list[int]) -> F.Column:
    """How many splitters are not above the key: a binary search."""
    if not splitters:
        return F.lit(0)
    bits = len(splitters).bit_length()
    padded = splitters + [(1 << 63) - 1] * ((1 << bits) - 1 - len(splitters))
    array = F.array(*map(F.lit, padded)) if len(padded) < 2 else F.expr(f"array({', '.join(f'{x}L' for x in padded)})")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(array, at + s) <= F.col("key"), at + s).otherwise(at))


def _subdivided(keyed: DataFrame, splitters: list[int], planned: int, samples: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Splitters that leave at most ``planned`` rows in a range of more than one key, and (range, parts) of single keys with more.

    An overfull range gets splitters from its own keys, drawn evenly; a key that spans several of their quantiles
    gets a range of its own.  Every round adds a splitter inside each such range.
    """
    while True:
        ranged = keyed.withColumn("range", _range_of(splitters))
        full = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("rows") > planned).collect()
        wide = [r for r in full if r["low"] < r["high"]]
        if not wide:
            return splitters, [(r["range"], -(-r["rows"] // planned)) for r in full]
        parts = {r["range"]: 2 * -(-r["rows"] // planned) for r in wide}
        chances = F.create_map(*(F.lit(x) for r in wide for x in (r["range"], min(1.0, parts[r["range"]] * samples / r["rows"]))))
        # another draw for each round
        draw = F.pmod(F.xxhash64("key", "row", F.lit(len(splitters))), F.lit(1 << 30))
        drawn: dict[int, list[int]] = {r["range"]: [] for r in wide}
        for at, key in ranged.where(draw < F.element_at(chances, F.col("range")) * F.lit(float(1 << 30))).select("range", "key").collect():
            drawn[at].append(key)
        more = set(splitters)
        for r in wide:
            keys, k = sorted(drawn[r["range"]]) or [(r["low"] + r["high"] + 1) // 2], parts[r["range"]]
            cuts = [keys[len(keys) * i // k] for i in range(1, k)]
            more |= {x + d for x in cuts for d in range(1 + (cuts.count(x) > 1)) if r["low"] < x + d <= r["high"]}
        splitters = sorted(more)


def assign_shards(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per record."""
    work, p = Workspace(docs.sparkSession, "sharding"), params
    text = F.col("text").cast("string")
    crc = F.crc32(F.encode(text, "UTF-8"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    key = F.shiftleft(F.coalesce("text_crc32", F.lit(0).cast("long")), 30) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keyed = work.save(own.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "keys")
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(p.shards, min(p.most_ranges, -(-n // p.range_rows)))
    splitters = _splitters(keyed, total, ranges, ranges * p.samples_per_range) if n else []

    planned = max(p.range_rows, 2 * n // ranges)
    splitters, repeated = _subdivided(keyed, splitters, planned, p.samples_per_range)
    ranged = keyed.withColumn("range", _range_of(splitters))
    if repeated:
        parts = docs.sparkSession.createDataFrame(repeated, "range int, parts int")
        ranged = ranged.join(F.broadcast(parts), "range", "left").withColumn("part", F.coalesce(F.expr("cast(pmod(xxhash64(row), parts) AS int)"), F.lit(0))).drop("parts")
    else:
        ranged = ranged.withColumn("part", F.lit(0))
    parted = work.save(ranged, "ranged")
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("range", "part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "row")
    place = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size") / 2
    ordered = parted.join(offsets, ["range", "part"]).select("doc_id", "size", "text_crc32", place.alias("middle"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"))
    ordered = work.save(ordered, "ordered")
    # a group of equal texts that is small beside a shard goes where its first record goes; shards stay
    # runs of the order, as its records are next to each other
    few = p.whole_group_percent * total / (100 * p.shards)
    groups = ordered.groupBy("text_crc32", "size").agg(F.min("middle").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("copies"), (F.max("place") - F.min("place") + 1).alias("span"))
    groups = groups.where((F.col("copies") > 1) & (F.col("span") == F.col("copies")) & (F.col("bytes") <= few)).select(F.col("text_crc32").alias("crc"), F.col("size").alias("each"), "first")
    held = ordered.join(groups, F.col("text_crc32").eqNullSafe(F.col("crc")) & (F.col("size") == F.col("each")), "left")
    shard = F.least(F.lit(p.shards - 1), F.floor(F.coalesce("first", "middle") * p.shards / F.lit(max(total, 1)))).cast("int")
    placed = work.save(held.select("doc_id", "size", "text_crc32", shard.alias("shard"), "place"), "placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
