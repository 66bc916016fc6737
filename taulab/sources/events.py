"""The event table as labelled anomaly scores of a small fleet.

client = ``c{user_id % 9}``; an event of type ``error`` is an attack; the order of a client's benign rows is
``event_id``.  Several training seeds are replicas whose scores differ by a factor from integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taulab.constants import SPLIT
from taulab.functions.columns import defined
from taulab.operators.positions import BUCKET_ROWS, with_positions

CLIENTS, SEEDS, ATTACK_SHIFT = 9, 5, 40.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, client_id, attack, raw): NaN becomes null and null scores are dropped."""
    attack = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .select("event_id", F.concat(F.lit("c"), F.col("user_id") % CLIENTS).alias("client_id"), attack.alias("attack"), (defined("value") + F.when(attack, ATTACK_SHIFT).otherwise(0.0)).alias("raw"))
        .where("raw IS NOT NULL AND client_id IS NOT NULL AND attack IS NOT NULL")
    )


def split_bounds(n: str) -> list[tuple[str, F.Column]]:
    """(stage, end position) of the ordered parts of n rows; the last stage takes the rest."""
    out, end = [], F.lit(0)
    for stage, share in SPLIT:
        end = end + F.floor(F.col(n) * F.lit(share))
        out.append((stage, end))
    return out


def largest_client(rows: DataFrame) -> int:
    """How many labelled rows the client with most of them has."""
    return rows.groupBy("client_id").count().agg(F.max("count")).first()[0] or 0


def staged(rows: DataFrame, largest: int | None = None) -> DataFrame:
    """labelled rows -> (client_id, stage, pos, event_id, raw); pos counts from 0 within a stage.

    largest: rows of the largest client, counted if not known.
    """
    benign = rows.where("NOT attack")
    buckets = 1
    largest = largest_client(benign) if largest is None else largest
    if largest > BUCKET_ROWS:
        buckets = -(-largest // BUCKET_ROWS)
    placed = with_positions(benign, ["client_id"], "event_id", buckets, "row_idx", "n")
    stage, pos, start = F.lit("test_benign"), F.col("row_idx"), F.lit(0)
    bounds = split_bounds("n")
    pos = F.col("row_idx") - bounds[-1][1]
    for k in reversed(range(len(bounds))):
        name, end = bounds[k]
        start = bounds[k - 1][1] if k else F.lit(0)
        inside = F.col("row_idx") < end
        stage, pos = F.when(inside, name).otherwise(stage), F.when(inside, F.col("row_idx") - start).otherwise(pos)
    parts = placed.select("client_id", stage.alias("stage"), pos.cast("long").alias("pos"), "event_id", "raw")
    attack = with_positions(rows.where("attack"), ["client_id"], "event_id", buckets, "pos")
    return parts.unionByName(attack.select("client_id", F.lit("test_attack").alias("stage"), F.col("pos").cast("long").alias("pos"), "event_id", "raw"))


def scored(stages: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(seed, client_id, stage, pos, event_id, score) for seeds 0, 1, ..."""
    with_seed = stages.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    factor = 1 + 0.01 * ((F.col("event_id") * 31 + F.col("seed") * 17) % 7)
    return with_seed.select("seed", "client_id", "stage", "pos", "event_id", (F.col("raw") * factor).alias("score"))


def scores(spark: SparkSession, sf_dir: str, seeds: int = SEEDS) -> DataFrame:
    return scored(staged(labelled(spark, sf_dir)), seeds)
