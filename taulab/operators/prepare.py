"""A fleet's feature rows made ready for training, stored and audited.

Every client's benign rows are split in order, all rows are scaled by the client's own training rows, and benign test rows are drawn down to
the number of attack rows.  Splits, scaler and manifest are stored; without the manifest, which is written last, a fleet is not finished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taulab.constants import PREPARED_SPLITS
from taulab.sources import events, readers, sinks, state
from taulab.sources.store import Store

from .guards import feature_validity, require_empty
from .inject import PRIME
from .ladder import ranked
from .scaling import feature_stats, scale_by


def draw_order(id_: str) -> Column:
    """The order in which benign test rows are drawn; ids break its ties."""
    return F.pmod(F.col(id_) * 48271 + 7, F.lit(PRIME))


def balanced(rows: DataFrame, store: Store, largest: int | None = None) -> DataFrame:
    """rows (client_id, stage, event_id, ...) with as many benign as attack test rows, where a client has some attack rows but fewer."""
    n = rows.groupBy("client_id").agg(F.count_if(F.col("stage") == "test_attack").alias("n_attack"))
    drawn = ranked(rows.where("stage = 'test_benign'"), ["client_id"], [draw_order("event_id"), "event_id"], store, "draw", largest)
    kept = drawn.join(n, "client_id").where("n_attack = 0 OR draw < n_attack").drop("draw", "n_attack")
    return rows.where("stage <> 'test_benign'").unionByName(kept)


def prepare(rows: DataFrame, path: str, width: int, store: Store, largest: int | None = None) -> dict:
    """Store rows (client_id, attack, row_idx, features) as scaled splits below path and return their manifest.

    A row of another width or with a figure that is null or not finite fails; a client without training rows has no scaler and no rows.
    largest: rows of the largest client, counted if not known.
    """
    spark = rows.sparkSession
    sinks.delete(spark, f"{path}.manifest.json")
    fine = f"size(features) = {width} AND forall(features, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))"
    checked = readers.require(rows, fine, f"features must be {width} finite figures")
    staged = events.staged(checked.select("client_id", "attack", F.col("row_idx").alias("event_id"), F.col("features").cast("array<double>").alias("raw")), largest)
    staged = store.save(staged.where(F.col("stage").isin(*PREPARED_SPLITS)), "staged")
    stats = feature_stats(staged.where("stage = 'train'"), "client_id", "raw")
    state.save_scaler(spark, stats.withColumnRenamed("client_id", "key"), f"{path}.scaler")
    stats = state.load_scaler(spark, f"{path}.scaler", width).withColumnRenamed("key", "client_id")
    scaled = scale_by(balanced(staged, store, largest), "client_id", "raw", stats)
    sinks.write_splits(scaled.select("client_id", F.col("stage").alias("split"), F.col("scaled").alias("features")), path, width)
    return sinks.write_split_manifest(spark, path)


def prepared_audit(spark: SparkSession, path: str, clients: DataFrame, width: int, required: tuple[str, ...] = PREPARED_SPLITS, recorded: str | None = None) -> DataFrame:
    """(client_id, split, problem) of a stored fleet against the wanted clients (client_id); no row is a complete fleet.

    Splits are missing, unexpected, of another width, not finite, or have another number of rows than recorded (count); a client has no
    scaler, or one that nobody wants (split is null).  recorded: the path whose counts and scaler hold, if not this one's.  Rows are read once and only figures by client and split are joined.
    """
    rows = spark.read.schema("features array<double>, client_id string, split string").parquet(path)
    keys = ["client_id", "split"]
    found = feature_validity(rows, keys, "features")
    recorded = recorded or path
    counts = spark.read.schema("client_id string, splits map<string, bigint>").json(f"{recorded}.counts")
    counts = counts.select("client_id", F.explode("splits").alias("split", "recorded"))
    ids = clients.select(F.col("client_id").cast("string")).distinct()
    wanted = ids.select("client_id", F.explode(F.array(*map(F.lit, required))).alias("split"), F.lit(True).alias("wanted"))
    each = wanted.join(found, keys, "full").join(counts, keys, "full")
    n = F.coalesce("n_rows", F.lit(0))
    problem = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    problems = F.array_compact(F.array(
        problem(F.col("wanted") & (n == 0), "missing"),
        problem(F.col("wanted").isNull() & (n > 0), "unexpected"),
        problem((n > 0) & ((F.col("min_width") != width) | (F.col("max_width") != width)), "width"),
        problem((n > 0) & ~F.col("all_finite"), "not finite"),
        problem(n != F.coalesce("recorded", F.lit(0)), "count"),
    ))
    in_splits = each.select(*keys, F.explode(problems).alias("problem"))
    scalers = state.load_scaler(spark, f"{recorded}.scaler", width).select(F.col("key").alias("client_id"), F.lit(True).alias("scaler"))
    both = ids.withColumn("wanted", F.lit(True)).join(scalers, "client_id", "full")
    in_scalers = both.select("client_id", F.lit(None).cast("string").alias("split"), F.when(F.col("scaler").isNull(), "no scaler").when(F.col("wanted").isNull(), "unexpected scaler").alias("problem"))
    return in_splits.unionByName(in_scalers.where("problem IS NOT NULL"))


def require_prepared(spark: SparkSession, path: str, clients: DataFrame, width: int) -> None:
    """Raises unless a finished fleet with all of these clients is there."""
    readers.split_manifest(spark, path)
    require_empty(prepared_audit(spark, path, clients, width), f"{path} is no complete fleet")
