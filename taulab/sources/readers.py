"""Readers of the experiment's files: device CSVs, split and score tables, JSON documents; all by Spark's readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ("gafgyt_attacks", "mirai_attacks")
SCORE_COLUMN = "reconstruction_error"
SCORES = T.StructType([T.StructField("seed", T.LongType()), T.StructField("client_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])


def feature_schema(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"feat_{i}", T.DoubleType()) for i in range(n)])


def device_csv(spark: SparkSession, root: str, features: int = 115, columns: list[str] | None = None) -> DataFrame:
    """(client_id, kind, attack_class, row_idx, features) of ``root/<device>/benign_traffic.csv`` and ``root/<device>/<family>/*.csv``.

    Columns are declared, not inferred.  row_idx is the place in file order: splits of a file are read in order of their offsets, so a
    file needs no single task.
    """
    names = columns or feature_schema(features).names
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    read = lambda glob: spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(f"{root}/{glob}")
    path = F.col("_metadata.file_path")
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    parts = []
    for glob, kind in (("*/benign_traffic.csv", "benign"), *((f"*/{f}/*.csv", "attack") for f in FAMILIES)):
        try:
            rows = read(glob)
        except Exception as e:  # a family without files
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        depth = 2 if kind == "benign" else 3
        device = F.element_at(F.split(path, "/"), -depth)
        stem = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
        family = F.regexp_replace(F.element_at(F.split(path, "/"), -2), "_attacks$", "")
        label = F.lit(None).cast("string") if kind == "benign" else F.concat_ws("_", family, stem)
        parts.append(rows.select(device.alias("client_id"), F.lit(kind).alias("kind"), label.alias("attack_class"), F.array(*names).alias("features"), F.struct(F.coalesce(label, F.lit("")).alias("c"), at.alias("at")).alias("order")))
    if not parts:
        return spark.createDataFrame([], "client_id string, kind string, attack_class string, row_idx long, features array<double>")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    idx = F.row_number().over(Window.partitionBy("client_id", "kind").orderBy("order")) - 1
    return every.select("client_id", "kind", "attack_class", idx.cast("long").alias("row_idx"), "features")


def score_files(spark: SparkSession, root: str) -> DataFrame:
    """(stage, client_id, pos, score) of ``root/<stage>/<client>.parquet``, each with the one floating column of scores."""
    schema = spark.read.parquet(f"{root}/*/*.parquet").schema
    if schema.names != [SCORE_COLUMN] or not isinstance(schema[0].dataType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"a score file has the column {SCORE_COLUMN} of a floating type, not {schema.simpleString()}")
    parts = F.split(F.col("_metadata.file_path"), "/")
    client = F.regexp_replace(F.element_at(parts, -1), r"\.parquet$", "")
    rows = spark.read.schema(schema).parquet(f"{root}/*/*.parquet").select(F.element_at(parts, -2).alias("stage"), client.alias("client_id"), F.col(SCORE_COLUMN).cast("double").alias("score"), F.monotonically_increasing_id().alias("at"))
    pos = F.row_number().over(Window.partitionBy("stage", "client_id").orderBy("at")) - 1
    return rows.select("stage", "client_id", pos.cast("long").alias("pos"), "score")


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned score table that ``write_scores`` makes; filters on seed, client and stage prune files."""
    return spark.read.schema(SCORES).parquet(path)


def split_manifest(spark: SparkSession, path: str) -> dict:
    """What ``write_split_manifest`` wrote; splits without it are not finished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.manifest.json")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} holds no finished splits")
    return json.loads(spark.read.text(f"{path}.manifest.json", wholetext=True).first()[0])


def splits(spark: SparkSession, path: str, width: int, clients: list[str] | DataFrame | None = None, splits: list[str] | None = None) -> DataFrame:
    """(features, client_id, split) of a finished set of splits, from the folders of the wanted clients and splits only.

    clients: ids, or a table with client_id, by which folders are pruned while the query runs.
    """
    found = split_manifest(spark, path)["width"]
    if found != width:
        raise ValueError(f"{path} has {found} features, not {width}")
    rows = spark.read.schema("features array<double>, client_id string, split string").parquet(path)
    if splits is not None:
        rows = rows.where(F.col("split").isin(*splits))
    if isinstance(clients, DataFrame):
        return rows.join(F.broadcast(clients.select("client_id").distinct()), "client_id")  # as many rows as folders at most
    return rows if clients is None else rows.where(F.col("client_id").isin(*clients))


def documents_json(spark: SparkSession, path: str, schema: str | T.StructType, results: str | None = None) -> DataFrame:
    """JSON documents (malformed ones fail); with ``results`` the rows of that array, with NaN as null."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.explode(results).alias("r")).select("r.*") if results else docs


def file_hashes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def hash_mismatches(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """recorded (path, sha256) files that are missing or differ."""
    return recorded.join(found.select("path", F.col("sha256").alias("now")), "path", "left").where("now IS NULL OR now <> sha256")


def schema_audit(spark: SparkSession, path: str, features: int) -> None:
    """The number of columns of a table, read from the files' footers only."""
    got = len(spark.read.parquet(path).schema)
    if got != features:
        raise ValueError(f"{path} has {got} columns, not {features}")


def score_records(scores: DataFrame) -> DataFrame:
    """(client_id, stage, rows, min_score, max_score, n_nan): finite extremes of each score set."""
    x = F.col("score")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return scores.groupBy("client_id", "stage").agg(F.count("*").alias("rows"), F.min(finite).alias("min_score"), F.max(finite).alias("max_score"), F.count_if(F.isnan(x)).alias("n_nan"))


def missing_sets(scores: DataFrame, clients: DataFrame, stages: tuple[str, ...] = ("cal", "test_benign", "test_attack")) -> DataFrame:
    """(client_id, stage) that a complete table would have and this one has not."""
    wanted = clients.select("client_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return wanted.join(scores.select("client_id", "stage").distinct(), ["client_id", "stage"], "left_anti")


def require(df: DataFrame, condition: str, message: str) -> DataFrame:
    """The same rows; reading one that violates the condition fails with the message."""
    return df.where(F.when(F.expr(f"NOT coalesce({condition}, false)"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
