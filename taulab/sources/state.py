"""Run markers and model weights in the shared store, through Spark's file system."""

from __future__ import annotations

import hashlib
import json
import traceback
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import fingerprint

IN_PROGRESS, DONE, ABORTED, CORRUPT, MISSING = "in_progress", "done", "aborted", "corrupt", "missing"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def run_state(spark: SparkSession, folder: str) -> str:
    """The one marker in a run's folder; none is missing, several are corrupt."""
    found = []
    for name in (IN_PROGRESS, DONE, ABORTED):
        fs, p = _fs(spark, f"{folder}/_{name}")
        if fs.exists(p):
            found.append(name)
    return found[0] if len(found) == 1 else CORRUPT if found else MISSING


class Run:
    """``with Run(spark, folder)``: in progress inside, then done, or aborted with the traceback."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _only(self, name: str, text: str = "") -> None:
        _put(self.spark, f"{self.folder}/_{name}", text)
        for other in {IN_PROGRESS, DONE, ABORTED} - {name}:
            fs, p = _fs(self.spark, f"{self.folder}/_{other}")
            fs.delete(p, False)

    def __enter__(self) -> Run:
        self._only(IN_PROGRESS)
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._only(DONE) if kind is None else self._only(ABORTED, "".join(traceback.format_exception(kind, value, trace)))


def pending_runs(runs: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of a grid without a finished result."""
    return runs.join(finished.select(*keys).distinct(), keys, "left_anti")


def weights_hash(weights: list[np.ndarray]) -> str:
    h = hashlib.sha256()
    for a in weights:
        h.update(json.dumps(a.shape).encode() + np.ascontiguousarray(a, "<f8").tobytes())
    return h.hexdigest()


def save_weights(spark: SparkSession, weights: list[np.ndarray], path: str) -> str:
    """One row per array, with the hash of all; returns it."""
    digest = weights_hash(weights)
    rows = [(k, [int(n) for n in a.shape], a.ravel().astype(float).tolist(), digest) for k, a in enumerate(weights)]
    spark.createDataFrame(rows, "k int, shape array<int>, data array<double>, sha256 string").coalesce(1).write.mode("overwrite").parquet(path)
    return digest


def load_weights(spark: SparkSession, path: str) -> list[np.ndarray]:
    """The arrays in order; a file whose hash doesn't hold is refused."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.k)
    weights = [np.array(r.data).reshape(r.shape) for r in rows]
    if {r.sha256 for r in rows} != {weights_hash(weights)}:
        raise ValueError(f"weights in {path} don't match their hash")
    return weights


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't become {target}")


def save_scaler(spark: SparkSession, stats: DataFrame, path: str) -> str:
    """Store (key, mean, std) of ``feature_stats`` as a new version and return its digest.

    The table is written aside and named by its digest; CURRENT, a small file that is renamed into place last, names the version
    in use.  What a stopped writer leaves is never read.
    """
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    stats.select("key", "mean", "std").write.parquet(aside)
    digest = fingerprint(spark.read.parquet(aside))
    fs, version = _fs(spark, f"{path}/{digest}")
    if fs.exists(version):  # the same figures are there already
        fs.delete(_fs(spark, aside)[1], True)
    else:
        _rename(spark, aside, f"{path}/{digest}")
    _put(spark, f"{path}/_pointer-{digest}", digest)
    fs.delete(_fs(spark, f"{path}/CURRENT")[1], False)
    _rename(spark, f"{path}/_pointer-{digest}", f"{path}/CURRENT")
    return digest


def load_scaler(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The version in use; rows of another width or with figures that are not finite, or another digest than its name, are errors."""
    fs, current = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(current):
        raise FileNotFoundError(f"{path} holds no finished scaler")
    digest = spark.read.text(f"{path}/CURRENT").first()[0]
    stats = spark.read.parquet(f"{path}/{digest}")
    if fingerprint(stats) != digest:
        raise ValueError(f"the scaler in {path} doesn't match its digest")
    fine = lambda c: (F.size(c) == width) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    wrong = stats.where(~F.coalesce(fine("mean") & fine("std"), F.lit(False))).select("key").take(5)
    if wrong:
        raise ValueError(f"scalers that have not {width} finite figures: {[r.key for r in wrong]}")
    return stats
