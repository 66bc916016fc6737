"""Grid runs that can be resumed: results by cell, kept for one state of the inputs.

A state is a digest of the inputs' rows and of the parameters.  Results are written by dynamic partition overwrite under the state and the
cell's keys; a cell counts as finished only when its marker, written last, is there.  So a run that was killed leaves cells without
markers, which the next run computes again and overwrites, and other inputs or parameters have results of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: count, sum and XOR of two row hashes, from one scan.

    Sums are decimals: those of 40 bits pass a long from about 16 million rows on.
    """
    columns = sorted(df.columns)
    row = F.struct(*(F.col(c) for c in columns))
    first, second = F.xxhash64(row), F.xxhash64(F.lit("second"), row)
    total = lambda h: F.sum(F.pmod(h, F.lit(1 << 40)).cast("decimal(18,0)"))
    parts = df.agg(F.count("*"), F.bit_xor(first), F.bit_xor(second), total(first), total(second)).first()
    return hashlib.sha256(json.dumps([columns, [str(df.schema[c].dataType.simpleString()) for c in columns], *(str(p) for p in parts)]).encode()).hexdigest()


def state_of(inputs: dict[str, DataFrame], params: dict) -> str:
    """The digest under which results of these inputs and parameters are kept."""
    prints = {name: fingerprint(df) for name, df in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([prints, params], sort_keys=True, default=str).encode()).hexdigest()[:32]


class GridRun:
    """Results of a grid below a folder; ``keys`` tell its cells apart and are columns of the results."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], state: str) -> None:
        self.spark, self.root, self.keys, self.state = spark, root.rstrip("/"), keys, state

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        try:
            found = self.spark.read.parquet(path).schema
            # keys as they are written: "01" is no number
            kept = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("state", *self.keys) else f.dataType) for f in found])
            return self.spark.read.schema(kept).parquet(path).where(F.col("state") == self.state).drop("state")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _write(self, df: DataFrame, name: str) -> None:
        out = df.withColumn("state", F.lit(self.state)).repartition(*self.keys)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state", *self.keys).parquet(f"{self.root}/{name}")

    def missing(self, cells: DataFrame) -> DataFrame:
        """The cells without a marker."""
        marks = self._read("marks")
        typed = cells.select(*self.keys).distinct()
        if marks is None:
            return typed
        done = marks.select(*(F.col(k).cast(typed.schema[k].dataType).alias(k) for k in self.keys))
        return typed.join(done, self.keys, "left_anti")

    def run(self, cells: DataFrame, compute: Callable[[DataFrame], DataFrame], waves: int = 1) -> int:
        """Compute what is missing, in so many portions, each committed by its markers; returns how many cells were computed."""
        left = self.missing(cells).withColumn("_wave", F.pmod(F.xxhash64(*self.keys), F.lit(waves)))
        counts = {r["_wave"]: r["count"] for r in left.groupBy("_wave").count().collect()}
        for wave in sorted(counts):
            todo = left.where(F.col("_wave") == wave).drop("_wave")
            self._write(compute(todo), "results")
            self.mark(todo)
        return sum(counts.values())

    def mark(self, cells: DataFrame) -> None:
        """Markers with the rows that each cell's stored results have, none included."""
        stored = self._read("results")
        rows = cells.select(*self.keys).distinct()
        if stored is not None:
            sizes = stored.groupBy(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in self.keys)).agg(F.count("*").alias("rows"))
            rows = rows.join(sizes, self.keys, "left")
        else:
            rows = rows.withColumn("rows", F.lit(None).cast("long"))
        self._write(rows.withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))), "marks")

    def results(self, cells: DataFrame) -> DataFrame | None:
        """The results of the finished cells among these."""
        stored, typed = self._read("results"), cells.select(*self.keys).distinct()
        if stored is None:
            return None
        named = stored.withColumns({k: F.col(k).cast(typed.schema[k].dataType) for k in self.keys})
        return named.join(typed.join(self.missing(cells), self.keys, "left_anti"), self.keys, "left_semi")

    def status(self, cells: DataFrame) -> DataFrame:
        """(keys, status): complete, or missing."""
        typed = cells.select(*self.keys).distinct()
        return typed.join(self.missing(cells).withColumn("_m", F.lit(True)), self.keys, "left").select(*self.keys, F.when(F.col("_m"), "missing").otherwise("complete").alias("status"))

    def forget_others(self) -> None:
        """Delete the results of all other states."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in ("marks", "results"):  # markers first
            fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in fs.globStatus(path(f"{self.root}/{name}/state=*")) or []:
                if found.getPath().getName() != f"state={self.state}":
                    fs.delete(found.getPath(), True)
