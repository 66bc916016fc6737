"""Intermediate tables in a folder that all executors share.

Writing a stage and reading it again cuts lineage: a lost executor recomputes nothing before it, and plans stay
small however long the chain of stages.  The folder is the one named by ``spark.checkpoint.dir``; only where that is absent
(tests, one machine) a local one is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "file:///tmp/checkpoints"


class Store:
    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.count = spark, 0
        base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
