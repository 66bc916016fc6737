"""Shared folder for intermediate tables.

Tables are written under the folder named by ``spark.checkpoint.dir``, which all
executors of a cluster share, so a lost executor costs no recomputation beyond the
last written table.  Only where that setting is absent (tests, one machine) a local
folder is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "file:///tmp/checkpoints"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


class Workspace:
    """A private folder; ``save`` cuts lineage by writing and rereading a table.

    tidy: a table's shuffle files go when it has been written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False) -> None:
        self.spark, self.tidy = spark, tidy
        base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``save`` returned and nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._workspace_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
