"""Writers: partitioned tables, report records as CSV and JSON, the results table as LaTeX."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import fingerprint


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per seed, stage and client, so that readers prune by them."""
    scores.repartition("seed", "stage", "client_id").write.mode(mode).partitionBy("seed", "stage", "client_id").parquet(path)


def delete(spark, path: str) -> None:
    """A file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_splits(rows: DataFrame, path: str, width: int, mode: str = "overwrite") -> None:
    """Feature rows (client_id, split, features, ...); a row of another width fails."""
    checked = rows.where(F.when(F.size("features") != width, F.raise_error(F.lit(f"a row has not {width} features")).cast("boolean")).otherwise(True))
    checked.write.mode(mode).partitionBy("client_id", "split").parquet(path)


def write_split_manifest(spark, path: str) -> dict:
    """Rows by client and split (beside the folder, in .counts), the width and a digest of all rows, in .manifest.json, which is written last: without it
    the folder is no finished set of splits."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("client_id", "split").agg(F.count("*").alias("n")).groupBy("client_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("splits"))
    sizes = rows.agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width"), F.count_distinct("client_id").alias("clients")).first()
    counts.orderBy("client_id").write.mode("overwrite").json(f"{path}.counts")
    manifest = {"rows": sizes["rows"], "width": sizes["width"], "clients": sizes["clients"], "digest": fingerprint(rows)}
    write_json(manifest, spark, f"{path}.manifest.json")
    return manifest


def sorted_records(records: DataFrame) -> DataFrame:
    """Columns by name; NaN as null; arrays, maps and structs as JSON text."""
    out = []
    for name, kind in sorted(records.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.nullif(c, F.lit(float("nan")))
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return records.select(*out)


def write_records(records: DataFrame, path: str, order: list[str]) -> None:
    """A report as one CSV and one JSON-lines file (reports have few rows); nulls stay empty or null."""
    rows = sorted_records(records).orderBy(*order).coalesce(1)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}.json")


def write_json(value, spark, path: str) -> None:
    """A small document as sorted, indented JSON through Spark's file system; NaN and infinities as null."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(clean(value), indent=2, sort_keys=True).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


COLUMNS = (("cv_fpr", "CV(FPR)", min), ("cv_tpr", "CV(TPR)", min), ("min_balanced_accuracy", "Worst BA", max), ("p10_macro_f1", "P10 macro-F1", max))


def latex_table(results: DataFrame) -> str:
    """The results table (one row per policy): mean and deviation, the best mean of a column in bold, --- for undefined."""
    rows = sorted((r.asDict() for r in results.collect()), key=lambda r: r["policy"])
    best = {c: how((r[f"{c}_mean"] for r in rows if r[f"{c}_mean"] is not None), default=None) for c, _, how in COLUMNS}

    def cell(r, c):
        m, s = r[f"{c}_mean"], r[f"{c}_std"]
        if m is None or math.isnan(m):
            return "---"
        text = f"{m:.3f} \\pm {s or 0:.3f}"
        return f"$\\mathbf{{{text}}}$" if m == best[c] else f"${text}$"

    head = " & ".join(["Policy", *(t for _, t, _ in COLUMNS)])
    body = [" & ".join([r["policy"].replace("_", "\\_"), *(cell(r, c) for c, _, _ in COLUMNS)]) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{lcccc}", r"\toprule", head + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"
