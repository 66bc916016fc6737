"""Checks on inputs: each returns the rows that violate a rule, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taulab.constants import FRACTIONS, PAIRS


def require_empty(violations: DataFrame, message: str) -> None:
    """Raises with the first rows if there are any."""
    rows = violations.take(10)
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def invalid_cells(cells: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Cells with a fraction off the grid or an invalid (source, objective) pair, with the rule they break."""
    pair = F.concat_ws("|", "source", "objective")
    rule = F.when(~F.col("fraction").isin(*fractions), "fraction").when(~pair.isin(*("|".join(p) for p in PAIRS)), "pair")
    return cells.withColumn("rule", rule).where("rule IS NOT NULL")


def feature_validity(rows: DataFrame, keys: list[str], features: str) -> DataFrame:
    """(keys, n_rows, min_width, max_width, all_finite): what a feature matrix must have rows, one width and finite values for."""
    x = F.col(features).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(F.size(x)).alias("min_width"), F.max(F.size(x)).alias("max_width"), F.coalesce(F.bool_and(finite), F.lit(False)).alias("all_finite"))


def run_states(markers: DataFrame) -> DataFrame:
    """markers (run_id, marker) -> (run_id, state): exactly one marker is the state, anything else is corrupt."""
    return markers.groupBy("run_id").agg(F.when(F.count("marker") == 1, F.max("marker")).otherwise("corrupt").alias("state"))


def exact_sample(rows: DataFrame, keys: list[str], id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group (all of a smaller one), by an order of ids that depends on the seed."""
    from pyspark.sql import Window

    order = F.pmod((F.col(id_) + 1) * 48271 + seed * 104729, F.lit(1_000_003))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_))).where(F.col("_k") <= n).drop("_k")
