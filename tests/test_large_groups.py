"""Groups above the limit: ten registered queries by rounds of histograms and by ranges, against their SQL."""

import duckdb
import pytest

from taulab.operators import quantiles
from taulab.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES = ("tau_local", "tau_global", "thresholds_all_policies", "cv_iqr", "scale_base", "fingerprints", "trimmed_cal", "ecdf", "reservoir_high", "delta_tau", "trust_boundary")


@pytest.fixture
def few(monkeypatch):
    registry.forget()
    monkeypatch.setattr(quantiles, "LARGE", 60)
    yield
    registry.forget()


def rows(table, columns):
    return sorted(tuple("" if v is None or v != v else f"{v:.7f}" if isinstance(v, float) else str(v) for v in r) for r in table[columns].astype(object).itertuples(index=False))


def test_ten_queries_with_groups_above_the_limit(spark, few, monkeypatch):
    rounds = []
    found = quantiles.order_statistics
    monkeypatch.setattr(quantiles, "order_statistics", lambda *a, **b: rounds.append(1) or found(*a, **b))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    for name in QUERIES:
        got = registry.queries()[name](spark, SF).toPandas()
        want = db.execute(registry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and len(got) == len(want) > 0, name
        assert rows(got, columns) == rows(want, columns), name
    assert len(rounds) >= 7
