import itertools
import math

import numpy as np

from taulab.constants import SOURCES
from taulab.operators import inject
from taulab.plans import registry

SF = "/root/testdata/sf0.01"


def test_all_donors_are_returned(spark):
    s = registry.the_sweep(spark, SF)
    train = s.scores.where("stage = 'train'").select("seed", "client_id", "event_id", "pos", "score").collect()
    first = {}
    for r in sorted(train, key=lambda r: r.pos):
        first.setdefault((r.seed, r.client_id, r.event_id), r.score)
    want = {}
    for c in s.clients.select("seed", "client_id").collect():
        scores = sorted((v for (seed, client, _), v in first.items() if seed == c.seed and client != c.client_id), reverse=True)
        want[c.seed, c.client_id, "random"] = sorted(scores)
        want[c.seed, c.client_id, "high"] = sorted(scores[: max(1, math.floor(0.2 * len(scores)))])
    got = {}
    for r in registry.queries()["cross_device_donors_all"](spark, SF).collect():
        got.setdefault((r.seed, r.victim, r.source.split("_")[0]), []).append((r.draw, r.score))
    assert set(got) == set(want) and max(map(len, want.values())) > 50
    for key, rows in got.items():
        assert sorted(d for d, _ in rows) == list(range(1, len(rows) + 1))
        scores = sorted(score for _, score in rows)
        assert len(scores) == len(want[key]) and all(abs(a - b) < 1e-8 for a, b in zip(want[key], scores))


def test_nothing_made_for_a_victim_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inject, "DRAW_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(seed, k, int(rng.integers(0, 150)), i, float(np.round(rng.normal() + (2 if k == "a" else 0), 1))) for seed in (0, 3) for k in "abcd" for i in range(int(rng.integers(40, 120)))]
    rows += [(0, "e", 1000 + i, i, v) for i, v in enumerate((None, float("nan"), float("inf")))]
    train = spark.createDataFrame(rows, "seed long, client_id string, row_id long, pos long, score double")
    victims = [(0, "a"), (0, "d"), (3, "b"), (3, "z"), (9, "a")]
    got = inject.donors(train, spark.createDataFrame(victims, "seed long, client_id string"))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    above = list(itertools.takewhile(lambda x: "Generate posexplode" not in x, plan))
    assert len(above) < len(plan) and not any(w in x for x in above for w in ("Exchange", "Sort ", "Window"))
    want = []
    for seed, victim in victims:
        first = {}
        for s, client, row, pos, score in sorted(rows, key=lambda r: (r[1], r[3])):
            if s == seed and client != victim:
                first.setdefault(row, score)
        high = sorted(first, key=lambda r: (first[r] is None, 0.0 if first[r] is None else -math.inf if math.isnan(first[r]) else -first[r], first[r] is not None and not math.isnan(first[r]), r))
        for source, pool in (("random_train_feature_benign", high), ("high_score_train_feature_benign", high[: max(1, math.floor(0.2 * len(high)))])):
            stream = SOURCES.index(source) * 2000 + 1000
            drawn = sorted(pool, key=lambda r: (((r + 1) * 7919 + (stream + 1) * 104729 + (seed + 1) * 15485863) % inject.PRIME, r))
            want += [(seed, victim, source, k + 1, r, str(first[r]), len(pool)) for k, r in enumerate(drawn)]
    assert sorted((r.seed, r.victim, r.source, r.draw, r.row_id, str(r.score), r.donor_n) for r in got.collect()) == sorted(want)
