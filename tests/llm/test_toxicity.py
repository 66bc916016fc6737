import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from taulab.llm.toxicity import ToxicityParams, fit_pair, score_documents

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, lang string"


def slow_evidence(texts, toxic, p, probe):
    """The models written out with dictionaries: evidence of each word of probe."""
    n = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, toxic):
        for w in t.lower().split():
            s = [0, *w.encode(), 1]
            for i in range(1, len(s)):
                n[y][tuple(s[max(0, i - p.order) : i]), s[i]] += 1
    pooled = n[0] + n[1]
    levels = {}
    top = {k for k in pooled}
    longer = top
    for k in range(p.order, -1, -1):
        counts = Counter({x: pooled[x] for x in top if len(x[0]) == k})
        if k < p.order:
            counts.update(Counter((h[1:], x) for h, x in longer if len(h) == k + 1))
        levels[k] = counts
        longer = {(h[-k:] if k else (), x) for h, x in top if len(h) >= k}
    total = {k: Counter() for k in levels}
    kinds = {k: Counter() for k in levels}
    for k, c in levels.items():
        for (h, _), v in c.items():
            total[k][h] += v
            kinds[k][h] += 1

    def shared(h, x):
        q = 1 / 256
        for k in range(len(h) + 1):
            g = h[len(h) - k :]
            q = (max(levels[k][g, x] - p.discount, 0) + p.discount * kinds[k][g] * q) / total[k][g]
        return q

    by = {c: Counter() for c in n}
    kind = {c: Counter() for c in n}
    for c in n:
        for (h, _), v in n[c].items():
            by[c][h] += v
            kind[c][h] += 1
    out = []
    for w in probe:
        s, e = [0, *w.encode(), 1], 0.0
        for i in range(1, len(s)):
            h, x = tuple(s[max(0, i - p.order) : i]), s[i]
            if h not in by[0] and h not in by[1]:
                continue
            back = {c: p.strength + p.discount * kind[c][h] for c in n}
            q = shared(h, x) if (h, x) in pooled else 1.0
            seen = {c: max(n[c][h, x] - p.discount, 0) if (h, x) in pooled else 0 for c in n}
            e += math.log((seen[1] + back[1] * q) / (p.strength + by[1][h])) - math.log((seen[0] + back[0] * q) / (p.strength + by[0][h]))
        out.append(e)
    return out


def test_models_match_the_formulas():
    texts = ["you utter idiot go away", "idiots all of them idiotic", "a kind word to all", "words of kindness go far", "away with words"]
    toxic = np.array([1, 1, 0, 0, 0])
    p = ToxicityParams(order=3, strength=2.0)
    probe = ["idiot", "idiotics", "kind", "zebra", "words"]
    model = fit_pair(pa.array(texts), toxic, p)
    got = [model.evidence(pa.array([w]), (0.0,))[0, 0] * (len(w) + 1) for w in probe]
    assert got == pytest.approx(slow_evidence(texts, toxic, p, probe), rel=1e-4, abs=1e-5)


def test_held_out_accuracy_and_folds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(out[i].score, out[i].predicted, y) for i, y in truth.items() if out[i].held_out]
    assert sum(p == y for _, p, y in held) / len(held) > 0.9
    yes, no = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no)) > 0.8


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "vile muck" if i % 2 else "kind words", "x", "y") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2) for i in range(200)], "doc_id long, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in score_documents(docs, labels).collect())


def test_odd_rows(spark):
    rows = [(i, "vile muck" if i % 2 else "kind words", "x", "y") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "", ""), (None, "vile muck", "", ""), (1, "vile muck", "", ""), (103, "muck " * 30000, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, None), (3, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    out = score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(r.predicted == 1 for r in out if r.doc_id in (None, 103, 1))
    assert score_documents(docs.limit(0), labels).collect() == []
    assert {r.score for r in score_documents(docs, labels.limit(0)).collect()} == {0.0}


def test_the_layout_changes_no_score(spark):
    rows = [(i, f"{'vile muck' if i % 2 else 'kind words'} {k} {i % 7}", "x", "y") for i in range(80) for k in ("first", "other", "third")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    runs = [sorted((r.doc_id, r.score) for r in score_documents(docs.orderBy(*order).repartition(n), labels.repartition(n)).collect()) for n, order in ((1, ["doc_id", "text"]), (5, ["text"]))]
    assert runs[0] == runs[1]
