import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from taulab.llm import periodic
from taulab.llm.periodic import RunParams, periodic_runs, piece_runs, planted, run_digests

SCHEMA = "doc_id long, text string, runs string, start long"


def brute_runs(words, least=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_plant(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def brute_row(doc_id, text):
    words = brute_plant(doc_id, text)
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


def of_rows(rows, params=RunParams()):
    before = np.cumsum([0, *map(len, rows)])
    words = np.array([x for r in rows for x in r], dtype=np.uint64)
    row, start, length, period = piece_runs(periodic.mix(words), before, params)
    return [[(int(s), int(e), int(q)) for k, s, e, q in zip(row, start, length, period, strict=True) if k == r] for r in range(len(rows))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_runs_of_few_words_match_brute_force(rows):
    assert of_rows(rows) == [brute_runs(r) for r in rows]


def test_other_lengths_and_exponents():
    rng = random.Random(4)
    for least, exponent in ((4, 2), (9, 3), (6, 5), (2, 2)):
        rows = [[rng.randrange(3) for _ in range(90)] for _ in range(5)]
        assert of_rows(rows, RunParams(least, exponent)) == [brute_runs(r, least, exponent) for r in rows]


def test_long_periods_nested_runs_and_noise():
    rng = random.Random(1)
    rows = []
    for period in (1, 2, 3, 17, 100, 333):
        unit = [rng.randrange(50) for _ in range(period)]
        noise = [rng.randrange(10**6) for _ in range(rng.randrange(40))]
        rows.append(noise + [unit[i % period] for i in range(period * 4 + rng.randrange(period + 5))] + noise[::-1])
    inner = [1, 1, 1, 1, 1, 1, 2, 3]
    rows.append(inner * 9)
    rows.append([7] * 500)
    rows.append([0, 1] * 300 + [0, 1, 2] * 200)
    assert of_rows(rows) == [brute_runs(r) for r in rows]


def documents(spark):
    rng = random.Random(2)
    rows = [(None, "a a a a a a b"), (1, None), (2, ""), (3, " \n\t"), (5, "x " * 3_000), (6, "x"), (6, "x"), (7, "é b\u000bé b é b é b\r\nc")]
    for i in range(10, 260):
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(rng.choice("abcdefgh") for _ in range(rng.randrange(120)))))
    return [(i, t, "clash", 3) for i, t in rows]


def test_query_matches_brute_force(spark):
    rows = documents(spark)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = run_digests(periodic_runs(planted(docs)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(i, t) for i, t, *_ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 10


def test_collapsed_text_and_runs_are_whole(spark):
    text = "start " + "one two " * 5 + "end"
    (row,) = periodic_runs(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).collect()
    assert row.collapsed == "start one two end" and [tuple(r) for r in row.runs] == [(1, 10, 2)]


def test_empty_table(spark):
    assert run_digests(periodic_runs(planted(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_a_very_long_text_takes_little_time(spark):
    rng = random.Random(3)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    words = unit * 6
    (row,) = periodic_runs(spark.createDataFrame([(1, " ".join(words), "", 0)], SCHEMA)).collect()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 50_000)] and row.collapsed == " ".join(unit)
