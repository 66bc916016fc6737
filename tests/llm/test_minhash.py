import re

import pytest

from taulab.llm.minhash import MinHashParams, near_duplicates

SF = "/root/testdata/sf0.001"


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_matches_brute_force_on_a_table(spark, width, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs, MinHashParams(width=width, percent=percent))) == brute(rows, width, percent)


def test_chains_blocks_and_odd_rows(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(100 + k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(20)]  # neighbours overlap, ends don't
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "x" * 3000 + " y z"), (9, "Ünï a b c"), (8, "ÜNÏ a b c")]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_shingles int, kept string")
    for block in (128, 4):
        got = result(near_duplicates(docs, MinHashParams(width=3, percent=85, block=block)))
        assert got == brute(rows, 3, 85)
    assert got[119][1] == 100 and got[5][1] == 4 and got[1] == (0, 1, True)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (2, "a b c d")], schema)
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 1, 2, False), (3, 1, 2, False), (None, 1, None, False), (2, 1, 2, True)], key=str) or all(r[1] == 1 for r in got)
    assert [(r[0], r[2], r[3]) for r in got if r[0] is not None].count((3, 2, False)) == 2
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
