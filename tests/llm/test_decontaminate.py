import hashlib
import re

import pytest

from taulab.llm.decontaminate import DecontaminationParams, decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    out = []
    for i, t in docs:
        w, hit, got, near = words(t), set(), set(), set()
        for item, text in items:
            b = words(text)
            for s in range(max(1, len(b) - k + 1) if b else 0):
                win = b[s : s + k]
                if any(all(any(0 <= x + j + d < len(w) and w[x + j + d] == v for d in range(-2, 3)) for j, v in enumerate(win)) for x in range(-2, len(w))):
                    near.add(str(item))
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        got.add(str(item))
        digest = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(got), digest(got), bool(hit), len(near), digest(near)))
    return sorted(out, key=str)


LONG = " ".join(f"t{i}" for i in range(14))
ITEMS = [(10, LONG), (9, "Short, ITEM"), (7, "the the the the the the the the the the the"), (3, "?!"), (4, None), (11, LONG)]
DOCS = [
    (1, "x " + LONG.upper() + " y"),
    (2, None),
    (3, ""),
    (4, "a short-item b short item short item"),
    (5, "the " * 30),
    (6, " ".join(f"t{i}" for i in range(9))),
    (7, "t0"),
    (8, " ".join(f"t{i}" for i in range(1, 14)) + " é t3 t4"),
    (8, "t1 " * 20000 + "Short item"),
    (12, " ".join(f"t{i}" + " z" * (i % 5 == 1) for i in range(14))),
    (13, "item x short b c"),
    (14, "t1 t0 t2 t3 t5 t4 t6 t7 t9 t8 t10"),
]


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_matches_brute_force_in_one_block_and_in_many(spark, block_words):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in DOCS], "doc_id long, text string, items string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs, items, DecontaminationParams(block_words=block_words)).drop("items", "near_items")
    assert sorted(map(tuple, out.collect()), key=str) == brute(DOCS, ITEMS)


def test_matches_do_not_depend_on_what_else_lies_in_a_shard(spark):
    """Whichever term is the rarest one beside the document, the same items are found."""
    text = "t0 t1 x t2 t3 t4 y t5 t6 t7 t8 t9"
    for other in ("", *(f"t{i} " * 50 for i in range(10))):
        docs = spark.createDataFrame([(1, text), (2, " ".join(f"t{i} " * 50 for i in range(10)).replace(other, "") if other else "")], "doc_id long, text string").coalesce(1)
        row = decontaminate(docs, spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(10)))], "item_id long, text string")).where("doc_id = 1").first()
        assert (row.n_items, row.n_near_items) == (0, 1)


def test_proximity_allows_a_word_between(spark):
    docs = spark.createDataFrame([(1, " ".join([f"t{i}" for i in range(5)] + ["x"] + [f"t{i}" for i in range(5, 14)]))], "doc_id long, text string")
    row = decontaminate(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string")).first()
    assert row.n_hit == 0 and row.near_items == [10]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate(docs, items.limit(0)).first().n_hit == 0
