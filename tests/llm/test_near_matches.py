import pytest

from taulab.llm.decontaminate import DecontaminationParams, clean_documents
from taulab.llm.registry import queries

PASSAGE = [f"t{i}" for i in range(40)]
DOCS = [
    (1, " ".join(PASSAGE)),
    (2, " ".join(w + " x" if i % 8 == 4 else w for i, w in enumerate(PASSAGE))),
    (3, "no such words stand in this text"),
    (4, " ".join(PASSAGE[::-1])),
    (5, None),
]


def tables(spark, folder):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, " ".join(PASSAGE))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_near_matches_are_a_result(spark, tmp_path):
    out = queries()["op4_near_matches"](spark, tables(spark, tmp_path)).collect()
    assert {r.doc_id: (r.n_items, r.n_near_items, r.near) for r in out} == {1: (1, 1, True), 2: (0, 1, True), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False)}


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_documents_with_near_matches_go(spark, tmp_path, block_words):
    folder = tables(spark, tmp_path)
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    out = clean_documents(docs, items, DecontaminationParams(block_words=block_words)).collect()
    assert sorted(r.doc_id for r in out) == [3, 4, 5]
