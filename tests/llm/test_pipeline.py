from pyspark.sql import functions as F

import corpus_pipeline
from taulab.llm import decontaminate, minhash
from taulab.llm.quality import judge

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        out[name] = [r.doc_id for r in docs.collect()]
    good = {r.doc_id for r in judge(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    assert set(out["quality rules"]) == good
    assert 0 < len(out["near duplicates"]) < len(good) and set(out["near duplicates"]) <= good
    assert set(out["decontamination"]) < set(out["near duplicates"])
    assert set(out["source mixing"]) <= set(out["decontamination"])
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(shards) == len(out["source mixing"])


def test_run_has_every_record_of_the_mix(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) > 50


def small(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = judge(table).where("kept").join(minhash.near_duplicates(table).where("kept").select("doc_id"), "doc_id", "left_semi").select("doc_id")
    clean = decontaminate.clean_documents(table, spark.read.parquet(f"{SF}/benchmark.parquet"))
    texts = [r.text for r in clean.join(kept, "doc_id", "left_semi").orderBy("doc_id").limit(15).collect()]
    rows = [(k, texts[k], "en", f"s{k % 3}", 1) for k in range(12)]
    rows += [(12, None, "en", "s0", 0), (13, "", None, None, 0), (14, texts[12], None, None, None), (None, texts[13], "en", "s1", 1), (3, texts[3], "en", "s0", 1), (15, texts[4], "de", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({x: F.lit(7) for x in ("_row", "_h", "_copies", "kept", "shard", "_id", "size", "component_id", "n_words")})


def test_stages_with_nulls_ties_repeats_and_clashing_names(spark):
    docs = small(spark)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = sorted(map(str, table.collect()))
            out = stage(spark, table, SF)
            got = out.collect()
            assert out.columns == docs.columns, name
            assert all(r._row == r._copies == r.size == 7 for r in got)
            if name == "near duplicates":
                ids = [r.doc_id for r in got]
                assert ids.count(3) == (1 if before else 0) and 15 not in ids
            if name == "decontamination":
                assert sorted(map(str, got)) == before
            table = spark.createDataFrame(got, docs.schema)
        shards = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
        assert len(shards) == table.count() == len({(r.shard, r.slot) for r in shards})
    kept = [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()]
    assert 12 not in kept and 13 not in kept and kept.count(3) == 2 and 14 in kept
