import json

import pytest
from pyspark.sql import functions as F

from taulab.operators.scaling import feature_stats
from taulab.sources import documents, readers, runs, sinks, state


def grid(spark):
    return spark.createDataFrame([(s, p) for s in range(3) for p in ("01", "b")], "seed long, policy string")


def test_a_killed_run_is_taken_up_and_stale_inputs_are_computed_again(spark, tmp_path):
    data = spark.createDataFrame([(s, float(v)) for s in range(3) for v in range(s + 1)], "seed long, v double")
    computed = []

    def compute(todo):
        computed.extend(sorted(map(tuple, todo.collect())))
        return todo.join(data.where("seed <> 1"), "seed").withColumn("w", F.col("v") * 2)  # seed 1 has no rows

    def stopped(todo):
        run._write(compute(todo), "results")
        raise KeyboardInterrupt  # before the markers

    run = runs.GridRun(spark, f"file://{tmp_path}", ["seed", "policy"], runs.state_of({"data": data}, {"k": 2}))
    assert run.run(grid(spark).where("seed = 0"), compute) == 2
    with pytest.raises(KeyboardInterrupt):
        run.run(grid(spark).where("seed = 2"), stopped)
    assert run.results(grid(spark)).count() == 2 and run.missing(grid(spark)).count() == 4
    computed.clear()
    assert run.run(grid(spark), compute, waves=3) == 4
    assert sorted(computed) == [(1, "01"), (1, "b"), (2, "01"), (2, "b")]
    out = sorted((r.seed, r.policy, r.w) for r in run.results(grid(spark)).collect())
    assert out == sorted((s, p, 2.0 * v) for s in (0, 2) for p in ("01", "b") for v in range(s + 1))
    assert {r.status for r in run.status(grid(spark)).collect()} == {"complete"} and run.run(grid(spark), compute) == 0
    changed = data.withColumn("v", F.when(F.col("seed") == 2, F.col("v") + 1).otherwise(F.col("v")))
    other = runs.GridRun(spark, f"file://{tmp_path}", ["seed", "policy"], runs.state_of({"data": changed}, {"k": 2}))
    assert other.missing(grid(spark)).count() == 6 and other.run(grid(spark).where("seed = 0"), compute) == 2
    other.forget_others()
    assert run.missing(grid(spark)).count() == 6 and other.results(grid(spark)).count() == 2


def test_fingerprints_see_rows_and_not_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k long, v string")
    assert runs.fingerprint(a) == runs.fingerprint(a.orderBy(F.desc("k")).repartition(3))
    others = [a.distinct(), a.withColumn("v", F.coalesce("v", F.lit(""))), a.withColumnRenamed("k", "j"), a.withColumn("k", F.col("k").cast("int")), a.limit(0)]
    assert len({runs.fingerprint(x) for x in [a, *others]}) == 6


def test_fingerprints_of_more_rows_than_a_sum_of_longs_holds(spark):
    many = spark.range(1 << 25)
    assert runs.fingerprint(many) != runs.fingerprint(many.where("id <> 7"))


def test_fingerprints_are_those_of_stored_states(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k long, v string")
    assert runs.fingerprint(a) == "08f67ac60509518f630acb8d946688e2127146c1bee9e1a45b716ac9c671d8c9"


SCHEMA = documents.DocumentSchema("id long, fpr double, names array<string>", ("id", "fpr"), (("rate", "fpr BETWEEN 0 AND 1"),))


def test_bad_documents_are_rows_and_good_ones_are_read(spark, tmp_path):
    texts = {"good": '{"id": 1,\n "fpr": 0.5, "names": ["a"]}', "cut": '{"id": 1, "fp', "list": "[1, 2]", "empty": "", "type": '{"id": "x", "fpr": 0.1}', "missing": '{"id": 3, "fpr": null}', "more": '{"id": 4, "fpr": 1, "z": {}}', "rule": '{"id": 5, "fpr": 1.5}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = documents.document_files(spark, f"file://{tmp_path}", SCHEMA).withColumn("name", F.regexp_extract("file", r"(\w+)\.json$", 1))
    got = sorted((r.name, r.rule, r.field or "") for r in documents.violations(found, ["name"]).collect())
    assert got == [("cut", "malformed", ""), ("list", "malformed", ""), ("missing", "missing", "fpr"), ("more", "unknown", "z"), ("rule", "rate", ""), ("type", "type", "id")]
    assert [(r.id, r.fpr, r.names) for r in found.where("size(violations) = 0").collect()] == [(1, 0.5, ["a"])]


def test_side_cars(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "fpr": 0.2}))
    (tmp_path / "b.json").write_text("")
    (tmp_path / "sub/d.json").write_text(json.dumps({"id": 1}))
    expected = spark.createDataFrame([(x,) for x in ("a.json", "b.json", "c.json")], "path string")
    got = sorted(map(tuple, documents.side_car_audit(spark, f"file://{tmp_path}", expected, SCHEMA).collect()))
    assert got == [("b.json", "missing"), ("c.json", "missing"), ("d.json", "missing:fpr"), ("sub/d.json", "unexpected")]


def test_differences(spark):
    kind = "k string, a double, b double"
    now = spark.createDataFrame([("same", 1.0, None), ("near", 1.0, 2.0), ("off", 1.0, 2.0), ("lost", 1.0, 1.0), (None, 0.0, 0.0), ("null", None, 1.0)], kind)
    stored = spark.createDataFrame([("same", 1.0, float("nan")), ("near", 1.0 + 1e-12, 2.0), ("off", 1.0, 2.1), ("new", 1.0, 1.0), (None, 0.0, 0.0), (None, 0.0, 0.0), ("null", 1.0, 1.0)], kind)
    got = {(r.k, r.problem, r.figure, r.stored, r.computed) for r in documents.differences(stored, now, ["k"], ["a", "b"]).collect()}
    assert got == {("off", "differs", "b", 2.1, 2.0), ("lost", "missing", None, None, None), ("new", "surplus", None, None, None), (None, "surplus", None, None, None), ("null", "differs", "a", 1.0, None)}


def test_scalers_are_versions(spark, tmp_path):
    path = f"file://{tmp_path}/scaler"
    rows = spark.createDataFrame([("c1", [1.0, 2.0]), ("c1", [3.0, 2.0]), ("c2", [0.0, 1.0])], "key string, features array<double>")
    first = state.save_scaler(spark, feature_stats(rows, "key", "features"), path)
    assert {r.key: (r["mean"], r["std"]) for r in state.load_scaler(spark, path, 2).collect()} == {"c1": ([2.0, 2.0], [1.0, 1.0]), "c2": ([0.0, 1.0], [1.0, 1.0])}
    with pytest.raises(ValueError, match="3 finite"):
        state.load_scaler(spark, path, 3)
    torn = tmp_path / "scaler/_aside-1"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    second = state.save_scaler(spark, feature_stats(rows.where("key = 'c2'"), "key", "features"), path)
    assert second != first and state.load_scaler(spark, path, 2).count() == 1
    assert state.save_scaler(spark, feature_stats(rows, "key", "features"), path) == first and state.load_scaler(spark, path, 2).count() == 2
    (tmp_path / "scaler/CURRENT").write_text(second)
    (tmp_path / "scaler/.CURRENT.crc").unlink(missing_ok=True)
    feature_stats(rows, "key", "features").write.mode("overwrite").parquet(f"{path}/{second}")
    with pytest.raises(ValueError, match="digest"):
        state.load_scaler(spark, path, 2)
    with pytest.raises(FileNotFoundError):
        state.load_scaler(spark, f"file://{tmp_path}/none", 2)


def test_one_clients_splits_are_read_from_its_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"0{c}", s, [float(c), 1.0]) for c in range(4) for s in ("train", "cal")], "client_id string, split string, features array<double>")
    path = f"file://{tmp_path}/splits"
    sinks.write_splits(rows, path, 2)
    manifest = sinks.write_split_manifest(spark, path)
    assert manifest["rows"] == 8 and manifest["clients"] == 4 and readers.split_manifest(spark, path) == manifest
    one = readers.splits(spark, path, 2, clients=["01"], splits=["cal"])
    assert [(r.client_id, r.features) for r in one.collect()] == [("01", [1.0, 1.0])]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "client_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    wanted = spark.createDataFrame([("02", 1), ("03", 9)], "client_id string, rank int").where("rank < 5")
    joined = readers.splits(spark, path, 2, clients=wanted)
    assert {r.client_id for r in joined.collect()} == {"02"} and "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        readers.splits(spark, f"file://{tmp_path}/none", 2)
    with pytest.raises(ValueError):
        readers.splits(spark, path, 3)
