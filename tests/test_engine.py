from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparline.operators import engine, protocol

SCHEMA = "commit_id string, seed int, method string, granularity string, status string"


def grid(spark, n):
    return spark.createDataFrame([(f"c{i}", 13, "gradient", "LINE", "clash") for i in range(n)], SCHEMA)


def executor(calls, bad=()):
    def run(todo):
        calls.append(sorted(r["commit_id"] for r in todo.collect()))
        failed = F.col("commit_id").isin(*bad) if bad else F.lit(False)
        status = F.when(failed, "OOM").otherwise("DONE")
        return todo.select(*engine.UNIT, "digest", status.alias("status"), F.when(failed, "ENGINE_ERROR").otherwise("OK").alias("code"), F.array(F.lit(0.5)).alias("payload"))

    return run


def test_a_run_is_resumed_where_it_stopped(spark, tmp_path):
    run = engine.Run(spark, str(tmp_path / "r"), {"model": "a"}, str(tmp_path / "cache")).open()
    calls = []
    assert run.resume(grid(spark, 4), executor(calls, ["c1", "c2"])) == {"planned": 4, "cached": 0, "executed": 4}
    assert run.resume(grid(spark, 5), executor(calls)) == {"planned": 3, "cached": 0, "executed": 3}
    assert run.resume(grid(spark, 5), executor(calls)) == {"planned": 0, "cached": 0, "executed": 0}
    assert calls == [["c0", "c1", "c2", "c3"], ["c1", "c2", "c4"], []]
    assert {(r["commit_id"], r["status"], r["attempt"]) for r in run.ledger(grid(spark, 5)).collect()} == {("c0", "DONE", 1), ("c1", "DONE", 2), ("c2", "DONE", 2), ("c3", "DONE", 1), ("c4", "DONE", 1)}
    assert run.results(grid(spark, 5)).count() == 5


def test_identity_and_cache(spark, tmp_path):
    calls = []
    first = engine.Run(spark, str(tmp_path / "a"), {"model": "a", "seed": 1}, str(tmp_path / "cache")).open()
    first.resume(grid(spark, 3), executor(calls))
    with pytest.raises(RuntimeError, match="model"):
        engine.Run(spark, str(tmp_path / "a"), {"model": "b", "seed": 1}, str(tmp_path / "cache")).open()
    engine.Run(spark, str(tmp_path / "a"), {"seed": 1, "model": "a"}, str(tmp_path / "cache")).open()
    same = engine.Run(spark, str(tmp_path / "b"), {"seed": 1, "model": "a"}, str(tmp_path / "cache")).open()
    assert same.resume(grid(spark, 3), executor(calls)) == {"planned": 3, "cached": 3, "executed": 0}
    other = engine.Run(spark, str(tmp_path / "c"), {"seed": 2, "model": "a"}, str(tmp_path / "cache")).open()
    assert other.resume(grid(spark, 3), executor(calls))["executed"] == 3
    spoiled = spark.createDataFrame([("d", [1.0], "wrong")], "digest string, payload array<double>, checksum string")
    spoiled.write.mode("append").parquet(str(tmp_path / "cache"))
    assert engine.Run(spark, str(tmp_path / "e"), {"seed": 1, "model": "a"}, str(tmp_path / "cache")).open().resume(grid(spark, 3), executor(calls))["cached"] == 3


def test_states_and_empty_grids(spark, tmp_path):
    pairs = spark.createDataFrame([(None, "PENDING"), (None, "DONE"), ("RUNNING", "DONE"), ("DONE", "RUNNING"), ("odd", "DONE")], "a string, b string")
    assert [r[0] for r in pairs.select(engine.may_follow(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]
    run = engine.Run(spark, str(tmp_path / "r"), {}, str(tmp_path / "cache")).open()
    assert run.resume(grid(spark, 0), executor([]))["planned"] == 0
    with pytest.raises(Exception, match="no state to end in"):
        run.resume(grid(spark, 1), lambda t: t.select(*engine.UNIT, "digest", F.lit("RUNNING").alias("status"), F.lit("").alias("code"), F.array(F.lit(0.5)).alias("payload")))


def test_canonical_configurations():
    a = {"b": [1, 2.00000000000001], "a": {"y": {3, 1}, "x": None}}
    b = {"a": {"x": None, "y": {1, 3}}, "b": (1, 2.0)}
    assert protocol.config_hash(a) == protocol.config_hash(b) != protocol.config_hash({"a": 1})
    assert protocol.canonical({"k": 0.1 + 0.2}) == {"k": 0.3}
    with pytest.raises(ValueError):
        protocol.canonical(float("nan"))
    rules = {"a.b": lambda v: v > 1, "a.c": lambda v: True, "d": lambda v: v == "x", "e": lambda v: v < 1}
    assert protocol.faults({"a": {"b": 2}, "d": "y", "e": "text"}, rules) == ["a.c", "d", "e"]


def test_fingerprints_and_missing_fields(spark):
    a = spark.createDataFrame([(1, None)], "x int, y string")
    assert protocol.compare_schemas(a, a.limit(0)) == "IDENTICAL_SCHEMA" and protocol.compare_schemas(a, a.select("y", "x")) == "SCHEMA_DRIFT"
    assert {tuple(r) for r in protocol.missing_fields(a, ["x", "y", "z"]).collect()} == {("x", 1, 0), ("y", 1, 1), ("z", 1, 1)}
