from __future__ import annotations

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparline.sources import datasets, records


def test_label_maps_keep_the_last_row(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(r) for r in [{"c": "a", "i": 1, "id": "x", "o": 1}, {"c": "a", "i": 1, "id": "y", "o": 2}, {"c": "b", "i": 1, "id": "", "o": 1}, {"c": "d", "i": 1, "o": 1}]) + "\n\n")
    got = datasets.label_map(spark, str(tmp_path / "m.jsonl"), "c string, i int, id string, o int", ["c", "i"], "id", "o").collect()
    assert [(r["c"], r["id"]) for r in got] == [("a", "y")]


def test_predictions_go_round(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1, 0.7, 13), ("b", 0, 0.2, 42), ("c", 1, 0.5, 42)], "commit_id string, y int, score double, seed int")
    out = records.predictions(scores, 0.5).join(scores.select("commit_id", "seed"), "commit_id")
    datasets.write_predictions(out, str(tmp_path / "p"))
    got = {(r["commit_id"], r["label"], r["p"], r["seed"], r["predicted"]) for r in datasets.read_predictions(spark, str(tmp_path / "p"), 0.5).collect()}
    assert got == {("a", 1, 0.7, 13, 1), ("b", 0, 0.2, 42, 0), ("c", 1, 0.5, 42, 1)}


def test_summaries_are_one_file(spark, tmp_path):
    records.write_csv(spark.range(5).withColumn("x", F.lit("clash")), str(tmp_path / "s"), ["id"])
    files = list((tmp_path / "s").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["id", "0", "1", "2", "3", "4"]


def test_nested_labels_count_down_the_bag(spark, tmp_path):
    data = {"p": {"c1": {"added": {"f": ["x", "y", "x", "x"]}, "added_buggy_level": {"f": {"added_buggy": ["x", "x"]}}}, "c2": {"added": {"g": ["z"]}}}}
    (tmp_path / "l.json").write_text(json.dumps(data))
    got = sorted((r["commit_id"], r["ordinal"], r["text"], r["label"]) for r in datasets.nested_labels(spark, str(tmp_path / "l.json")).collect())
    assert got == [("c1", 0, "x", 1.0), ("c1", 1, "y", 0.0), ("c1", 2, "x", 1.0), ("c1", 3, "x", 0.0), ("c2", 0, "z", 0.0)]


def test_building_checks_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 2), ("c", "train", None)], "commit_id string, split string, n int")
    unique = ("unique", F.count("commit_id") == F.count_distinct("commit_id"))
    first = datasets.build(df, str(tmp_path / "one"), [unique])
    assert first == datasets.build(df.repartition(3), str(tmp_path / "two"), [unique]) and first["train"]["n"] == 2
    assert first != datasets.build(df.withColumn("n", F.lit(1)), str(tmp_path / "three"), [])
    with pytest.raises(ValueError, match="complete"):
        datasets.build(df, str(tmp_path / "four"), [unique, ("complete", F.count("n") == F.count(F.lit(1)))])
    assert not (tmp_path / "four").exists()


def test_cached_tables_are_checked(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(4))[1]
    path = str(tmp_path / "c")
    assert datasets.load_or_build(spark, path, make, 4).count() == 4 and datasets.load_or_build(spark, path, make, 4).count() == 4 and len(made) == 1
    with pytest.raises(ValueError, match="4 rows"):
        datasets.load_or_build(spark, path, make, 5)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.txt", "hello\n")
        z.writestr('d/t"wo.TXT', "xx")
        z.writestr("d/three.py", "y" * 10)
    rows = datasets.extract(tmp_path / "z.zip", tmp_path / "out", ["d/one.txt"])
    assert rows[0]["sha256"] == hashlib.sha256(b"hello\n").hexdigest() and rows[0]["blob_sha1"] == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert datasets.extract(tmp_path / "z.zip", tmp_path / "out", ["d/one.txt"]) == rows
    (tmp_path / "out/d/one.txt").write_text("other")
    with pytest.raises(FileExistsError):
        datasets.extract(tmp_path / "z.zip", tmp_path / "out", ["d/one.txt"])
    for bad in ("/x", "C:\\x", "../x", "a/../../x", ""):
        with pytest.raises(ValueError):
            datasets.safe_destination(tmp_path, bad)
    assert datasets.manifest_lines([{"a": "x,y", "b": 1}]) == ["a,b", "x;y,1"]
    assert datasets.verify(tmp_path / "z.zip", size=1)["ok"] is False and datasets.verify(tmp_path / "out/d/one.txt", size=5)["ok"]
    members = records.archive_members(spark, str(tmp_path / "z.zip"))
    assert {r["name"]: r["line"] for r in datasets.inventory_lines(members).collect()}["d/one.txt"].endswith(",363a3020")
    sums, largest, by_extension = datasets.inventory(members, 1)
    assert sums.first()["n_files"] == 3 and largest.first()["name"] == "d/three.py"
    assert {r["extension"]: r["n"] for r in by_extension.collect()} == {".txt": 2, ".py": 1}


def test_units_and_curves_of_a_grid(spark):
    grid = spark.createDataFrame([("a", 1), ("b", 1)], "commit_id string, seed int")
    units = spark.createDataFrame([("a", 1, "DONE")], "commit_id string, seed int, status string")
    curves = spark.createDataFrame([("b", 1, 0.5)], "commit_id string, seed int, aopc double")
    assert {tuple(r) for r in datasets.with_units(grid, units, curves, ["commit_id", "seed"]).collect()} == {("a", 1, "DONE", None), ("b", 1, None, 0.5)}
    assert datasets.open_test_records(spark.createDataFrame([("TEST",), ("train",)], "split string")).count() == 1
