from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from sparline.operators.orphans import merged_intervals, orphan_counts, orphans

T0 = datetime(2024, 1, 1)
HOW = {"key": "k", "at": "t", "payload": ["row", "t"], "parent_key": "id", "valid_from": "a", "valid_to": "b"}
PARENT = "id string, a timestamp, b timestamp, k string"
REF = "row bigint, k string, t timestamp, id string"


def run(spark, refs, parents, **more):
    r = spark.createDataFrame([(*x, "clash") for x in refs], REF)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PARENT)
    return sorted(x["row"] for x in orphans(r, p, **HOW, **more).collect())


def brute(refs, parents):
    def held(k, t):
        return t is not None and any(i == k and a is not None and a <= t and (b is None or b > t) for i, a, b in parents)

    return sorted(row for row, k, t in refs if k is None or not held(k, t))


@pytest.mark.parametrize("hot_rows, slice_", [(200_000, 10_000), (20, 10_000), (5, 2)])
def test_against_brute_force_with_hot_keys(spark, monkeypatch, hot_rows, slice_):
    if slice_ == 2:  # hot keys joined by shuffle
        monkeypatch.setattr("sparline.operators.orphans.BROADCAST_KEYS", 0)
    rng = random.Random(5)
    keys = ["hot", "", " ", "NA", "éü", "x\x00", "x", *(f"k{i}" for i in range(30)), "long" * 200, "long" * 200 + "!"]
    when = lambda: T0 + timedelta(hours=rng.randrange(50))
    parents = [(rng.choice([*keys[:20], None]), rng.choice([when(), None, when(), when()]), rng.choice([None, when()])) for _ in range(120)]
    parents += parents[:10]
    refs = [(i, rng.choice(["hot"] * 20 + [*keys, None]), rng.choice([when(), when(), when(), None])) for i in range(600)]
    assert run(spark, refs, parents, hot_rows=hot_rows, slice_=slice_) == brute(refs, parents)


def test_parents_of_a_hot_key_are_merged_before_they_are_copied(spark):
    many = [("hot", T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 5)) for i in range(300)]
    many += [("hot", T0 + timedelta(days=9, minutes=2 * i), T0 + timedelta(days=9, minutes=2 * i + 1)) for i in range(40)]
    rows = spark.createDataFrame(many, "k string, a timestamp, b timestamp").selectExpr("k AS __key", "unix_micros(a) AS __at", "unix_micros(b) AS __end")
    assert merged_intervals(rows).count() == 41
    refs = [(i, "hot", T0 + timedelta(minutes=i * 7 % 20_000, seconds=30)) for i in range(400)]
    assert run(spark, refs, many, hot_rows=30, slice_=7) == brute(refs, many)


def test_empty_sides_and_repeats(spark):
    refs = [(1, "a", T0), (1, "a", T0), (2, None, T0)]
    assert run(spark, refs, []) == [1, 1, 2]
    assert run(spark, [], [("a", T0, None)]) == []
    assert run(spark, refs, [("a", T0, T0 + timedelta(1))]) == [2]
    assert run(spark, refs, [("a", T0, T0)]) == [1, 1, 2]


def test_counts_per_month(spark):
    refs = spark.createDataFrame([("x", 1, T0), ("x", 2, T0 + timedelta(40)), ("x", 3, None)], "tab string, row int, t timestamp")
    got = {(r["month"], r["n_orphans"], r["n_references"]) for r in orphan_counts(refs.where("row <> 2"), refs, "tab", "t").collect()}
    assert got == {("2024-01", 1, 1), ("2024-02", 0, 1), (None, 1, 1)}
