from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest

from sparline.llm import topn

SCHEMA = "g string, m string, item string, s double, r double, id bigint, place int, __item string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*x, 9, "clash") for x in rows], SCHEMA).repartition(parts)


def brute(rows, n):
    groups: dict = {}
    for g, m, item, s, r, i in rows:
        if s is None or math.isnan(s) or item is None:
            continue
        key = (-s, math.inf if r is None or math.isnan(r) else -r, i)
        best = groups.setdefault((g, m), {})
        best[item] = min(best.get(item, key), key)
    return sorted(
        (str(g), p, item, k[2]) for g, items in groups.items() for p, (item, k) in enumerate(sorted(items.items(), key=lambda x: (x[1][:2], x[0].encode()))[:n], 1)
    )


def run(df, n, **more):
    got = topn.top_n(df, ["g", "m"], "item", ["s", "r"], "id", n, **more).collect()
    return sorted((str((x["g"], x["m"])), x["place"], x["item"], x["id"]) for x in got)


@pytest.mark.parametrize("broadcast, large, chunk", [(100_000, 1_000, 200_000), (0, 1, 37), (100_000, 1, 100)])
def test_against_brute_force(spark, monkeypatch, broadcast, large, chunk):
    monkeypatch.setattr(topn, "LARGE", large)
    monkeypatch.setattr(topn, "CHUNK", chunk)
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        g = rng.choice(["hot"] * 8 + ["a", "b", None])
        item = rng.choice([None, *(f"item{k}" for k in range(200))])
        s = rng.choice([None, math.nan, 0.0, -0.0, 0.5, 0.5, rng.random()])
        rows.append((g, rng.choice(["x", "y"]), item, s, rng.choice([None, math.nan, 1.0, -1.0]), i))
    rows += [(g, m, item, s, r, i + 10_000) for g, m, item, s, r, i in rows[:200]]
    assert run(frame(spark, rows), 3, broadcast_bounds=broadcast) == brute(rows, 3)


def test_all_ties_go_by_item(spark):
    rows = [("g", "x", f"i{k:04d}", 1.0, 1.0, k) for k in range(400)]
    assert run(frame(spark, rows), 3) == [("('g', 'x')", p, f"i{p - 1:04d}", p - 1) for p in (1, 2, 3)]


def test_small_groups_and_empty_table(spark):
    rows = [("g", "x", "one", 1.0, None, 5), ("g", "x", "one", 1.0, None, 4)]
    assert run(frame(spark, rows), 3) == [("('g', 'x')", 1, "one", 4)]
    assert run(frame(spark, []), 3) == []


@pytest.mark.parametrize("items", [2, 4000])
def test_a_hot_group_sends_few_rows_to_its_task(spark, monkeypatch, items):
    monkeypatch.setattr(topn, "CHUNK", 500)
    monkeypatch.setattr(topn, "LARGE", 100)
    rng = random.Random(3)
    rows = [("hot", "x", f"item{rng.randrange(items)}", float(rng.randrange(50)), 0.0, i) for i in range(9000)]
    rows += [(f"g{i % 300}", "x", f"item{i}", 1.0, None, i) for i in range(1000)]
    df = frame(spark, rows, 4)
    assert run(df, 3) == brute(rows, 3)
    table = pa.Table.from_pylist([{"g": g, "m": m, "__item": item, "__n1": -s, "__n2": -(r or 0.0), "__id": i} for g, m, item, s, r, i in rows])
    left = topn._survivors(table, ["g", "m"], 3)
    assert len(left) == min(items, 3) + 900


def test_only_the_largest_groups_have_bounds(spark):
    bounds = spark.createDataFrame([(f"g{i}", None, 40 + i // 2) for i in range(10)], "g string, __bound string, __size bigint")
    assert [topn._most_rows(bounds, k).count() for k in (0, 1, 2, 5, 10)] == [0, 0, 2, 4, 10]
