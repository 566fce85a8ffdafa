from __future__ import annotations

import random

import numpy as np
import pytest

from sparline.operators.skew import heavy_keys, key_profile

SCHEMA = "k string, v string, s int, __v string, n_rows int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, s, "x", 1) for k, v, s in rows], SCHEMA)


def test_profile_against_numpy_with_a_hot_key_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        k = rng.choice(["hot"] * 6 + ["b", "c", None])
        s = None if rng.random() < 0.1 else rng.choice([0, 1, 5, 70_000, -3, 2**31 - 1, -(2**31), rng.randrange(100)])
        rows.append((k, None if rng.random() < 0.1 else str(rng.randrange(50)), s))
    got = {r["k"]: r for r in key_profile(frame(spark, rows), ["k"], "v", "s", (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        mine = [x for x in rows if x[0] == k]
        sizes = [x[2] for x in mine if x[2] is not None]
        assert r["n_rows"] == len(mine) and r["n_distinct"] == len({x[1] for x in mine} - {None})
        assert r["n_sized"] == len(sizes) and r["size_total"] == sum(sizes)
        counts = {v: sizes.count(v) for v in sizes}
        assert r["size_mode"] == min(counts, key=lambda v: (-counts[v], v))
        assert np.allclose(r["size_percentiles"], np.percentile(sizes, [0, 25, 50, 99, 100]))


def test_wide_values(spark):
    values = [0, 1, 2**62, -(2**62), 2**40 + 1, 2**40 + 2]
    df = spark.createDataFrame([("a", "v", v) for v in values], "k string, v string, s bigint")
    r = key_profile(df, ["k"], "v", "s", (0.2, 0.4, 0.6), bits=64).first()
    assert np.allclose(r["size_percentiles"], np.percentile(np.array(values, dtype=float), [20, 40, 60]))


def test_key_without_sizes_and_empty_table(spark):
    r = key_profile(frame(spark, [("a", "x", None), ("a", "x", None)]), ["k"], "v", "s").first()
    assert (r["n_rows"], r["n_distinct"], r["n_sized"], r["size_total"], r["size_percentiles"]) == (2, 1, 0, None, None)
    assert key_profile(frame(spark, []), ["k"], "v", "s").count() == 0


@pytest.mark.parametrize("share, expected", [(0.5, {"a"}), (0.25, {"a", None}), (0.1, {"a", "b", None})])
def test_heavy_keys_count_every_row(spark, share, expected):
    df = spark.createDataFrame([("t", "a", "1")] * 5 + [("t", None, "1")] * 3 + [("t", "b", "2")] * 2, "t string, k string, v string")
    profile = key_profile(df, ["t", "k"], "v")
    assert {r["k"] for r in heavy_keys(profile, ["t"], share).collect()} == expected
