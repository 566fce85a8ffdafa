from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparline.llm import overlap


def brute(sets, train, held, t):
    out = set()
    for a in train:
        for b in held:
            x, y = sets.get(a, set()), sets.get(b, set())
            if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((a, b))
    return out


def run(spark, sets, train, held, t):
    members = [(r, r in train, r in held, "clash") for r in sorted(train | held)]
    m = spark.createDataFrame(members, "record string, is_train boolean, is_eval boolean, class_id string")
    rows = [(r, " ".join(part), 1) for r, s in sets.items() for part in (sorted(s)[::2], sorted(s)[1::2], sorted(s)[:2])]
    words = spark.createDataFrame(rows, "record string, t string, part int").select("record", overlap.word_hashes(F.col("t")).alias("terms"), "part")
    records, _, pairs = overlap.split_overlap(m, words, t)
    a = records.where("is_train").select(F.col("class_id").alias("train_class"), F.col("record").alias("a"))
    b = records.where("is_eval").select(F.col("class_id").alias("eval_class"), F.col("record").alias("b"))
    got = [(r["a"], r["b"]) for r in pairs.join(a, "train_class").join(b, "eval_class").collect() if r["a"] != r["b"]]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("jaccard, small", [(0.7, False), (0.8, True), (0.5, True)])
def test_no_pair_is_missing_or_wrong(spark, monkeypatch, jaccard, small):
    if small:  # every list salted, every record in parts, nothing broadcast
        monkeypatch.setattr(overlap, "LIST_ROWS", 2)
        monkeypatch.setattr(overlap, "RECORD_ROWS", 2)
        monkeypatch.setattr(overlap, "BROADCAST_KEYS", 0)
    rng = random.Random(11)
    base = [{f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))} for _ in range(12)]
    sets = {}
    for i in range(150):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s ^= {f"w{rng.randrange(60)}"}
        sets[f"r{i:03d}"] = s
    sets["empty"] = set()
    ids = list(sets)
    train, held = set(rng.sample(ids, 90)), set(rng.sample(ids, 60))
    assert run(spark, sets, train, held, jaccard) == brute(sets, train, held, jaccard)


def test_copies_form_one_class_and_empty_tables_give_nothing(spark):
    sets = {f"c{i}": {"a", "b", "c"} for i in range(6)}
    assert len(run(spark, sets, {"c0", "c1", "c2"}, {"c2", "c3", "c4", "c5"}, 0.7)) == 11
    assert run(spark, {"x": {"a"}}, {"x"}, set(), 0.7) == set()
    m = spark.createDataFrame([], "record string, is_train boolean, is_eval boolean")
    w = spark.createDataFrame([], "record string, terms array<bigint>")
    assert [d.count() for d in overlap.split_overlap(m, w, 0.7)] == [0, 0, 0]


def test_words_of_null_are_null(spark):
    df = spark.createDataFrame([("Foo_bar FOO_BAR é x9",), (None,), ("",), ("!!",)], "t string")
    assert [r[0] for r in df.select(F.size(overlap.word_hashes(F.col("t")))).collect()] == [2, None, 0, 0]
