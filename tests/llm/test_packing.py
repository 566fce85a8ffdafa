from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sparline.llm.packing import pack, plan_containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_places_every_item_once_within_capacity(lengths, capacity):
    counts = Counter(lengths)
    patterns = plan_containers(dict(counts), capacity)
    placed: Counter = Counter()
    for p in patterns:
        assert p.times > 0 and 0 < sum(x * m for x, m in p.lengths.items()) <= capacity
        for x, m in p.lengths.items():
            placed[x] += m * p.times
    assert placed == counts
    total = sum(lengths)
    assert sum(p.times for p in patterns) <= 1.7 * total / capacity + 1  # no worse than best fit


def test_exact_complements_leave_no_room():
    patterns = plan_containers({60: 10, 40: 10, 50: 4, 30: 5, 45: 5, 25: 5}, 100)
    assert all(sum(x * m for x, m in p.lengths.items()) == 100 for p in patterns)


def test_large_histogram_is_planned_tightly():
    counts = {x: 1 + (x * 7919) % 97 for x in range(1, 2049)}
    patterns = plan_containers(dict(counts), 2048)
    used = sum(x * k for x, k in counts.items())
    n = sum(p.times for p in patterns)
    assert used / (n * 2048) > 0.995


def test_documents(spark):
    texts = {1: "a " * 25, 2: None, 3: "", 4: "  \t\n", 5: "x" * 100_000, 6: "b," * 5, 7: "b," * 5, 8: "w " * 10, 9: "w " * 20}
    rows = [(i, t, 99, 7) for i, t in texts.items()] + [(9, texts[9], 1, 7), (None, "z z z", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, container_id int")
    got = pack(df, "doc_id", "text", 10).collect()
    per = Counter()
    for r in got:
        per[r["container_id"]] += r["n_tokens"]
    assert max(per.values()) <= 10
    size = {1: 25, 2: 0, 3: 0, 4: 0, 5: 1, 6: 10, 7: 10, 8: 10, 9: 40, None: 3}
    for i, n in size.items():
        mine = [r for r in got if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in mine) == n
        assert all(r["n_pieces"] == max(1, -(-(n // (2 if i == 9 else 1)) // 10)) for r in mine)
        assert n > 10 or len(mine) == 1
    ids = {r["container_id"] for r in got}
    assert ids == set(range(len(ids))) and len(ids) == 10  # 99 tokens
    assert [r["container_id"] for r in got if r["n_tokens"] == 0] == [0, 0, 0]


def test_ranks_are_exact_over_buckets(spark, monkeypatch):
    from sparline.llm import packing

    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    df = spark.createDataFrame([(i, "w " * (1 + i % 3)) for i in range(200)], "doc_id bigint, text string")
    got = pack(df, "doc_id", "text", 6).collect()
    per = Counter()
    for r in got:
        per[r["container_id"]] += r["n_tokens"]
    assert len(got) == 200 and max(per.values()) <= 6
    assert len(per) == -(-sum(1 + i % 3 for i in range(200)) // 6)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", 10).count() == 0
