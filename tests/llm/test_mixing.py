from __future__ import annotations

from collections import defaultdict

import pytest

from sparline.llm.mixing import build_tree, leaf_budgets, mix, spread


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("d", "en", "a"): (0.4, 10), ("d", "en", "b"): (0.2, 1000), ("d", "de", "a"): (0.2, 1000), ("e", "en", "c"): (0.2, 1000)}
    root = build_tree(leaves)
    spread(root, 100)
    b = leaf_budgets(root, 3)
    assert b[("d", "en", "a")] == 10
    assert b[("d", "en", "b")] == pytest.approx(50)  # takes all of its sibling's shortage
    assert b[("d", "de", "a")] == pytest.approx(20) and b[("e", "en", "c")] == pytest.approx(20)


def test_what_siblings_can_not_take_goes_up():
    leaves = {("d", "en", "a"): (0.5, 10), ("d", "en", "b"): (0.2, 20), ("d", "de", "a"): (0.1, 1000), ("e", "en", "c"): (0.2, 1000)}
    root = build_tree(leaves)
    spread(root, 100)
    b = leaf_budgets(root, 3)
    assert b[("d", "en", "a")] == 10 and b[("d", "en", "b")] == 20
    assert b[("d", "de", "a")] == pytest.approx(50) and b[("e", "en", "c")] == pytest.approx(20)
    assert sum(b.values()) == pytest.approx(100)


def corpus(spark):
    rows = []
    for i in range(400):
        rows.append((i, "w " * (1 + i % 7), "Big-One ", "en", 5))
    for i in range(400, 440):
        rows.append((i, "w " * 5, "small", "de-XX", 5))
    rows += [(900, None, "small", None, 5), (901, "w w", None, "en", 5), (902, "w w", "unknown", "en", 5), (903, "w " * 4, "small", "??", 5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, epoch int")


def test_mix_keeps_caps_and_reports_shares(spark):
    targets = spark.createDataFrame([("big_one", 0.5, 2), ("Small", 0.4, 3), ("none", 0.1, 1)], "source_name string, target_share double, max_repeats int")
    m = mix(corpus(spark), targets, {"big_one": "x", "small": "x"})
    report = {r["source_name"]: r for r in m.report.collect()}
    big = sum(1 + i % 7 for i in range(400))
    assert report["big_one"]["tokens_available"] == big and report["small"]["tokens_available"] == 204
    assert [report[s]["can_reach"] for s in ("big_one", "small", "none")] == [True, False, False]
    assert report["small"]["tokens_used"] == 3 * 204 and report["none"]["tokens_used"] == 0
    assert report["big_one"]["tokens_used"] == pytest.approx(big + 204 - 612, abs=7)
    uses = defaultdict(int)
    for r in m.rows.collect():
        uses[r["doc_id"]] += 1
        assert r["source_name"] in ("big_one", "small")
    assert max(uses.values()) <= 3 and all(uses[i] == 3 for i in [*range(400, 440), 900, 903])
    assert sum(report[s]["reached_share"] for s in report) == pytest.approx(1)


def test_prefix_does_not_depend_on_buckets(spark, monkeypatch):
    from sparline.llm import mixing

    targets = spark.createDataFrame([("big_one", 0.3, 1), ("small", 0.7, 9)], "source_name string, target_share double, max_repeats int")
    rows = lambda: sorted((r["doc_id"], r["epoch"]) for r in mix(corpus(spark), targets, {}).rows.collect())
    a = rows()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert rows() == a


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    m = mix(corpus(spark).limit(0), targets, {})
    assert m.rows.count() == 0
    assert [(r["tokens_used"], r["reached_share"], r["can_reach"]) for r in m.report.collect()] == [(0, 0.0, True)]
    m = mix(corpus(spark), targets.limit(0), {})
    assert m.rows.count() == 0 and m.report.count() == 0


def test_nulls_and_repeats_among_the_targets(spark):
    rows = [("big_one", 0.5, 1), ("BIG-ONE", 0.2, None), ("small", None, 3), ("other", 0.5, None), (None, 0.1, 1), (" ", 0.1, 1)]
    targets = spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int")
    report = {r["source_name"]: r for r in mix(corpus(spark), targets, {}).report.collect()}
    assert {s: (r["target_share"], r["max_repeats"]) for s, r in report.items()} == {"big_one": (0.5, 1), "small": (0.0, 3), "other": (0.5, 0)}
