from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparline.functions import lines as lf
from sparline.operators import audit, checks, classify, cohorts, inference, linkage, numbering, runs, structure


def test_running_sums_and_ranks_without_a_global_window(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(np.round(rng.normal(), 2)), int(rng.integers(1, 4))) for g in "ab" for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, c int").groupBy("g", "v").agg(F.sum("c").alias("c"))
    for r in numbering.running_before(df, ["g"], "v", "c", "before").collect():
        assert r["before"] == sum(c for g, v, c in rows if g == r["g"] and v < r["v"])
    one = spark.createDataFrame([(3.0, 5)], "v double, c int")
    assert [r["before"] for r in numbering.running_before(one, [], "v", "c", "before").collect()] == [0]
    at = numbering.values_at(df, ["g"], "v", "c", {"first": F.lit(0), "last": F.col("__total") - 1}).collect()
    assert {r["g"]: (r["first"], r["last"]) for r in at} == {g: (min(v for h, v, _ in rows if h == g), max(v for h, v, _ in rows if h == g)) for g in "ab"}


@pytest.mark.parametrize("n", [1, 2, 5, 8, 31])
def test_medians_of_halves(spark, n):
    x = np.sort(np.random.default_rng(n).integers(0, 9, n)).astype(float)
    r = inference.half_medians_summary(spark.createDataFrame([("g", float(v)) for v in x], "g string, v double"), ["g"], "v").first()
    assert r["n"] == n and r["mean"] == pytest.approx(x.mean()) and r["median"] == np.median(x) and r["sd"] == pytest.approx(x.std())
    assert r["iqr"] == (np.median(x[n - n // 2 :]) - np.median(x[: n // 2]) if n > 1 else None)


def test_cliffs_delta_is_the_pairwise_one(spark):
    rng = np.random.default_rng(3)
    rows = [("g", int(rng.integers(2)), float(rng.integers(6))) for _ in range(120)]
    a, b = [v for _, y, v in rows if y], [v for _, y, v in rows if not y]
    r = inference.cliffs_delta(spark.createDataFrame(rows, "g string, y int, v double"), "y", "v", ["g"]).first()
    assert r["delta"] == pytest.approx(sum((x > z) - (x < z) for x in a for z in b) / len(a) / len(b))


def values(spark, n=40):
    rng = np.random.default_rng(6)
    rows = [(f"c{i}", m, s, float(rng.random() + (0.3 if m == "a" else 0))) for i in range(n) for m in "ab" for s in (1, 2)]
    return spark.createDataFrame(rows, "commit_id string, method string, seed int, value double"), rows


def test_contrast_with_interval_and_known_p(spark):
    df, rows = values(spark)
    v = {(c, m, s): x for c, m, s, x in rows}
    d = np.array([np.mean([v[f"c{i}", "a", s] - v[f"c{i}", "b", s] for s in (1, 2)]) for i in range(40)])
    r = inference.contrast(df, ("a", "b"), "F", "PRIMARY", 2000, "S").first()
    assert r["n_total"] == r["n_included"] == 40 and r["median"] == pytest.approx(np.median(d), abs=1e-8)
    boot = np.random.default_rng(1).choice(d, (20_000, 40)).mean(1)
    low, high = np.percentile(boot, [2.5, 97.5])
    assert abs(r["low"] - low) < 0.05 * (high - low) and abs(r["high"] - high) < 0.05 * (high - low)
    # Frozen values: T+ = 10 of 1..8 without zeros or ties, whose normal approximation is z = -1.12022..., p = 0.26261...
    diffs = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, -5.0, -6.0, -7.0, -8.0)], "diff double")
    s = inference.signed_rank(diffs).first()
    assert (s["r_plus"], s["statistic"]) == (10.0, 10.0) and s["z"] == pytest.approx(-8 / np.sqrt(51)) and s["p_value"] == pytest.approx(0.2626181, abs=1e-6)


def test_one_sample_report_and_families(spark):
    out = inference.one_sample_report(spark.createDataFrame([(0.0,), (0.0,)], "diff double")).first()
    assert (out["state"], out["p_value"], out["rank_biserial"], out["median"]) == ("ALL_ZERO", 1.0, 0.0, 0.0)
    p = spark.createDataFrame([("a", "F", "PRIMARY", 0.01), ("b", "F", "PRIMARY", 0.04), ("c", "F", "SECONDARY", 0.02), ("d", "G", "PRIMARY", 0.02)], "name string, family string, role string, p_value double")
    assert {r["name"]: round(r["adjusted_p"], 6) for r in inference.family_holm(p, "F").collect()} == {"a": 0.02, "b": 0.04}


def test_draws_reach_their_target(spark):
    rows = [("c", f"r{i}", i % 5 + 1, 20) for i in range(30)] + [("d", "only", 3, 99)]
    df = spark.createDataFrame(rows, "commit_id string, region_id string, tokens int, target int")
    got = {r["commit_id"]: r for r in cohorts.token_matched_draws(df, ["commit_id"], "target", 256).collect()}
    assert got["c"]["total_tokens"] == 20 and len(set(got["c"]["region_ids"])) == len(got["c"]["region_ids"])
    assert got["d"]["total_tokens"] == 3  # all there is
    size = {r: t for c, r, t, _ in rows}
    drawn = {r["commit_id"]: r for r in cohorts.length_matched_draws(df.withColumn("k", F.lit(6)), ["commit_id"], "k", "target").collect()}
    assert len(drawn["c"]["region_ids"]) == 6 and drawn["c"]["total_tokens"] == sum(size[x] for x in drawn["c"]["region_ids"]) and abs(drawn["c"]["total_tokens"] - 20) <= 5
    assert drawn["d"]["region_ids"] == ["only"]


def test_residual_gaps_leave_claimed_lines_and_settled_rows(spark):
    side = lambda n: spark.createDataFrame([("c", i) for i in range(n)], "commit_id string, place int")
    anchors = spark.createDataFrame([("c", 2, 2)], "commit_id string, left_place int, right_place int")
    residual = spark.createDataFrame([("c", 0), ("c", 3)], "commit_id string, left_place int")
    claimed = spark.createDataFrame([("c", 3)], "commit_id string, right_place int")
    got = {(r["left_place"], r["right_place"]) for r in linkage.residual_gaps(side(5), side(5), anchors, residual, claimed, ["commit_id"]).collect()}
    assert got == {(0, 0)}


def test_merged_sources_and_scopes(spark):
    rows = [("k1", "x", 1, 1), ("k1", "y", 2, 1), ("k2", "x", 1, 2), ("k3", None, 1, 3), ("k4", None, 1, 4)]
    df = spark.createDataFrame(rows, "k string, claim string, p int, o int")
    assert {r["k"]: (r["claim"], r["state"]) for r in linkage.merge_sources(df, "k", "claim", "p", "o").collect()} == {
        "k1": ("x", "RESOLVED"), "k2": (None, "AMBIGUOUS"), "k3": (None, "UNRESOLVED"), "k4": (None, "UNRESOLVED"),
    }
    names = "u string, path string, text string, id string"
    lines = spark.createDataFrame([("c", "p", "t", "1"), ("c", "p", "t", "2"), ("c", "q", "t", "3")], names)
    asked = spark.createDataFrame([(1, "c", "p", "t"), (2, "c", "none", "t"), (3, "c", "q", "t"), (4, "d", "p", "t")], "r int, u string, path string, text string")
    used = lines.where("id = '3'")
    assert {r["r"]: r["n_free"] for r in linkage.scoped_candidates(asked, lines, used, ["u"], "path", "text", "id").collect()} == {1: 2, 2: 2, 3: 0, 4: 0}


def test_tokens_of_segments_are_those_of_the_text(spark):
    parts = spark.createDataFrame(
        [("c", (-1, -1, -1), "message", "Fix  it\nnow", None), ("c", (0, 0, -1), "hunk", "1 -1,2 +1", None), ("c", (0, 0, 0), "added", "\tint x=f(1);", "L0"), ("c", (0, 0, 1), "deleted", "", "L1"), ("c", (0, 0, 2), "added", "y", "L2")],
        "commit_id string, place struct<file:int,hunk:int,line:int>, kind string, payload string, line_id string",
    )
    regions = structure.spans(parts)
    s = structure.token_segments(regions)
    toks = structure.tokens(structure.rendered(parts), "commit_id", "text")
    want = [(r["token_index"], r["token"], r["start"], r["end"]) for r in toks.orderBy("token_index").collect()]
    own = structure.segment_tokens(s).orderBy("token_index").collect()
    assert [(r["token_index"], r["token"], r["start"], r["end"]) for r in own] == want
    joined = structure.token_owners(toks, regions.where("line_id IS NOT NULL")).orderBy("token_index").collect()
    assert [(r["owner"], r["mapping"]) for r in own] == [(r["owner"], r["mapping"]) for r in joined]
    for budget in range(1, len(want) + 3):
        assert structure.truncate_segments(s, budget, 0).first() == structure.truncate(toks, regions, budget, 0).first()


def test_small_functions(spark):
    df = spark.createDataFrame([("added", "a", "deleted", "b", "added", "c")], "k string, a string, l string, b string, m string, c string")
    assert df.select(lf.added_texts(F.array("k", "a", "l", "b", "m", "c"))).first()[0] == ["a", "c"]
    assert spark.range(1).select(lf.added_texts(F.array().cast("array<string>"))).first()[0] == []
    prompt, at = structure.chat_prompt("S", F.col("x"))
    rows = spark.createDataFrame([("text",), ("",), ("S",)], "x string")
    assert [r[0] for r in rows.select(at).collect()] == [24 - 2, None, None]
    batches = runs.ordered_batches(spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").repartition(7), "k", 8)
    assert {r["k"]: r["batch"] for r in batches.collect()} == {f"k{i:03d}": i // 8 for i in range(50)}
    bundle = classify.metrics_bundle(spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.6)], "y int, score double"), [0.5, 0.7]).collect()
    assert {r["threshold"]: (r["tp"], r["fn"], r["roc_auc"]) for r in bundle} == {0.5: (2, 0, 1.0), 0.7: (1, 1, 1.0)}


def test_checks_on_empty_tables(spark):
    rows = spark.createDataFrame([], "k string, path string, hunk_ordinal int, v int")
    assert checks.known_keys(rows, "k", rows, "k").count() == 0 and checks.unit_profile(rows, "k", F.col("v") == 1).count() == 0
    assert checks.count_agreement(rows, rows, "k").first()["n"] == 0
    assert audit.intersection(rows, rows, "k", 5).first()["examples"] is None
    a = spark.createDataFrame([("u", "x", 1), ("u", "y", 2)], "u string, k string, i int")
    b = spark.createDataFrame([("u", "y", 1), ("u", "x", 2), ("w", "z", 1)], "u string, k string, i int")
    assert {r["u"]: r["verdict"] for r in audit.order_verdict(a, b, ["u"], "k", "i").collect()} == {"u": "SAME_KEYS", "w": "ONE_SIDED"}
