from __future__ import annotations

import hashlib
import math
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparline.functions import ids, lines as lf, scores as sf
from sparline.functions.text import project_key, source_key, split_key, token_count
from sparline.operators import audit, classify, cohorts, diffs, enrichment, faithfulness, inference, kernels, linkage, polarity, ranking, runs, structure
from sparline.sources import records

LINE = "commit_id string, region_id string, score double, status string, position int"


def lines(spark, rows, commit="c"):
    return spark.createDataFrame([(commit, *r) for r in rows], LINE)


def test_localization_of_five_lines(spark):
    rows = [(f"r{i}", s, "POSITIVE" if i == 0 else "NEGATIVE", i) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5])]
    m = ranking.localization(lines(spark, [*rows, ("x", 9.0, "NOT_IN_RQ1_UNIVERSE", 9)]), ["commit_id"]).first()
    assert (m["n"], m["top1"], m["ifa"], m["recall_at_effort"], m["effort_at_recall"]) == (5, 1, 0, 1.0, 0.2)


def test_ties_are_ranked_by_position_and_no_positive_is_a_state(spark):
    rows = [(f"r{9 - i}", 1.0, "POSITIVE" if i in (3, 7) else "NEGATIVE", i) for i in range(10)]
    m = ranking.localization(lines(spark, rows), ["commit_id"]).first()
    assert (m["ifa"], m["recall_at_effort"], m["top5"]) == (3, 0.0, 1)
    none = ranking.localization(lines(spark, [("a", 1.0, "NEGATIVE", 0)]), ["commit_id"]).first()
    assert none["state"] == "NO_POSITIVE" and none["ifa"] is None
    with pytest.raises(Exception, match="unexpected status"):
        ranking.localization(lines(spark, [("a", 1.0, "UNKNOWN", 0)]), ["commit_id"]).collect()


def test_metrics_ignore_row_order_and_lines_outside(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", float(rng.integers(0, 4)), rng.choice(["POSITIVE", "NEGATIVE"]), i) for i in range(60)]
    base = ranking.localization(lines(spark, rows), ["commit_id"]).first()
    mixed = [rows[i] for i in rng.permutation(60)] + [(f"o{i}", 99.0, "NOT_IN_RQ1_UNIVERSE", i) for i in range(7)]
    assert ranking.localization(lines(spark, mixed).repartition(7), ["commit_id"]).first() == base


def test_pairs_need_two_common_seeds(spark):
    v = [("a", "x", s, float(i + 1)) for i, s in enumerate((13, 42, 73))] + [("a", "y", s, float(i)) for i, s in enumerate((13, 42, 73))]
    v += [("b", "x", 13, 1.0), ("b", "y", 13, 0.0), ("b", "y", 42, None)]
    got = {r["commit_id"]: (r["n_common"], r["diff"]) for r in inference.paired_differences(spark.createDataFrame(v, "commit_id string, method string, seed int, value double"), "x", "y").collect()}
    assert got == {"a": (3, 1.0), "b": (1, None)}


@pytest.mark.parametrize("diffs_, p", [([0.0, 0.5], 0.31731050786291415), ([0.046875, 0.046875, 0.0625], 0.10247043485974937), ([0.0, 0.0], 1.0)])
def test_signed_rank_against_frozen_values(spark, diffs_, p):
    r = inference.signed_rank(spark.createDataFrame([(d,) for d in diffs_], "diff double")).first()
    assert r["p_value"] == pytest.approx(p, rel=1e-12)
    assert r["state"] == ("ALL_ZERO" if not any(diffs_) else "OK")


def test_signed_rank_of_nothing(spark):
    r = inference.signed_rank(spark.createDataFrame([(None,)], "diff double")).first()
    assert (r["n"], r["state"], r["p_value"], r["statistic"]) == (0, "EMPTY", None, None)


def test_rank_biserial_drops_zeros(spark):
    r = inference.rank_biserial(spark.createDataFrame([(d,) for d in (1.0, 0.0, -0.5, 2.0)], "diff double")).first()
    assert r["rank_biserial"] == pytest.approx((2 + 3 - 1) / 6)
    assert inference.rank_biserial(spark.createDataFrame([(0.0,)], "diff double")).first()["rank_biserial"] == 0.0


def test_holm_is_monotone_within_its_family(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.04), ("g", "a", 0.5), ("f", "d", None)], "fam string, name string, p_value double")
    got = {(r["fam"], r["name"]): r["adjusted_p"] for r in inference.holm(df, ["fam"]).collect()}
    assert got == pytest.approx({("f", "a"): 0.03, ("f", "b"): 0.04, ("f", "c"): 0.04, ("g", "a"): 0.5})


def test_correlations_are_null_where_undefined(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 2.0), ("m", 1.0, 1.0), ("m", 2.0, 3.0), ("m", 2.0, 5.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in inference.spearman(df, ["g"], "x", "y").collect()}
    assert got["k"] is None and got["m"] == pytest.approx(math.sqrt(3) / 2)


def test_budget_keeps_the_region_that_crosses_it(spark):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate((3, 5, 2, 10), 1)], "commit_id string, rank int, tokens int")
    r = faithfulness.budget_realised(faithfulness.budget_prefix(df, ["commit_id"], [0.3]), ["commit_id"]).first()
    assert (r["budget"], r["n_regions"], r["realised"], r["overshoot"]) == (6, 2, 8, 2)


def test_polarity_epsilon_is_relative(spark):
    df = spark.createDataFrame([("a", "x", 1000.0), ("a", "y", 1e-5), ("a", "z", -1.0), ("b", "x", 0.0)], "u string, region_id string, score double")
    got = {(r["u"], r["region_id"]): r["polarity"] for r in polarity.classify(df, ["u"]).collect()}
    assert got == {("a", "x"): "POSITIVE", ("a", "y"): "NEAR_ZERO", ("a", "z"): "NEGATIVE", ("b", "x"): "NEAR_ZERO"}


def test_enrichment_of_three_tokens(spark):
    df = spark.createDataFrame([("c", 1.0, "COMMIT_MESSAGE"), ("c", -2.0, "ADDED_CODE"), ("c", 3.0, "ADDED_CODE")], "commit_id string, score double, category string")
    got = {r["category"]: r["enrichment"] for r in enrichment.category_mass(df, ["commit_id"]).collect()}
    assert len(got) == 9 and got["COMMIT_MESSAGE"] == pytest.approx((1 / 6) / (1 / 3)) and got["FILE_PATH"] is None


def test_reduction_keeps_the_first_of_equal_magnitudes(spark):
    df = spark.createDataFrame([("l", 2.0, 1), ("l", -2.0, 0), (None, 9.0, 2)], "line string, score double, position int")
    assert [tuple(r) for r in enrichment.reduce_scores(df, ["line"], "MAX_ABS_WITH_SIGN").collect()] == [("l", -2.0)]


def test_classifier_metrics(spark):
    y, s = [0, 0, 1, 1, 0, 1], [0.1, 0.4, 0.35, 0.8, 0.4, 0.4]
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    m = classify.ranking_metrics(df).first()
    wins = sum((a > b) + 0.5 * (a == b) for a, i in zip(s, y) if i for b, j in zip(s, y) if not j)
    assert m["roc_auc"] == pytest.approx(wins / 9) and m["brier"] == pytest.approx(np.mean((np.array(s) - y) ** 2))
    assert classify.ranking_metrics(df.where("y = 1")).first()["roc_auc"] is None
    b = classify.best_f1_threshold(df).first()
    assert b["threshold"] == 0.35
    assert classify.best_f1_threshold(spark.createDataFrame([(0, 0.3)], "y int, score double")).first()["threshold"] == 0.0
    votes = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", 0), ("c", 1)], "k string, v int")
    assert {(r["k"], r["majority"]) for r in classify.majority(votes, ["k"], "v").collect()} == {("a", 1), ("b", 0)}


def test_matching_is_the_greedy_one(spark):
    rng = np.random.default_rng(4)
    m = lambda n, p: [(f"{p}{i:03d}", f"p{rng.integers(3)}", int(rng.integers(20))) for i in range(n)]
    pos, pool = m(25, "a"), m(60, "b")
    used, want = set(), {}
    for c, p, t in sorted(pos):
        free = [x for x in pool if x[0] not in used]
        best = min([x for x in free if x[1] == p] or free, key=lambda x: (abs(x[2] - t), x[0]))
        used.add(best[0])
        want[c] = best[0]
    schema = "commit_id string, project string, tokens int"
    got = cohorts.matched_negatives(spark.createDataFrame(pos, schema), spark.createDataFrame(pool, schema), 25).collect()
    assert {r["commit_id"]: r["matched_id"] for r in got} == want


def test_diff_lines(spark):
    text = "Fix it\n\n--- a/x.java\n+++ b/x.java\n@@ -3,3 +3,4 @@ f\n keep\n-old\n+new\n+more\n \n- not part of it\n--- a/y.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no diff")], "id int, t string")
    got = [tuple(r)[2:] for r in diffs.parse_diff(df, "id", "t").orderBy("ordinal").collect()]
    assert got == [
        ("x.java", 0, "context", 3, 3, "keep"), ("x.java", 0, "deleted", 4, None, "old"), ("x.java", 0, "added", None, 4, "new"), ("x.java", 0, "added", None, 5, "more"),
        ("x.java", 0, "context", 5, 6, ""), ("y.txt", 1, "deleted", 1, None, "gone"),
    ]
    assert diffs.code_lines(diffs.parse_diff(df, "id", "t"), ["id"]).count() == 3


def test_gaps_pair_up_only_if_equal(spark):
    side = lambda n: spark.createDataFrame([("c", i) for i in range(n)], "commit_id string, place int")
    anchors = spark.createDataFrame([("c", 2, 2), ("c", 5, 4)], "commit_id string, left_place int, right_place int")
    got = {(r["left_place"], r["right_place"]) for r in linkage.gap_pairs(side(7), side(6), anchors, ["commit_id"]).collect()}
    assert got == {(0, 0), (1, 1), (6, 5)}


def test_null_safe_lookup_takes_the_last(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "z")], "i int, k string")
    right = spark.createDataFrame([(None, "n1", 1), (None, "n2", 2), ("a", "a1", 1)], "k string, v string, o int")
    assert {r["i"]: r["v"] for r in linkage.null_safe_lookup(left, right, ["k"], ["v"], ["o"]).collect()} == {1: "n2", 2: "a1", 3: None}


def test_token_owners_and_truncation(spark):
    texts = spark.createDataFrame([("c", "ab cd,ef  gh")], "commit_id string, text string")
    spans = spark.createDataFrame([("c", 0, 4, "A"), ("c", 4, 8, "B"), ("c", 10, 12, "C")], "commit_id string, char_start int, char_end int, line_id string")
    toks = structure.tokens(texts, "commit_id", "text")
    assert [(r["token"], r["start"], r["end"]) for r in toks.orderBy("token_index").collect()] == [("ab", 0, 2), ("cd", 3, 5), (",", 5, 6), ("ef", 6, 8), ("gh", 10, 12)]
    owned = [(r["mapping"], r["owner"]) for r in structure.token_owners(toks, spans).orderBy("token_index").collect()]
    assert owned == [("MAPPED", "A"), ("ERROR", None), ("MAPPED", "B"), ("MAPPED", "B"), ("MAPPED", "C")]
    cut = structure.truncate(toks, spans, 4, 1).first()
    assert (cut["truncated"], cut["cut_char"], cut["n_kept"]) == (True, 4, 1)


def test_seeds_and_digests(spark):
    r = spark.range(1).select(
        ids.seed(F.lit("RANDOM"), F.lit("x")).alias("s"), ids.blob_sha1(F.lit("hello\n").cast("binary")).alias("b"), F.size(ids.pseudo_scores(ids.digest(F.lit("k")))).alias("n"),
        ids.stable_line_id(*(F.lit(x) for x in ("c", "f", "added")), F.lit(None), F.lit(3), F.lit(0), F.lit(1)).alias("i"),
    ).first()
    assert 0 <= r["s"] < ids.SEED_MODULUS and r["b"] == "ce013625030ba8dba906f756967f9e9ca394464a" and r["n"] == 5
    assert r["i"] == "c|f|added|oldNA|new3|occ0|ord1"


def test_text_forms(spark):
    df = spark.createDataFrame([('  if (_foo == " a b ") { x[1] = \'q\'; }\t',)], "x string")
    x = F.col("x")
    r = df.select(lf.normalize_line(x), lf.mask_literals(x), lf.collapse(x), F.size(lf.text_variants(x))).first()
    assert r[0] == 'if ( foo = = "a b" ) { x [ 1 ] = \' q \' ; }' and r[1] == "if _foo == <STR> x <NUM> = <STR>" and r[2].startswith("if (_foo")
    p = df.select(lf.path_class(F.lit("./a/b"), F.lit("a/b")), lf.path_class(F.lit("m/a/b"), F.lit("a/b")), lf.path_class(F.lit("xa/b"), F.lit("a/b"))).first()
    assert tuple(p) == ("NORMALIZED", "SUFFIX", None)


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \t\r\n", 0), ("a_1 b.c", 4), ("é€😀", 3), ("x" * 100_000, 1), (" ", 1)])
def test_token_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(token_count(F.col("t"))).first()[0] == n


def test_key_forms(spark):
    df = spark.createDataFrame([(" A_b\t", " Bug tracker", "VAL "), ("?", "", "x"), (None, None, None)], "p string, s string, t string")
    got = [tuple(r) for r in df.select(project_key(F.col("p")), source_key(F.col("s")), split_key(F.col("t"))).collect()]
    assert got == [("a-b", "bug_tracker", "valid"), (None, None, None), (None, None, None)]


def test_probabilities_do_not_overflow(spark):
    r = spark.range(1).select(sf.probability(F.lit(0.0), F.lit(2000.0)), sf.probability(F.lit(2000.0), F.lit(0.0)), sf.odds_identity_holds(F.lit(0.3), F.lit(1.2))).first()
    assert tuple(r) == (1.0, 0.0, True)


def test_integrated_gradient_is_complete(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, [0.0, 0.0])], "i int, e array<double>")
    for r in kernels.integrated_gradient(df, "i", "e", [0.5, 0.7], 20).collect():
        assert r["error"] < 1e-9


def test_ledger_and_grid(spark):
    led = spark.createDataFrame([("a", "DONE", "OK", 1), ("a", "FAILED", "X", 0), ("b", "FAILED", "X", 5)], "commit_id string, status string, code string, at int")
    last = runs.latest(led, ["commit_id"], ["at"])
    assert {r["commit_id"]: r["status"] for r in last.collect()} == {"a": "DONE", "b": "FAILED"}
    grid = spark.createDataFrame([("a",), ("b",)], "commit_id string")
    assert [r[0] for r in runs.pending(grid, last, ["commit_id"]).collect()] == ["b"]
    assert runs.job_grid(grid, ["x", "y"], [1, 2, 3]).count() == 12


def test_set_equivalence(spark):
    rows = [("e", "added", "x", "A"), ("e", "added", "x", "B"), ("m", "added", "x", "A"), ("m", "deleted", "y", "B"), ("d", "added", "x", "A"), ("d", "deleted", "y", "A"), ("d", "deleted", "y", "B")]
    df = spark.createDataFrame(rows, "u string, c string, t string, s string")
    assert {r["u"]: r["equivalence"] for r in audit.set_equivalence(df, ["u"], "t", "s", "c").collect()} == {"e": "EXACT", "m": "MISMATCH", "d": "DELETED"}


def test_sources(spark, tmp_path):
    assert records.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in records.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    df = spark.createDataFrame([("a", "test"), ("b", "valid")], "id string, split string")
    with pytest.raises(PermissionError):
        records.split_records(df, "test")
    records.write_splits(df, str(tmp_path / "out"))
    assert records.split_records(spark.read.parquet(str(tmp_path / "out")), "test", test_gate=True).count() == 1
    with pytest.raises(Exception, match="unexpected split"):
        records.refuse_other_splits(df, "valid").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/B.txt", "hello")
        z.writestr("a/b.txt", "hello")
        z.writestr("../up", "x")
    members = records.archive_members(spark, str(tmp_path / "z.zip"))
    faults = {r["name"]: r["faults"] for r in records.path_faults(members).collect()}
    assert faults == {"a/B.txt": ["case_collision"], "a/b.txt": ["case_collision"], "../up": ["traversal"]}
    (tmp_path / "p.pkl").write_bytes(pickle.dumps({"a": [1, 2]}))
    assert not records.pickle_audit(spark, str(tmp_path / "p.pkl")).where("risky").count()
    zipped = records.aligned(spark.createDataFrame([([1, 2], ["x", "y"])], "a array<int>, b array<string>"), ["a", "b"])
    assert [tuple(r) for r in zipped.collect()] == [(1, "x"), (2, "y")]


def test_every_query_has_its_own_name_and_oracles_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_bootstrap_of_every_group_is_numpys(spark):
    rows = [("a", f"c{i % 7}", float(i)) for i in range(30)] + [("b", f"c{i}", float(i * i)) for i in range(12)] + [("b", None, 5.0), ("b", "c1", None)]
    df = spark.createDataFrame(rows, "method string, c string, v double")
    runs_ = [{r["method"]: r for r in inference.grouped_bootstrap(df.repartition(k), ["method"], "v", "c", 10_000, "S", together=t).collect()} for k, t in ((1, 500), (3, 5000))]
    assert runs_[0] == runs_[1] and set(runs_[0]) == {"a", "b"}
    rng = np.random.default_rng(5)
    for m, r in runs_[0].items():
        per = {}
        for x, c, v in rows:
            if x == m and c is not None and v is not None:
                per.setdefault(c, []).append(v)
        s, n = np.array([sum(v) for v in per.values()]), np.array([len(v) for v in per.values()])
        at = rng.integers(0, len(s), (200_000, len(s)))
        low, high = np.percentile(s[at].sum(1) / n[at].sum(1), [2.5, 97.5])
        assert r["repeats"] == 10_000 and r["n_clusters"] == len(s) and r["estimate"] == pytest.approx(s.sum() / n.sum())
        # Ends of 10,000 draws are within a few hundredths of the width; those of 50 are not.
        assert abs(r["low"] - low) < 0.04 * (high - low) and abs(r["high"] - high) < 0.04 * (high - low)


def test_whole_bootstraps_draw_what_the_reference_draws():
    from sparline.plans import inference_queries as q

    assert q.REPEATS == 10_000 and {"i06_bootstrap_commits_whole", "i09_bootstrap_projects_whole"} <= set(q.CATALOG.queries)


@pytest.fixture(scope="session")
def cohort_tables(tmp_path_factory, spark):
    """commit_meta alone: 500 positives and 700 negatives of the test split, in six projects."""
    import datetime as dt

    to = tmp_path_factory.mktemp("cohort")
    at = dt.datetime(2026, 1, 1)
    rows = [(f"{'a' if i < 500 else 'b'}{i:04d}", f"p{i % 6}", "test", (i * 37) % 400 + 1, i < 500, "m", at, at) for i in range(1200)]
    schema = "commit_id string, project string, split string, visible_token_count int, is_positive boolean, commit_message string, author_date timestamp, ingested_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(to / "commit_meta.parquet"))
    return str(to), rows


def test_matched_negatives_query_takes_475_positives(spark, cohort_tables):
    from sparline.plans.inference_queries import c18

    directory, rows = cohort_tables
    used, want = set(), {}
    pool = [r for r in rows if not r[4]]
    for r in [r for r in rows if r[4]][:475]:
        free = [x for x in pool if x[0] not in used]
        best = min([x for x in free if x[1] == r[1]] or free, key=lambda x: (abs(x[3] - r[3]), x[0]))
        used.add(best[0])
        want[r[0]] = best[0]
    assert {r["commit_id"]: r["matched_id"] for r in c18(spark, directory).collect()} == want


@pytest.mark.parametrize("n, projects", [(60, 40), (20, 90), (150, 30), (1000, 9)])
def test_covering_sample_swaps_as_the_reference_does(spark, n, projects):
    rng = np.random.default_rng(n)
    rows = [(f"c{i:04d}", bool(rng.random() < 0.2), f"p{min(int(rng.exponential(projects / 6)), projects):02d}") for i in range(600)]
    h = lambda r: (hashlib.sha256(f"43|{r[0]}".encode()).hexdigest(), r[0])
    pos, neg = sorted((r for r in rows if r[1]), key=h), sorted((r for r in rows if not r[1]), key=h)
    n_pos = max(1, min(round(n * len(pos) / len(rows)), len(pos), n - 1))
    out = pos[:n_pos] + neg[: n - n_pos] if n < len(rows) else list(rows)
    pool, before = sorted(set(rows) - set(out)), {r[2] for r in out}
    for p in sorted({r[2] for r in rows} - before):
        row = next(r for r in pool if r[2] == p)
        for i, r in enumerate(out):
            if r[1] == row[1] and sum(x[2] == r[2] for x in out) > 1:
                out[i] = row
                break
    df = spark.createDataFrame([*rows, ("x", None, "p99")], "commit_id string, is_positive boolean, project string")
    got = [tuple(r) for r in cohorts.covering_sample(df, "is_positive", "project", n, "commit_id", "43").collect()]
    assert sorted(got) == sorted(out) and len(got) == min(n, 600)
    assert n > 600 or {r[2] for r in got} > before


def test_stage_b_takes_2048_of_the_train_split(spark, tmp_path):
    from sparline.plans.inference_queries import CATALOG

    rows = spark.range(5000).selectExpr("concat('c', id) AS commit_id", "concat('p', least(id % 977, 300)) AS project", "if(id % 3 = 0, 'test', 'train') AS split", "5 AS visible_token_count",
        "id % 11 = 0 AS is_positive", "'m' AS commit_message", "timestamp'2026-01-01' AS author_date", "timestamp'2026-01-01' AS ingested_at")
    rows.write.parquet(str(tmp_path / "commit_meta.parquet"))
    got = CATALOG.queries["j06_stage_b_sample"](spark, str(tmp_path)).collect()
    assert len(got) == 2048 and all(int(r["commit_id"][1:]) % 3 for r in got)
    assert {r["project"] for r in got} == {f"p{i}" for i in range(301)}


def test_permuted_baseline_averages_a_hundred_permutations(spark, monkeypatch):
    from sparline.plans import ranking_queries as q

    label = lambda c, i: "POSITIVE" if c != "none" and i % 5 == 0 else "NEGATIVE" if i % 7 else "NOT_IN_RQ1_UNIVERSE"
    rows = [(c, f"r{i:03d}", 0.0, label(c, i), i) for c, n in [*((f"c{k}", 40) for k in range(60)), ("one", 1), ("none", 30)] for i in range(n)]
    df = spark.createDataFrame(rows, LINE)
    monkeypatch.setattr(q, "_labelled", lambda spark, directory: df)
    got = {r["commit_id"]: r for r in q.CATALOG.queries["j08_random_baseline_whole"](spark, "").collect()}
    again = {r["commit_id"]: r for r in ranking.permuted_baseline(df.repartition(7), "commit_id", 100).collect()}
    assert set(got) == {*(f"c{k}" for k in range(60)), "one"} and {r["n_repeats"] for r in got.values()} == {100}
    assert all(got[c]["recall_at_effort"] == pytest.approx(again[c]["recall_at_effort"], abs=1e-8) for c in got)
    assert got["one"]["recall_at_effort"] == 1.0
    inside = [x for x in rows if x[0] == "c0" and x[3] != "NOT_IN_RQ1_UNIVERSE"]
    n, p = len(inside), sum(x[3] == "POSITIVE" for x in inside)
    k = n // 5
    # A permutation finds a hypergeometric number of positives.
    mean, sd = k / n, math.sqrt(k * p / n * (1 - p / n) * (n - k) / (n - 1)) / p
    means = np.array([got[f"c{i}"]["recall_at_effort"] for i in range(60)])
    assert abs(means.mean() - mean) < 4 * sd / math.sqrt(6000) and 0.6 * sd / 10 < means.std() < 1.5 * sd / 10


def test_token_matched_query_makes_256_trials(spark, monkeypatch):
    from sparline.plans import inference_queries as q

    # Nine lines of 1000 + 2^i tokens have no exact prefix, so every trial is needed.
    rows = [(f"c{c}", f"r{i}", 1000 + 2**i + c) for c in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, "commit_id string, line_id string, tokens int")
    monkeypatch.setattr(q, "lines", lambda spark, directory: df)
    got = sorted(tuple(r) for r in q.j04(spark, "").collect())
    target = df.groupBy("commit_id").agg(F.ceil(F.sum("tokens") * F.lit(0.2)).alias("target"))
    regions = df.select("commit_id", F.col("line_id").alias("region_id"), "tokens").join(target, "commit_id")
    draws = {t: sorted(tuple(r) for r in cohorts.token_matched_draws(regions, ["commit_id"], "target", t).collect()) for t in (8, 64, 256)}
    assert got == draws[256] and len(got) == 12
    goal = {r["commit_id"]: r["target"] for r in target.collect()}
    miss = {t: sum(abs(total - goal[c]) for c, _, total in d) for t, d in draws.items()}
    assert miss[256] <= miss[64] <= miss[8]
    assert draws[64] != draws[256]
