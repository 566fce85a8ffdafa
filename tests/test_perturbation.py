from __future__ import annotations

import datetime
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparline.operators import kernels, perturbation as pt, structure


@pytest.fixture()
def record(spark):
    rows = [("c", f, i, h, n, f"{f}{h}{n}" if n < 2 else None, f"t{n}") for i, f in enumerate("pq") for h in range(2) for n in range(3 if f == "p" else 2)]
    lines = spark.createDataFrame(rows, "commit_id string, path string, file_ordinal int, hunk_ordinal int, line_ordinal int, line_id string, raw_text string")
    effects = F.map_from_entries(F.array(*(F.struct(F.lit(r[5]), F.lit(float(i + 1))) for i, r in enumerate(rows) if r[5])))
    return structure.nested_records(lines).withColumns({"message": F.lit("msg"), "effects": effects})


def ids(df, files):
    flat = F.flatten(F.flatten(F.transform(files, lambda f: F.transform(f["hunks"], lambda h: F.transform(h["lines"], lambda x: x["line_id"])))))
    return df.select(flat.alias("i"), F.transform(files, lambda f: f["path"]).alias("p")).first()


def test_removal_cleans_up(record):
    gone = pt.without_lines(F.col("files"), F.array(F.lit("q00"), F.lit("q01"), F.lit("p10")))
    r = ids(record, gone)
    assert r["i"] == ["p00", "p01", None, "p11", None, "q10", "q11"] and r["p"] == ["p", "q"]
    both = pt.without_lines(F.col("files"), F.array(*(F.lit(f"q{h}{n}") for h in range(2) for n in range(2))))
    assert ids(record, both)["p"] == ["p"]


def test_regions_by_unit(record):
    def left(unit, *names):
        m, f = pt.without_region(F.col("message"), F.col("files"), F.lit(unit), F.array(*map(F.lit, names)).cast("array<string>"))
        return record.select(m.alias("m"), F.transform(f, lambda x: x["path"]).alias("p"), F.size(F.flatten(F.transform(f, lambda x: x["hunks"]))).alias("h")).first()

    assert tuple(left("MESSAGE")) == ("", ["p", "q"], 4)
    assert tuple(left("FILE", "p")) == ("msg", ["q"], 2)
    assert tuple(left("HUNK", "p#0", "q#1")) == ("msg", ["p", "q"], 2)
    assert tuple(left("FILE_PATH", "q")) == ("msg", ["p", ""], 4) and left("FILE_PATH")["p"] == ["", ""]
    assert left("LINE", "p00")["h"] == 4
    with pytest.raises(Exception, match="no such unit"):
        left("TOKEN")


def test_blanking_and_ablation(record):
    texts = lambda f: F.flatten(F.flatten(F.transform(f, lambda x: F.transform(x["hunks"], lambda h: F.transform(h["lines"], lambda y: y["raw_text"])))))
    assert set(record.select(texts(pt.blanked(F.col("files")))).first()[0]) == {""}
    some = record.select(texts(pt.blanked(F.col("files"), F.array(F.lit("p00"))))).first()[0]
    assert some[0] == "" and "" not in some[1:]
    m, f, markup = pt.ablated(F.col("message"), F.col("files"), "FILE_PATH")
    assert tuple(record.select(m, F.transform(f, lambda x: x["path"]), markup).first()) == ("msg", ["", ""], False)
    with pytest.raises(ValueError):
        pt.ablated(F.col("message"), F.col("files"), "OTHER")


def test_occlusion_removes_and_scores_again(record):
    score = lambda m, f: pt.additive_score(m, f, F.col("effects"), F.lit(100.0))
    got = {(r["unit"], ",".join(r["ids"])): r["delta"] for r in pt.occlude(record, pt.parts_of(F.col("files")), score, ["commit_id", "effects"]).collect()}
    assert got == {("MESSAGE", ""): 100.0, ("FILE", "p"): 12.0, ("FILE", "q"): 34.0, ("HUNK", "p#0"): 3.0, ("HUNK", "p#1"): 9.0, ("HUNK", "q#0"): 15.0, ("HUNK", "q#1"): 19.0}


def test_sums_of_the_rest_are_what_removal_leaves(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{c}", f"p{f}", f, h, n, None if rng.random() < 0.2 else f"{c}-{f}-{h}-{n}", "t") for c in range(12) for f in range(rng.integers(1, 5)) for h in range(rng.integers(1, 4)) for n in range(rng.integers(1, 5))]
    rows += [("c0", "p0", 0, 7, 0, "0-0-0-0", "t"), ("c13", "q", 0, 0, 0, None, "t")]  # an id in two hunks; a commit of one line without an id
    lines = spark.createDataFrame(rows, "commit_id string, path string, file_ordinal int, hunk_ordinal int, line_ordinal int, line_id string, raw_text string")
    value = {r[5]: round(float(rng.normal()), 3) for r in rows if r[5] and rng.random() < 0.8}
    effects = spark.createDataFrame(list(value.items()), "line_id string, e double")
    messages = spark.createDataFrame([(f"c{c}", "msg" if c % 3 else "") for c in range(12)], "commit_id string, message string")
    every = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in value.items())))
    record = structure.nested_records(lines).join(messages, "commit_id", "left").withColumns({"message": F.coalesce("message", F.lit("")), "effects": every})
    score = lambda m, f: pt.additive_score(m, f, F.col("effects"), F.lit(0.25))
    removed = pt.occlude(record, pt.parts_of(F.col("files")), score, ["commit_id", "effects"]).select("commit_id", "unit", F.array_join("ids", ",").alias("id"), "s_full", "s_without", "delta")
    hunks = lines.join(effects, "line_id", "left").groupBy("commit_id", "path", "hunk_ordinal").agg(F.sum(F.coalesce("e", F.lit(0.0))).alias("effect"))
    summed = pt.occlude_sums(hunks, messages.select("commit_id", F.when(F.col("message") != "", 0.25).otherwise(0.0).alias("effect")))
    got, want = ({tuple(r[:3]): tuple(r[3:]) for r in df.collect()} for df in (summed.select(*removed.columns), removed))
    assert got.keys() == want.keys() and summed.count() == len(got)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_whole_that_is_no_number_keeps_the_others_deltas(spark):
    hunks = spark.createDataFrame([("c", "p", 0, math.nan), ("c", "q", 0, 0.5), ("d", "p", 0, 1e12), ("d", "p", 1, 0.000001)], "commit_id string, path string, hunk_ordinal int, effect double")
    messages = spark.createDataFrame([("c", 0.25), ("d", 0.25)], "commit_id string, effect double")
    got = {(r["commit_id"], r["unit"], r["id"]): r["delta"] for r in pt.occlude_sums(hunks, messages).collect()}
    assert math.isnan(got["c", "HUNK", "p#0"]) and (got["c", "FILE", "q"], got["c", "MESSAGE", ""]) == (0.5, 0.25)
    assert (got["d", "HUNK", "p#1"], got["d", "MESSAGE", ""]) == (0.000001, 0.25)


def test_occlusion_of_a_large_commit(spark, tmp_path):
    """12,000 lines in 300 files: every region's rest is scored without going through all lines again."""
    from sparline.plans.perturbation_queries import CATALOG

    line = "struct<change_type: string, raw_text: string, stable_line_id: string, old_lineno: int, new_lineno: int, occurrence_index: int, ordered_position: int, rq1_status: string>"
    specs = "commit_id string, canonical_path string, file_ordinal int, hunk_ordinal int, old_start int, old_length int, new_start int, new_length int, lines array<" + line + ">, extracted_at timestamp"
    at = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    hunk = lambda f, h, t, lines: (" C ", f"p{f}", f, h, 1, 10, 1, 10, [("added", "x", i, None, n, 0, n, "RQ1_POSITIVE") for n, i in enumerate(lines)], at[t])
    rows = [hunk(f, h, 0, [f"{f}-{h}-{n}" if n else None for n in range(10)]) for f in range(300) for h in range(4)]
    rows += [hunk(0, 0, 1, ["late"]), hunk(0, 9, 0, [None]), hunk(0, 10, 0, [])]  # a hunk's second delivery, one without ids, one without lines
    scored = [("c", m, 13, f"{f}-{h}-{n}", "LINE", float(f + s), 0.5, "RQ1_POSITIVE") for f in range(300) for h in range(4) for n in range(1, 10) for m, s in (("gradient", -1), ("attention_last", 2))]
    meta = "commit_id string, project string, split string, visible_token_count int, is_positive boolean, commit_message string, author_date timestamp, ingested_at timestamp"
    spark.createDataFrame(rows, specs).write.parquet(str(tmp_path / "hunk_specs.parquet"))
    spark.createDataFrame([*scored, ("c", "gradient", 13, "late", "LINE", 1e6, 0.5, "RQ1_POSITIVE")], "commit_id string, method string, model_seed int, region_id string, granularity string, raw_score double, rank_score double, rq1_status string").write.parquet(str(tmp_path / "attribution_rows.parquet"))
    spark.createDataFrame([("c", "p", "train", 1, True, "fix", at[0], at[0])], meta).write.parquet(str(tmp_path / "commit_meta.parquet"))
    over = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    over.start()
    try:
        got = {(r["unit"], r["id"]): r["delta"] for r in CATALOG.queries["l16_occlusion"](spark, str(tmp_path)).collect()}
    finally:
        over.cancel()
    want = {("MESSAGE", ""): 0.25, ("HUNK", "p0#9"): 0.0} | {("FILE", f"p{f}"): 36 * (f + 0.5) for f in range(300)} | {("HUNK", f"p{f}#{h}"): 9 * (f + 0.5) for f in range(300) for h in range(4)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_a_scorer_that_is_not_additive(spark, record):
    longest = lambda m, f: F.size(F.flatten(F.transform(f, lambda x: x["hunks"]))).cast("double") * F.length(m)
    got = {r["unit"]: r["delta"] for r in pt.occlude(record, F.array(pt.region("MESSAGE"), pt.region("FILE", F.lit("p"))), longest).collect()}
    assert got == {"MESSAGE": 12.0, "FILE": 6.0}
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.0])], "i int, e array<double>")
    scored = pt.score_batches(rows, "i", ["e"], lambda b: [(0.0, sum(x)) for x in b.column("e").to_pylist()])
    assert {tuple(r) for r in scored.collect()} == {(1, 0.0, 3.0), (2, 0.0, 0.5)}


def test_paths(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, [9.0, 9.0])], "i int, e array<double>")
    w, pad = [0.5, 0.7], F.array(F.lit(0.1), F.lit(0.2))
    for r in kernels.path_gradient(df, "i", "e", kernels.baseline(F.col("e"), "PAD_EMBEDDING", pad), w, 40).collect():
        e = [1.0, -2.0] if r["i"] == 1 else [9.0, 9.0]
        f = lambda v: 1 / (1 + math.exp(-sum(a * b for a, b in zip(v, w))))
        assert r["attribution"] == pytest.approx(f(e) - f([0.1, 0.2]), abs=1e-6) and sum(r["attributions"]) == pytest.approx(r["attribution"])
    few = kernels.path_gradient_with_retry(df, "i", "e", kernels.baseline(F.col("e"), "ZERO_EMBEDDING"), w, 1, 2, 1e-4, "RIEMANN").collect()
    assert {r["i"]: (r["steps"], r["state"]) for r in few}[2] == (2, "NONCONVERGED")
    with pytest.raises(Exception, match="another width"):
        df.select(kernels.baseline(F.col("e"), "EXPLICIT", explicit=F.array(F.lit(1.0)))).collect()
    with pytest.raises(ValueError):
        kernels.baseline(F.col("e"), "EXPLICIT")


def test_attention_rows(spark):
    rng = np.random.default_rng(1)
    q, k = rng.normal(size=(2, 4)), rng.normal(size=(2, 5, 4))
    df = spark.createDataFrame([(q.tolist(), k.tolist())], "q array<array<double>>, k array<array<array<double>>>")
    z = np.einsum("hd,hkd->hk", q, k) / 2
    e = np.exp(z - z.max(1, keepdims=True))
    assert df.select(kernels.attention_row(F.col("q"), F.col("k"))).first()[0] == pytest.approx((e / e.sum(1, keepdims=True)).mean(0).tolist())
    at = kernels.query_index("EXPLICIT_INDEX", F.size("q"), explicit=1)
    assert df.select(at).first()[0] == 1
    with pytest.raises(Exception, match="outside"):
        df.select(kernels.query_index("EXPLICIT_INDEX", F.size("q"), explicit=7)).collect()
