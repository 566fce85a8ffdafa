"""Paired statistics, classifier evaluation and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions.scores import standardized_difference
from sparline.operators import classify, cohorts, inference
from sparline.plans.base import COMMITS, LINES, SCORES, UNIT, commits, lines, scores
from sparline.plans.catalog import Catalog
from sparline.plans.ranking_queries import METRICS, U, metrics, rounded

CATALOG = Catalog()
PAIR = ("attention_last", "grad_x_input")
PAIRS = [PAIR, ("attention_last", "occlusion_line"), ("grad_x_input", "occlusion_line")]

VALUES = f"{METRICS}, v AS (SELECT {U}, recall_at_effort AS value FROM metrics WHERE state = 'OK')"
_DIFFS = f"""{VALUES}, ps AS (SELECT commit_id, seed, max(CASE WHEN method = '{PAIR[0]}' THEN value END) AS a, max(CASE WHEN method = '{PAIR[1]}' THEN value END) AS b
        FROM v WHERE method IN ('{PAIR[0]}', '{PAIR[1]}') GROUP BY 1, 2),
    d AS (SELECT commit_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_common, round(avg(a - b), 9) AS d0 FROM ps GROUP BY 1),
    diffs AS (SELECT commit_id, n_common, CASE WHEN n_common >= 2 THEN d0 END AS diff FROM d)"""


def values(spark: SparkSession, directory: str) -> DataFrame:
    return metrics(spark, directory).where("state = 'OK'").select(*UNIT, F.col("recall_at_effort").alias("value"))


def diffs(spark: SparkSession, directory: str) -> DataFrame:
    return inference.paired_differences(values(spark, directory), *PAIR).withColumn("diff", F.round("diff", 9))


@CATALOG.query("c14_paired_differences", f"WITH {_DIFFS} SELECT commit_id, n_common, diff FROM diffs")
def c14(spark: SparkSession, directory: str) -> DataFrame:
    return diffs(spark, directory).select("commit_id", "n_common", "diff")


@CATALOG.query(
    "d11_two_level_mean",
    f"""WITH {VALUES}, c AS (SELECT method, commit_id, avg(value) AS value FROM v GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT method, round(avg(value), 9) AS mean, count(*) AS n_commits FROM c GROUP BY 1""",
)
def d11(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.two_level_mean(values(spark, directory), ["method"]), "mean")


@CATALOG.query(
    "d17_seed_summary",
    f"""WITH {VALUES} SELECT commit_id, method, count(*) AS n, round(avg(value), 9) AS mean,
    CASE WHEN count(*) = 1 THEN 0.0 ELSE round(stddev_samp(value), 9) END AS sd FROM v GROUP BY 1, 2""",
)
def d17(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.seed_summary(values(spark, directory), ["commit_id", "method"]), "mean", "sd")


_SIGNED_RANK = f"""{_DIFFS}, k AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(diff)) AS t
        FROM diffs WHERE diff IS NOT NULL),
    s AS (SELECT count(*)::DOUBLE AS n, count_if(diff = 0)::DOUBLE AS z, coalesce(sum(r) FILTER (diff > 0), 0) AS rp, coalesce(sum(r) FILTER (diff < 0), 0) AS rm,
          coalesce(sum((t * t * t - t) / (2 * t)) FILTER (diff <> 0), 0) AS ties FROM k),
    x AS (SELECT *, n * (n + 1) / 4 - z * (z + 1) / 4 AS mean, (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties) / 24 AS var FROM s)"""


@CATALOG.query(
    "i01_signed_rank",
    f"""WITH {_SIGNED_RANK} SELECT n::BIGINT AS n, z::BIGINT AS n_zero, rp AS r_plus, rm AS r_minus, least(rp, rm) AS statistic,
    round((least(rp, rm) - mean) / sqrt(var), 9) AS z, 'OK' AS state FROM x""",
)
def i01(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.signed_rank(diffs(spark, directory)).drop("p_value"), "z")


@CATALOG.query(
    "i03_rank_biserial",
    f"""WITH {_DIFFS}, k AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS r FROM diffs WHERE diff <> 0)
    SELECT round((sum(r) FILTER (diff > 0) - sum(r) FILTER (diff < 0)) / sum(r), 9) AS rank_biserial FROM k""",
)
def i03(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.rank_biserial(diffs(spark, directory)), "rank_biserial")


@CATALOG.query(
    "d19_difference_summary",
    f"""WITH {_DIFFS} SELECT count(diff) AS n, round(avg(diff), 9) AS mean, round(quantile_cont(diff, 0.5), 9) AS median,
    round(quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25), 9) AS iqr FROM diffs""",
)
def d19(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.difference_summary(diffs(spark, directory)), "mean", "median", "iqr")


@CATALOG.query(
    "e17_holm",
    f"""WITH {VALUES}, p AS (SELECT method AS name, seed, round(avg(value), 9) AS p_value FROM v GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY p_value, name) AS i, count(*) OVER (PARTITION BY seed) AS m FROM p)
    SELECT name, seed, p_value, round(max(least(1.0, (m - i + 1) * p_value)) OVER (PARTITION BY seed ORDER BY i), 9) AS adjusted_p FROM k""",
)
def e17(spark: SparkSession, directory: str) -> DataFrame:
    p = values(spark, directory).groupBy(F.col("method").alias("name"), "seed").agg(F.round(F.avg("value"), 9).alias("p_value"))
    return rounded(inference.holm(p, ["seed"]), "adjusted_p")


@CATALOG.query("i16_pairwise_report")
def i16(spark: SparkSession, directory: str) -> DataFrame:
    """Test, effect size, summary, direction and Holm's p for three pairs of methods."""
    return inference.pairwise_report(values(spark, directory), PAIRS)


def _ranks(by: str, over: str, name: str) -> str:
    return f"rank() OVER (PARTITION BY {over} ORDER BY {by}) + (count(*) OVER (PARTITION BY {over}, {by}) - 1) / 2 AS {name}"


_CORR = "round(CASE WHEN count(*) >= {n} AND min(rx) < max(rx) AND min(ry) < max(ry) THEN (avg(rx * ry) - avg(rx) * avg(ry)) / sqrt((avg(rx * rx) - avg(rx) ** 2) * (avg(ry * ry) - avg(ry) ** 2)) END, 7) AS rho"


@CATALOG.query(
    "c16_seed_stability",
    f"""WITH {SCORES}, met AS (SELECT a.commit_id, a.method, a.seed AS seed_a, b.seed AS seed_b, a.score AS x, b.score AS y
        FROM scores a JOIN scores b USING (commit_id, method, region_id) WHERE a.seed < b.seed),
    k AS (SELECT *, {_ranks("x", "commit_id, method, seed_a, seed_b", "rx")}, {_ranks("y", "commit_id, method, seed_a, seed_b", "ry")} FROM met)
    SELECT commit_id, method, seed_a, seed_b, count(*) AS n, {_CORR.format(n=2)} FROM k GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
)
def c16(spark: SparkSession, directory: str) -> DataFrame:
    out = inference.seed_pair_stability(scores(spark, directory), ["commit_id", "method"])
    return out.withColumn("rho", F.round("rho", 7))


_LENGTHS = f"{LINES}, {SCORES}, sl AS (SELECT s.*, abs(s.score) AS x, l.tokens AS y FROM scores s JOIN lines l ON l.line_id = s.region_id)"


def with_tokens(spark: SparkSession, directory: str) -> DataFrame:
    sized = lines(spark, directory).select(F.col("line_id").alias("region_id"), "tokens")
    return scores(spark, directory).join(sized, "region_id").withColumn("magnitude", F.abs("score"))


@CATALOG.query(
    "i10_length_spearman",
    f"""WITH {_LENGTHS}, k AS (SELECT *, {_ranks("x", U, "rx")}, {_ranks("y", U, "ry")} FROM sl)
    SELECT {U}, count(*) AS n, {_CORR.format(n=2)} FROM k GROUP BY ALL""",
)
def i10(spark: SparkSession, directory: str) -> DataFrame:
    return inference.spearman(with_tokens(spark, directory), UNIT, "magnitude", "tokens").withColumn("rho", F.round("rho", 7))


@CATALOG.query(
    "d38_rho_summary",
    f"""WITH {_LENGTHS}, k AS (SELECT *, {_ranks("x", U, "rx")}, {_ranks("y", U, "ry")} FROM sl), r AS (SELECT {U}, {_CORR.format(n=2)} FROM k GROUP BY ALL)
    SELECT method, count(rho) AS n, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.75) - quantile_cont(rho, 0.25), 6) AS iqr, round(avg((rho > 0.5)::INT::DOUBLE), 9) AS share_above
    FROM r WHERE rho IS NOT NULL GROUP BY 1""",
)
def d38(spark: SparkSession, directory: str) -> DataFrame:
    rho = i10(spark, directory).where(F.col("rho").isNotNull())
    return rho.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rho"), 6).alias("mean"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median"),
        F.round(F.percentile("rho", F.lit(0.75)) - F.percentile("rho", F.lit(0.25)), 6).alias("iqr"),
        F.round(F.avg((F.col("rho") > 0.5).cast("double")), 9).alias("share_above"),
    )


@CATALOG.query(
    "i13_length_residual",
    f"""WITH {_LENGTHS}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY {U}) AS dx, y - avg(y) OVER (PARTITION BY {U}) AS dy FROM sl),
    s AS (SELECT {U}, count(*) AS n, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy FROM m GROUP BY ALL)
    SELECT {U}, n, round(xx - CASE WHEN yy > 0 THEN xy * xy / yy ELSE 0 END, 5) AS unexplained FROM s""",
)
def i13(spark: SparkSession, directory: str) -> DataFrame:
    """The part of the squared magnitudes that length does not explain."""
    left = inference.ols_residual(with_tokens(spark, directory), UNIT, "magnitude", "tokens")
    return left.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("residual") * F.col("residual")), 5).alias("unexplained"))


# A score per commit and method against its label: the mean magnitude of its lines, squashed into (0, 1).
_RISK = f"""{COMMITS}, {SCORES}, risk AS (SELECT s.commit_id, s.method, c.project, c.tokens, c.is_positive::INT AS y, round(1 - exp(-avg(abs(s.score))), 4) AS score
    FROM scores s JOIN commits c ON c.commit_id = s.commit_id WHERE c.is_positive IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def risk(spark: SparkSession, directory: str) -> DataFrame:
    c = commits(spark, directory).where(F.col("is_positive").isNotNull()).select("commit_id", "project", "tokens", F.col("is_positive").cast("int").alias("y"))
    per = scores(spark, directory).groupBy("commit_id", "method").agg(F.round(1 - F.exp(-F.avg(F.abs("score"))), 4).alias("score"))
    return per.join(c, "commit_id")


_CLIFF = """k AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS r FROM risk),
    u AS (SELECT method, count_if(y = 1) AS n1, count_if(y = 0) AS n0, sum(r) FILTER (y = 1) AS s FROM k GROUP BY 1)"""


@CATALOG.query("i04_cliffs_delta", f"WITH {_RISK}, {_CLIFF} SELECT method, n1 AS n_1, n0 AS n_0, round(2 * (s - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 9) AS delta FROM u")
def i04(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(inference.cliffs_delta(risk(spark, directory), "y", "score", ["method"]), "delta")


@CATALOG.query("i05_point_biserial", f"WITH {_RISK} SELECT method, count(*) AS n, round(corr(score, y), 7) AS r FROM risk GROUP BY 1")
def i05(spark: SparkSession, directory: str) -> DataFrame:
    return inference.point_biserial(risk(spark, directory), ["method"], "score", "y").withColumn("r", F.round("r", 7))


@CATALOG.query(
    "i22_ranking_metrics",
    f"""WITH {_RISK}, {_CLIFF}, c AS (SELECT method, score, count_if(y = 1) AS p, count(*) AS n FROM risk GROUP BY 1, 2),
    w AS (SELECT *, sum(p) OVER (PARTITION BY method ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY method ORDER BY score DESC) AS k FROM c),
    ap AS (SELECT method, sum(p * tp / k) / sum(p) AS ap FROM w GROUP BY 1), b AS (SELECT method, count(*) AS n, count_if(y = 1) AS n_positive, avg((score - y) ** 2) AS brier FROM risk GROUP BY 1)
    SELECT method, n, n_positive, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS roc_auc, round(ap, 9) AS average_precision, round(brier, 9) AS brier FROM u JOIN ap USING (method) JOIN b USING (method)""",
)
def i22(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(classify.ranking_metrics(risk(spark, directory), ["method"]), "roc_auc", "average_precision", "brier")


@CATALOG.query(
    "i24_rates_at_threshold",
    f"""WITH {_RISK}, c AS (SELECT method, count_if(score >= 0.7 AND y = 1)::DOUBLE AS tp, count_if(score >= 0.7 AND y = 0)::DOUBLE AS fp, count_if(score < 0.7 AND y = 1)::DOUBLE AS fn,
        count_if(score < 0.7 AND y = 0)::DOUBLE AS tn FROM risk GROUP BY 1),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM c)
    SELECT method, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, 9) AS precision, round(q, 9) AS recall, round(s, 9) AS specificity,
        round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) AS f1, round((q + s) / 2, 9) AS balanced_accuracy,
        round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc,
        round((tp + fp) / (tp + fp + fn + tn), 9) AS positive_rate FROM r""",
)
def i24(spark: SparkSession, directory: str) -> DataFrame:
    out = classify.rates(classify.confusion(risk(spark, directory), 0.7, ["method"]))
    return rounded(out, "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc", "positive_rate")


@CATALOG.query(
    "f05_best_threshold",
    f"""WITH {_RISK}, t AS (SELECT DISTINCT method, score AS threshold FROM risk UNION SELECT DISTINCT method, 0.0 FROM risk UNION SELECT DISTINCT method, 1.0 FROM risk),
    e AS (SELECT t.method, t.threshold, count_if(score >= threshold AND y = 1)::DOUBLE AS tp, count_if(score >= threshold)::DOUBLE AS k, count_if(y = 1)::DOUBLE AS pos FROM t JOIN risk USING (method) GROUP BY 1, 2),
    f AS (SELECT *, coalesce(2 * tp / nullif(k + pos, 0), 0) AS f1, coalesce(tp / nullif(pos, 0), 0) AS recall FROM e),
    b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, recall DESC, threshold) AS i FROM f)
    SELECT method, threshold, round(f1, 9) AS f1, round(recall, 9) AS recall FROM b WHERE i = 1""",
)
def f05(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(classify.best_f1_threshold(risk(spark, directory), ["method"]), "f1", "recall")


@CATALOG.query(
    "d22_score_distribution",
    f"""WITH {_RISK} SELECT method, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.01), 9) AS p01, round(quantile_cont(score, 0.05), 9) AS p05,
    round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75, round(quantile_cont(score, 0.9), 9) AS p90,
    round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99 FROM risk GROUP BY 1""",
)
def d22(spark: SparkSession, directory: str) -> DataFrame:
    q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    return rounded(classify.score_distribution(risk(spark, directory), ["method"], "score", q), "mean", *(f"p{round(p * 100):02d}" for p in q))


@CATALOG.query(
    "d23_class_stats",
    f"""WITH {_RISK} SELECT y, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.5), 9) AS median, round(stddev_pop(score), 9) AS sd, min(score) AS min, max(score) AS max, count(*) AS n
    FROM risk GROUP BY 1""",
)
def d23(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(classify.class_stats(risk(spark, directory)), "mean", "median", "sd")


@CATALOG.query(
    "c19_outcomes",
    f"WITH {_RISK} SELECT method, CASE WHEN score >= 0.7 AND y = 1 THEN 'TP' WHEN score < 0.7 AND y = 1 THEN 'FN' WHEN score >= 0.7 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n FROM risk GROUP BY 1, 2",
)
def c19(spark: SparkSession, directory: str) -> DataFrame:
    return risk(spark, directory).groupBy("method", classify.outcome(F.col("y"), F.col("score") >= 0.7).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "d14_majority_vote",
    f"WITH {_RISK} SELECT commit_id, count(*) AS n_votes, (2 * sum((score >= 0.7)::INT) >= count(*))::INT AS majority FROM risk GROUP BY 1 HAVING count(*) >= 2",
)
def d14(spark: SparkSession, directory: str) -> DataFrame:
    return classify.majority(risk(spark, directory).withColumn("vote", (F.col("score") >= 0.7).cast("int")), ["commit_id"], "vote")


@CATALOG.query(
    "f04_best_checkpoint",
    f"""WITH {_RISK}, e AS (SELECT method, y AS epoch, round(avg(score), 2) AS pr_auc, round(max(score), 4) AS roc_auc FROM risk GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY pr_auc DESC, roc_auc DESC, epoch) AS i FROM e) SELECT method, epoch, pr_auc, roc_auc FROM b WHERE i = 1""",
)
def f04(spark: SparkSession, directory: str) -> DataFrame:
    epochs = risk(spark, directory).groupBy("method", F.col("y").alias("epoch")).agg(F.round(F.avg("score"), 2).alias("pr_auc"), F.round(F.max("score"), 4).alias("roc_auc"))
    return classify.best_checkpoint(epochs, ["method"])


@CATALOG.query(
    "d20_group_comparison",
    f"""WITH {COMMITS}, x AS (SELECT commit_id, is_positive::INT AS y, tokens::DOUBLE AS v FROM commits WHERE is_positive IS NOT NULL AND tokens IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v) AS i, count(*) OVER (PARTITION BY y) AS n FROM x),
    s AS (SELECT y, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS sd,
          quantile_cont(v, 0.5) FILTER (i > n - n // 2) - quantile_cont(v, 0.5) FILTER (i <= n // 2) AS iqr FROM k GROUP BY 1)
    SELECT a.n AS n_1, b.n AS n_0, round(a.mean, 6) AS mean_1, round(b.mean, 6) AS mean_0, a.median AS median_1, b.median AS median_0, a.iqr AS iqr_1, b.iqr AS iqr_0,
        round((a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2), 7) AS smd FROM s a JOIN s b ON a.y = 1 AND b.y = 0""",
)
def d20(spark: SparkSession, directory: str) -> DataFrame:
    rows = commits(spark, directory).where(F.col("is_positive").isNotNull()).select("commit_id", F.col("is_positive").cast("int").alias("y"), F.col("tokens").cast("double").alias("v"))
    s = inference.half_medians_summary(rows, ["y"], "v")
    a, b = (s.where(F.col("y") == i).select(*(F.col(c).alias(f"{c}_{i}") for c in ("n", "mean", "median", "sd", "iqr"))) for i in (1, 0))
    out = a.crossJoin(b)  # one row each
    out = out.withColumn("smd", F.round(standardized_difference(F.col("mean_1"), F.col("mean_0"), F.col("sd_1"), F.col("sd_0")), 7))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_1", "mean_0")}).drop("sd_1", "sd_0")


_BOOT = "('0x' || substr(sha256('BOOT|' || repeat || '|' || i), 1, 8))::BIGINT"


def _bootstrap_sql(cluster: str) -> str:
    return f"""WITH {_RISK}, s AS (SELECT {cluster} AS c, sum(score) AS s, count(*) AS k FROM risk WHERE {cluster} IS NOT NULL GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY substr(sha256(c), 1, 3), c) - 1 AS i, count(*) OVER () AS n FROM s),
    d AS (SELECT repeat, {_BOOT} % n AS i FROM n, range(50) AS g(repeat)), m AS (SELECT repeat, sum(s) / sum(k) AS m FROM d JOIN n USING (i) GROUP BY 1)
    SELECT (SELECT round(sum(s) / sum(k), 7) FROM s) AS estimate, round(quantile_cont(m, 0.025), 7) AS low, round(quantile_cont(m, 0.975), 7) AS high, (SELECT count(*) FROM s) AS n_clusters FROM m"""


def _bootstrap(cluster: str):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        rows = risk(spark, directory).where(F.col(cluster).isNotNull())
        out = inference.bootstrap(rows, "score", cluster, 50, "BOOT")
        return out.withColumns({c: F.round(c, 7) for c in ("estimate", "low", "high")})

    return run


CATALOG.query("i06_bootstrap_commits", _bootstrap_sql("commit_id"))(_bootstrap("commit_id"))
CATALOG.query("i09_bootstrap_projects", _bootstrap_sql("project"))(_bootstrap("project"))

#: The reference's number of resamples.
REPEATS = 10_000


def _bootstrap_whole(cluster: str):
    """Every method with all resamples; the two queries above hold 50 hashed draws against SQL."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        out = inference.grouped_bootstrap(risk(spark, directory), ["method"], "score", cluster, REPEATS, "BOOT")
        return out.withColumns({c: F.round(c, 7) for c in ("estimate", "low", "high")})

    return run


CATALOG.query("i06_bootstrap_commits_whole")(_bootstrap_whole("commit_id"))
CATALOG.query("i09_bootstrap_projects_whole")(_bootstrap_whole("project"))


# Cohorts.
def members(spark: SparkSession, directory: str) -> DataFrame:
    return commits(spark, directory).where(F.col("tokens").isNotNull())


#: The reference's number of matched positives.
MATCHED = 475


@CATALOG.query("c18_matched_negatives")
def c18(spark: SparkSession, directory: str) -> DataFrame:
    m = members(spark, directory).where("split = 'test' AND project IS NOT NULL")
    return cohorts.matched_negatives(m.where("is_positive"), m.where("NOT is_positive"), MATCHED)


@CATALOG.query(
    "e18_rehearsal_cohort",
    f"""WITH {COMMITS}, m AS (SELECT * FROM commits WHERE split = 'valid' AND is_positive AND tokens IS NOT NULL AND project IS NOT NULL),
    k AS (SELECT *, row_number() OVER (ORDER BY tokens, commit_id) - 1 AS k, count(*) OVER () AS n FROM m),
    q AS (SELECT *, least(3, k // greatest(1, n // 4))::INT AS quartile FROM k),
    l AS (SELECT *, row_number() OVER (PARTITION BY project, quartile ORDER BY k) = 1 AS lead FROM q),
    p AS (SELECT *, (row_number() OVER (ORDER BY NOT lead, CASE WHEN lead THEN project ELSE '' END, quartile, CASE WHEN lead THEN '' ELSE commit_id END) - 1)::INT AS place FROM l)
    SELECT commit_id, quartile, place FROM p WHERE place < 64""",
)
def e18(spark: SparkSession, directory: str) -> DataFrame:
    pool = members(spark, directory).where("split = 'valid' AND is_positive AND project IS NOT NULL")
    return cohorts.rehearsal_cohort(pool, 64).select("commit_id", "quartile", "place")


@CATALOG.query("f03_hashed_sample", f"WITH {COMMITS} SELECT commit_id FROM commits ORDER BY sha256('sanity|' || commit_id), commit_id LIMIT 16")
def f03(spark: SparkSession, directory: str) -> DataFrame:
    return cohorts.hashed_sample(commits(spark, directory).select("commit_id"), 16, "commit_id", "sanity")


@CATALOG.query(
    "j05_balanced_sample",
    f"""WITH {COMMITS}, k AS (SELECT commit_id, is_positive, row_number() OVER (PARTITION BY is_positive ORDER BY sha256('42|' || commit_id), commit_id)::INT AS place FROM commits WHERE split = 'train')
    SELECT commit_id, is_positive, place FROM k WHERE place <= 16""",
)
def j05(spark: SparkSession, directory: str) -> DataFrame:
    train = commits(spark, directory).where("split = 'train'").select("commit_id", "is_positive")
    return cohorts.hashed_sample_per_group(train, ["is_positive"], F.lit(16), "commit_id", "42")


@CATALOG.query(
    "j06_stratified_sample",
    f"""WITH {COMMITS}, t AS (SELECT commit_id, is_positive, split FROM commits WHERE split IS NOT NULL AND is_positive IS NOT NULL), s AS (SELECT is_positive, split, count(*) AS size, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS exact FROM t GROUP BY 1, 2),
    q AS (SELECT *, floor(exact) + (row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, is_positive, split) <= 100 - sum(floor(exact)) OVER ())::INT AS quota FROM s),
    k AS (SELECT t.commit_id, t.is_positive, t.split, q.quota, row_number() OVER (PARTITION BY t.is_positive, t.split ORDER BY sha256('42|' || commit_id), commit_id) AS place FROM t JOIN q USING (is_positive, split))
    SELECT commit_id, is_positive, split FROM k WHERE place <= quota""",
)
def j06(spark: SparkSession, directory: str) -> DataFrame:
    rows = commits(spark, directory).where(F.col("split").isNotNull() & F.col("is_positive").isNotNull()).select("commit_id", "is_positive", "split")
    return cohorts.stratified_sample(rows, ["is_positive", "split"], 100, "commit_id", "42").select("commit_id", "is_positive", "split")


@CATALOG.query("j06_stage_b_sample")
def j06_stage_b(spark: SparkSession, directory: str) -> DataFrame:
    """The reference's sample: 2,048 commits of the train split by label, with swaps that cover the projects."""
    train = commits(spark, directory).where("split = 'train'").select("commit_id", "is_positive", "project")
    return cohorts.covering_sample(train, "is_positive", "project", 2048, "commit_id", "43")


#: The reference's number of shuffled prefixes.
TRIALS = 256


@CATALOG.query("j04_token_matched_draws")
def j04(spark: SparkSession, directory: str) -> DataFrame:
    """For every commit a random set of lines with about a fifth of its tokens."""
    rows = lines(spark, directory).where(F.col("line_id").isNotNull() & (F.col("tokens") > 0)).select("commit_id", F.col("line_id").alias("region_id"), "tokens")
    total = rows.groupBy("commit_id").agg(F.ceil(F.sum("tokens") * F.lit(0.2)).alias("target"))
    return cohorts.token_matched_draws(rows.join(total, "commit_id"), ["commit_id"], "target", TRIALS)


_PER_SEED = f"""{COMMITS}, {SCORES}, r AS (SELECT s.commit_id, s.method, s.seed, c.is_positive::INT AS y, avg(abs(s.score)) AS score FROM scores s JOIN commits c ON c.commit_id = s.commit_id
    WHERE c.is_positive IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@CATALOG.query("i18_point_biserial_by_seed", f"WITH {_PER_SEED} SELECT method, seed, count(*) AS n, round(corr(score, y), 7) AS r FROM r GROUP BY 1, 2")
def i18(spark: SparkSession, directory: str) -> DataFrame:
    c = commits(spark, directory).where(F.col("is_positive").isNotNull()).select("commit_id", F.col("is_positive").cast("int").alias("y"))
    per = scores(spark, directory).groupBy(*UNIT).agg(F.avg(F.abs("score")).alias("score")).join(c, "commit_id")
    return inference.point_biserial(per, ["method", "seed"], "score", "y").withColumn("r", F.round("r", 7))


_RESIDUALS = f"""{_LENGTHS}, m AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM sl WINDOW w AS (PARTITION BY {U})),
    e AS (SELECT commit_id, method, seed, region_id, round(dx - coalesce(sum(dx * dy) OVER w / nullif(sum(dy * dy) OVER w, 0), 0) * dy, 9) AS res FROM m WINDOW w AS (PARTITION BY {U})),
    met AS (SELECT a.commit_id, a.method, a.seed AS seed_a, b.seed AS seed_b, a.res AS x, b.res AS y FROM e a JOIN e b USING (commit_id, method, region_id) WHERE a.seed < b.seed),
    k AS (SELECT *, {_ranks("x", "commit_id, method, seed_a, seed_b", "rx")}, {_ranks("y", "commit_id, method, seed_a, seed_b", "ry")} FROM met),
    p AS (SELECT commit_id, method, {_CORR.format(n=2)} FROM k GROUP BY commit_id, method, seed_a, seed_b HAVING count(*) >= 2),
    q AS (SELECT commit_id, method, avg(rho) AS rho FROM p WHERE rho IS NOT NULL GROUP BY 1, 2)"""


@CATALOG.query("i14_length_adjusted_stability", f"WITH {_RESIDUALS} SELECT method, count(*) AS n_commits, round(avg(rho), 4) AS mean_rho FROM q GROUP BY 1")
def i14(spark: SparkSession, directory: str) -> DataFrame:
    """Agreement of seeds on what length does not explain, over pairs within commits, then over commits."""
    left = inference.ols_residual(with_tokens(spark, directory), UNIT, "magnitude", "tokens").withColumn("residual", F.round("residual", 9))
    pairs = inference.seed_pair_stability(left, ["commit_id", "method"], "residual").where(F.col("rho").isNotNull())
    per = pairs.groupBy("commit_id", "method").agg(F.avg("rho").alias("rho"))
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("n_commits"), F.round(F.avg("rho"), 4).alias("mean_rho"))


@CATALOG.query(
    "j07_phased_sample",
    f"""WITH {COMMITS}, h AS (SELECT commit_id, project, is_positive, sha256('20261001|' || commit_id) AS h FROM commits WHERE split = 'train' AND project IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY h, commit_id) = 1 AS lead FROM h), a AS (SELECT *, row_number() OVER (ORDER BY NOT lead, h, commit_id) AS i FROM f),
    b AS (SELECT *, row_number() OVER (ORDER BY i > 90, CASE WHEN i > 90 THEN (NOT coalesce(is_positive, false))::INT ELSE 0 END, i) AS place FROM a)
    SELECT commit_id, place::INT AS place FROM b WHERE place <= 100""",
)
def j07(spark: SparkSession, directory: str) -> DataFrame:
    """One commit of every project, others up to 90, then positives first up to 100, all in hash order."""
    rows = commits(spark, directory).where("split = 'train' AND project IS NOT NULL").select("commit_id", "project", "is_positive")
    return cohorts.phased_sample(rows, "project", 90, ~F.coalesce(F.col("is_positive"), F.lit(False)), 100, "commit_id", "20261001").select("commit_id", "place")
