"""Ranking, baselines, faithfulness, polarity and enrichment over the attribution rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.operators import enrichment, faithfulness, polarity, ranking
from sparline.plans.base import LINES, SCORES, UNIT, lines, scores, settled, settled_sql
from sparline.plans.catalog import Catalog

CATALOG = Catalog()
FRACTIONS = (0.1, 0.2, 0.3, 0.5)
U = "commit_id, method, seed"


def transform_sql(kind: str) -> str:
    return {"ABS": "abs(score)", "RAW": "score", "SIGNED_POSITIVE": "greatest(0.0, score)"}[kind]


def localization_sql(source: str, unit: str = U, by: str = "abs(score) DESC, position, region_id") -> str:
    """CTEs r, w and metrics over the relation ``source``."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY {by}) AS rk, count(*) OVER (PARTITION BY {unit}) AS cn,
            sum((status = 'POSITIVE')::INT) OVER (PARTITION BY {unit}) AS np FROM {source} WHERE status IN ('POSITIVE', 'NEGATIVE')),
        w AS (SELECT *, sum((status = 'POSITIVE')::INT) OVER (PARTITION BY {unit} ORDER BY rk) AS seen FROM r),
        m AS (SELECT {unit}, count(*) AS n, sum((status = 'POSITIVE')::INT)::BIGINT AS n_positive,
            max((status = 'POSITIVE' AND rk <= 1)::INT) AS t1, max((status = 'POSITIVE' AND rk <= 5)::INT) AS t5, max((status = 'POSITIVE' AND rk <= 10)::INT) AS t10,
            min(CASE WHEN status = 'POSITIVE' THEN rk END) - 1 AS i,
            sum((status = 'POSITIVE' AND rk <= greatest(1, floor(0.2::DOUBLE * cn)))::INT) AS found,
            min(CASE WHEN seen >= greatest(1, floor(0.2::DOUBLE * np)) THEN rk END) AS at20 FROM w GROUP BY ALL),
        metrics AS (SELECT {unit}, n, n_positive, CASE WHEN n_positive > 0 THEN t1 END AS top1, CASE WHEN n_positive > 0 THEN t5 END AS top5,
            CASE WHEN n_positive > 0 THEN t10 END AS top10, CASE WHEN n_positive > 0 THEN i END AS ifa,
            CASE WHEN n_positive > 0 THEN found / n_positive END AS recall_at_effort, CASE WHEN n_positive > 0 THEN at20 / n END AS effort_at_recall,
            CASE WHEN n_positive > 0 THEN 'OK' ELSE 'NO_POSITIVE' END AS state FROM m)"""


METRICS = f"{SCORES}, {localization_sql('scores')}"
_ROUND = "round(recall_at_effort, 9) AS recall_at_effort, round(effort_at_recall, 9) AS effort_at_recall"
_COLUMNS = f"n, n_positive, top1, top5, top10, ifa, {_ROUND}, state"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def metrics(spark: SparkSession, directory: str) -> DataFrame:
    return ranking.localization(scores(spark, directory), UNIT, "ABS")


@CATALOG.query("b01_rq1_universe", f"WITH {SCORES} SELECT method, status, count(*) AS n FROM scores WHERE status IN ('POSITIVE', 'NEGATIVE') GROUP BY 1, 2")
def b01(spark: SparkSession, directory: str) -> DataFrame:
    return ranking.rq1_universe(scores(spark, directory)).groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "e02_ranked_lines",
    f"""WITH {SCORES} SELECT {U}, region_id, round(abs(score), 9) AS rank_score, row_number() OVER (PARTITION BY {U}
    ORDER BY abs(score) DESC, position, region_id)::INT AS rank FROM scores WHERE status IN ('POSITIVE', 'NEGATIVE')""",
)
def e02(spark: SparkSession, directory: str) -> DataFrame:
    out = ranking.ranked(ranking.rq1_universe(scores(spark, directory)), UNIT, "ABS")
    return rounded(out.select(*UNIT, "region_id", "rank_score", "rank"), "rank_score")


@CATALOG.query("e03_localization", f"WITH {METRICS} SELECT {U}, {_COLUMNS} FROM metrics")
def e03(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(metrics(spark, directory), "recall_at_effort", "effort_at_recall")


@CATALOG.query(
    "e15_magnitude_rank",
    f"WITH {SCORES} SELECT {U}, region_id, (row_number() OVER (PARTITION BY {U} ORDER BY abs(score) DESC, region_id) - 1)::INT AS rank FROM scores",
)
def e15(spark: SparkSession, directory: str) -> DataFrame:
    return ranking.ranked_by_magnitude(scores(spark, directory), UNIT).select(*UNIT, "region_id", "rank")


@CATALOG.query(
    "e08_negative_hit_rate",
    f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY abs(score) DESC, region_id) AS rk FROM scores)
    SELECT {U}, count(*) AS n_hits, round(avg((score < 0)::INT::DOUBLE), 9) AS negative_rate FROM k WHERE rk <= 5 AND status = 'POSITIVE' GROUP BY ALL""",
)
def e08(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(ranking.negative_hit_rate(scores(spark, directory), UNIT, 5), "negative_rate")


_LABELLED = "base AS (SELECT commit_id, line_id AS region_id, status, position, change_type, tokens, {} AS score FROM lines WHERE line_id IS NOT NULL)"


def _labelled(spark: SparkSession, directory: str) -> DataFrame:
    rows = lines(spark, directory).where(F.col("line_id").isNotNull())
    return rows.select("commit_id", F.col("line_id").alias("region_id"), "status", "position", "change_type", "tokens")


def _baseline(name: str, sql_score: str, score) -> None:
    sql = f"WITH {LINES}, {_LABELLED.format(sql_score)}, {localization_sql('base', 'commit_id', 'score DESC, position, region_id')} SELECT commit_id, {_COLUMNS} FROM metrics"

    def run(spark: SparkSession, directory: str) -> DataFrame:
        scored = _labelled(spark, directory).withColumn("score", score())
        return rounded(ranking.localization(scored, ["commit_id"], "RAW"), "recall_at_effort", "effort_at_recall")

    CATALOG.query(name, sql)(run)


_baseline("h39_length_baseline", "tokens::DOUBLE", lambda: ranking.length_baseline(F.col("tokens")))
_baseline("h40_order_baseline", "-position::DOUBLE", lambda: ranking.order_baseline(F.col("position")))


@CATALOG.query(
    "h41_add_first_baseline",
    f"""WITH {LINES}, a AS (SELECT commit_id, change_type, bool_and(change_type = 'added') OVER (PARTITION BY commit_id) AS every FROM lines WHERE line_id IS NOT NULL)
    SELECT commit_id, count(*) AS n, sum(CASE WHEN NOT every THEN (change_type = 'added')::INT END)::DOUBLE AS total FROM a GROUP BY 1""",
)
def h41(spark: SparkSession, directory: str) -> DataFrame:
    scored = ranking.add_first_baseline(_labelled(spark, directory), ["commit_id"])
    return scored.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


_SIGNED = localization_sql("scores", U, "greatest(0.0, score) DESC, position, region_id")
for _name in ("r", "w", "m", "metrics"):
    _SIGNED = _SIGNED.replace(f"{_name} AS (SELECT", f"s_{_name} AS (SELECT").replace(f"FROM {_name} ", f"FROM s_{_name} ").replace(f"FROM {_name})", f"FROM s_{_name})")


@CATALOG.query(
    "h42_signed_minus_absolute",
    f"""WITH {METRICS}, {_SIGNED} SELECT commit_id, method, seed, round(s.recall_at_effort, 9) AS signed, round(a.recall_at_effort, 9) AS absolute,
    round(s.recall_at_effort - a.recall_at_effort, 9) AS delta FROM s_metrics s JOIN metrics a USING ({U}) WHERE a.state = 'OK'""",
)
def h42(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(ranking.signed_minus_absolute(scores(spark, directory), UNIT), "signed", "absolute", "delta")


_PERMUTED = localization_sql("base", "commit_id, repeat", "sha256('RANDOM|' || repeat || '|' || region_id), region_id").replace("FROM base", "FROM base, range(10) AS g(repeat)")


@CATALOG.query(
    "j08_random_baseline",
    f"""WITH {LINES}, {_LABELLED.format("0.0")}, {_PERMUTED}
    SELECT commit_id, round(avg(recall_at_effort), 9) AS recall_at_effort, count(*) AS n_repeats FROM metrics WHERE state = 'OK' GROUP BY 1""",
)
def j08(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(ranking.random_baseline(_labelled(spark, directory), ["commit_id"], 10), "recall_at_effort")


#: The reference's number of permutations.
PERMUTATIONS = 100


@CATALOG.query("j08_random_baseline_whole")
def j08_whole(spark: SparkSession, directory: str) -> DataFrame:
    """All permutations; the query above holds ten hashed ones against SQL."""
    return rounded(ranking.permuted_baseline(_labelled(spark, directory), "commit_id", PERMUTATIONS), "recall_at_effort")


# Faithfulness: the effect of a line is its mean score over methods and seeds, its cost its tokens.
_EFFECTS = f"""{LINES}, {SCORES}, e AS (SELECT commit_id, region_id, round(avg(score), 9) AS effect FROM scores GROUP BY 1, 2),
    eff AS (SELECT l.commit_id, l.line_id AS region_id, greatest(1, l.tokens) AS tokens, e.effect, row_number() OVER (PARTITION BY l.commit_id
        ORDER BY abs(e.effect) DESC, l.line_id) AS rk FROM lines l JOIN e ON e.region_id = l.line_id)"""


def effects(spark: SparkSession, directory: str) -> DataFrame:
    mean = scores(spark, directory).groupBy("region_id").agg(F.round(F.avg("score"), 9).alias("score"))
    rows = lines(spark, directory).select("commit_id", F.col("line_id").alias("region_id"), F.greatest(F.lit(1), F.col("tokens")).alias("tokens"))
    ranks = ranking.ranked_by_magnitude(rows.join(mean, "region_id"), ["commit_id"])
    return ranks.withColumns({"rank": F.col("rank") + 1, "effect": F.col("score")})


_PREFIX = f"""{_EFFECTS}, t AS (SELECT *, sum(tokens) OVER (PARTITION BY commit_id ORDER BY rk) AS run, sum(tokens) OVER (PARTITION BY commit_id) AS total FROM eff),
    p AS (SELECT t.*, f.fraction, greatest(1, ceil(f.fraction * total))::BIGINT AS budget FROM t, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) AS f(fraction)),
    prefix AS (SELECT * FROM p WHERE run - tokens < budget)"""


@CATALOG.query(
    "e12_budget_prefix",
    f"""WITH {_PREFIX} SELECT commit_id, fraction, budget, count(*) AS n_regions, sum(tokens)::BIGINT AS realised,
    greatest(0, sum(tokens) - budget)::BIGINT AS overshoot FROM prefix GROUP BY 1, 2, 3""",
)
def e12(spark: SparkSession, directory: str) -> DataFrame:
    return faithfulness.budget_realised(faithfulness.budget_prefix(effects(spark, directory), ["commit_id"], FRACTIONS), ["commit_id"])


@CATALOG.query(
    "k29_deletion_aopc",
    f"""WITH {_PREFIX}, c AS (SELECT commit_id, fraction, abs(sum(effect)) AS impact FROM prefix GROUP BY 1, 2)
    SELECT commit_id, {settled_sql('avg(impact)')} AS aopc FROM c GROUP BY 1""",
)
def k29(spark: SparkSession, directory: str) -> DataFrame:
    curve = faithfulness.absolute_deletion_curve(effects(spark, directory), ["commit_id"], FRACTIONS)
    return faithfulness.aopc(curve, ["commit_id"]).withColumn("aopc", settled("aopc"))


@CATALOG.query(
    "k26_removal_curve",
    f"""WITH {_EFFECTS}, g AS (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM eff),
    c AS (SELECT commit_id, fraction, count(*) FILTER (rk <= greatest(1, ceil(fraction * n))) AS k, sum(effect) AS f, sum(CASE WHEN rk <= greatest(1, ceil(fraction * n)) THEN effect ELSE 0.0 END) AS o
          FROM g, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) AS x(fraction) GROUP BY 1, 2)
    SELECT commit_id, fraction, k, {settled_sql('o')} AS comprehensiveness, {settled_sql('f - o')} AS sufficiency, {settled_sql('abs(f - o)')} AS sufficiency_error, {settled_sql('abs(o)')} AS insertion_gain FROM c""",
)
def k26(spark: SparkSession, directory: str) -> DataFrame:
    out = faithfulness.removal_curve(effects(spark, directory), ["commit_id"], FRACTIONS)
    return out.withColumns({c: settled(c) for c in ("comprehensiveness", "sufficiency", "sufficiency_error", "insertion_gain")})


_POLAR = f"""{SCORES}, x AS (SELECT *, max(abs(score)) OVER (PARTITION BY {U}) AS big FROM scores),
    p AS (SELECT *, CASE WHEN big = 0 THEN 0.0 ELSE greatest(1e-8::DOUBLE, 1e-6::DOUBLE * big) END AS eps FROM x),
    c AS (SELECT *, CASE WHEN big > 0 AND score > eps THEN 'POSITIVE' WHEN big > 0 AND score < -eps THEN 'NEGATIVE' ELSE 'NEAR_ZERO' END AS polarity FROM p)"""


@CATALOG.query("h27_polarity", f"WITH {_POLAR} SELECT method, polarity, count(*) AS n FROM c GROUP BY 1, 2")
def h27(spark: SparkSession, directory: str) -> DataFrame:
    return polarity.classify(scores(spark, directory), UNIT).groupBy("method", "polarity").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "f01_polarity_summary",
    f"""WITH {_POLAR}, k AS (SELECT *, row_number() OVER (PARTITION BY {U} ORDER BY score DESC, region_id) AS up, row_number() OVER (PARTITION BY {U} ORDER BY score, region_id) AS down FROM c)
    SELECT {U}, count(*) AS n, round(max(eps), 15) AS epsilon, round(avg((polarity = 'POSITIVE')::INT::DOUBLE), 9) AS positive_fraction,
        round(avg((polarity = 'NEGATIVE')::INT::DOUBLE), 9) AS negative_fraction, round(avg((polarity = 'NEAR_ZERO')::INT::DOUBLE), 9) AS near_zero_fraction,
        coalesce(string_agg(region_id, ',' ORDER BY up) FILTER (up <= 5 AND polarity = 'POSITIVE'), '') AS top_positive,
        coalesce(string_agg(region_id, ',' ORDER BY down) FILTER (down <= 5 AND polarity = 'NEGATIVE'), '') AS top_negative FROM k GROUP BY ALL""",
)
def f01(spark: SparkSession, directory: str) -> DataFrame:
    out = polarity.summary(scores(spark, directory), UNIT, 5)
    out = out.withColumns({c: F.array_join(c, ",") for c in ("top_positive", "top_negative")}).withColumn("epsilon", F.round("epsilon", 15))
    return rounded(out, "positive_fraction", "negative_fraction", "near_zero_fraction")


@CATALOG.query(
    "c15_sign_agreement",
    f"""WITH {SCORES}, met AS (SELECT a.commit_id, a.seed, a.score AS x, b.score AS y, max(abs(a.score)) OVER (PARTITION BY a.commit_id, a.seed) AS bx,
            max(abs(b.score)) OVER (PARTITION BY a.commit_id, a.seed) AS by_
        FROM scores a JOIN scores b USING (commit_id, seed, region_id) WHERE a.method = 'grad_x_input' AND b.method = 'occlusion_line'),
    s AS (SELECT *, CASE WHEN bx = 0 THEN 0 WHEN x > greatest(1e-8::DOUBLE, 1e-6::DOUBLE * bx) THEN 1 WHEN x < -greatest(1e-8::DOUBLE, 1e-6::DOUBLE * bx) THEN -1 ELSE 0 END AS sx,
        CASE WHEN by_ = 0 THEN 0 WHEN y > greatest(1e-8::DOUBLE, 1e-6::DOUBLE * by_) THEN 1 WHEN y < -greatest(1e-8::DOUBLE, 1e-6::DOUBLE * by_) THEN -1 ELSE 0 END AS sy FROM met)
    SELECT commit_id, seed, count(*) AS n, count_if(sx * sy <> 0) AS n_signed, count_if(sx * sy = 1) AS n_agree, count_if(sx * sy = -1) AS n_opposite,
        round(coalesce(count_if(sx * sy = 1) / nullif(count_if(sx * sy <> 0), 0), 0), 9) AS agreement FROM s GROUP BY 1, 2""",
)
def c15(spark: SparkSession, directory: str) -> DataFrame:
    s = scores(spark, directory)
    a, b = s.where("method = 'grad_x_input'"), s.where("method = 'occlusion_line'")
    return rounded(polarity.sign_agreement(a, b, ["commit_id", "seed"]), "agreement")


@CATALOG.query(
    "f02_top_hunks_negative",
    f"""WITH h AS ({SCORES.replace("scores AS (", "", 1).rstrip(")").replace("'LINE'", "'HUNK'")}),
    k AS (SELECT *, row_number() OVER (PARTITION BY commit_id, seed ORDER BY score DESC, region_id) AS rk FROM h WHERE method = 'attention_last'),
    met AS (SELECT k.commit_id, k.seed, d.score AS d, max(abs(d.score)) OVER (PARTITION BY k.commit_id, k.seed) AS big
            FROM k LEFT JOIN h d ON d.method = 'occlusion_line' AND d.commit_id = k.commit_id AND d.seed = k.seed AND d.region_id = k.region_id WHERE k.rk <= 2)
    SELECT commit_id, seed, count(*) AS n_top, count(d) AS n_scored,
        round(avg(coalesce(big > 0 AND d < -greatest(1e-8::DOUBLE, 1e-6::DOUBLE * big), false)::INT::DOUBLE), 9) AS negative_fraction FROM met GROUP BY 1, 2""",
)
def f02(spark: SparkSession, directory: str) -> DataFrame:
    h = scores(spark, directory, "HUNK")
    return rounded(polarity.top_hunks_negative(h.where("method = 'attention_last'"), h.where("method = 'occlusion_line'"), ["commit_id", "seed"]), "negative_fraction")


@CATALOG.query(
    "d01_reduce_scores",
    f"""WITH {SCORES}, f AS (SELECT *, split_part(region_id, '|', 2) AS path FROM scores)
    SELECT {U}, path, {settled_sql('sum(score)')} AS sum_score, {settled_sql('avg(score)')} AS mean_score, arg_max(score, struct_pack(a := abs(score), b := -position)) AS extreme_score
    FROM f GROUP BY {U}, path""",
)
def d01(spark: SparkSession, directory: str) -> DataFrame:
    rows = scores(spark, directory).withColumn("path", F.split_part(F.col("region_id"), F.lit("|"), F.lit(2)))
    keys = [*UNIT, "path"]
    one = lambda r, n: enrichment.reduce_scores(rows, keys, r).withColumnRenamed("score", n)
    out = one("SUM", "sum_score").join(one("MEAN", "mean_score"), keys).join(one("MAX_ABS_WITH_SIGN", "extreme_score"), keys)
    return out.withColumns({c: settled(c) for c in ("sum_score", "mean_score")})


_CATEGORIES = ", ".join(f"('{c}')" for c in enrichment.CATEGORIES)


@CATALOG.query(
    "d08_enrichment",
    f"""WITH {SCORES}, t AS (SELECT {U}, count(*) AS n, sum(abs(score)) AS mass FROM scores GROUP BY ALL),
    c AS (SELECT {U}, CASE change_type WHEN 'added' THEN 'ADDED_CODE' WHEN 'deleted' THEN 'DELETED_CODE' ELSE 'CONTEXT_CODE' END AS category, count(*) AS n,
          sum(score) AS s, sum(abs(score)) AS m FROM scores GROUP BY ALL),
    d AS (SELECT t.commit_id, t.method, t.seed, g.category, coalesce(c.n, 0) AS n_tokens, coalesce(c.s, 0.0) AS signed_sum, coalesce(c.m, 0.0) AS mass,
          coalesce(c.n, 0) / t.n AS token_share, CASE WHEN t.mass > 0 THEN coalesce(c.m, 0.0) / t.mass ELSE 0.0 END AS mass_share
          FROM t CROSS JOIN (VALUES {_CATEGORIES}) AS g(category) LEFT JOIN c ON c.commit_id = t.commit_id AND c.method = t.method AND c.seed = t.seed AND c.category = g.category)
    SELECT {U}, category, n_tokens, {settled_sql('signed_sum')} AS signed_sum, {settled_sql('mass')} AS mass, round(token_share, 9) AS token_share, {settled_sql('mass_share')} AS mass_share,
        {settled_sql('CASE WHEN token_share > 0 THEN mass_share / token_share END')} AS enrichment FROM d""",
)
def d08(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.when(F.col("change_type") == "added", "ADDED_CODE").when(F.col("change_type") == "deleted", "DELETED_CODE").otherwise("CONTEXT_CODE")
    out = enrichment.category_mass(scores(spark, directory).withColumn("category", kind), UNIT)
    return rounded(out.withColumns({c: settled(c) for c in ("signed_sum", "mass", "mass_share", "enrichment")}), "token_share")
