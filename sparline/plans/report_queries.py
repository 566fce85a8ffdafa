"""Reports over comparisons and classifiers, cohorts and samples, and small scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparline.functions import ids, lines as lf, scores as sf
from sparline.operators import classify, cohorts, inference, protocol, runs, structure
from sparline.operators.numbering import numbered
from sparline.plans.audit_queries import _META, _UNITS, METHODS, meta, units
from sparline.plans.base import COMMITS, LINES, SCORES, UNIT, commits, lines, scores, settled, settled_sql
from sparline.plans.catalog import Catalog
from sparline.plans.composed_queries import MARKERS
from sparline.plans.inference_queries import _DIFFS, _RISK, PAIRS, VALUES, diffs, members, risk, values
from sparline.plans.ranking_queries import rounded
from sparline.sources.parquet import table

CATALOG = Catalog()

def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS method_a, '{b}' AS method_b, coalesce(x.commit_id, y.commit_id) AS commit_id, count(*) FILTER (x.value IS NOT NULL AND y.value IS NOT NULL) AS k, round(avg(x.value - y.value), 9) AS d
    FROM (SELECT * FROM v WHERE method = '{a}') x FULL JOIN (SELECT * FROM v WHERE method = '{b}') y ON x.commit_id = y.commit_id AND x.seed = y.seed GROUP BY 3"""


_PAIRED = f"""{VALUES}, ds AS ({" UNION ALL ".join(_pair_sql(a, b) for a, b in PAIRS)}), dd AS (SELECT *, CASE WHEN k >= 2 THEN d END AS diff FROM ds),
    rk AS (SELECT *, rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY method_a, method_b, abs(diff)) - 1) / 2 AS r FROM dd WHERE diff IS NOT NULL),
    nz AS (SELECT *, rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY method_a, method_b, abs(diff)) - 1) / 2 AS r FROM dd WHERE diff <> 0),
    e AS (SELECT method_a, method_b, round(coalesce((coalesce(sum(r) FILTER (diff > 0), 0) - coalesce(sum(r) FILTER (diff < 0), 0)) / sum(r), 0), 9) AS rank_biserial FROM nz GROUP BY 1, 2),
    s AS (SELECT method_a, method_b, count(*) FILTER (diff = 0) AS n_zero, coalesce(sum(r) FILTER (diff > 0), 0) AS r_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS r_minus, round(quantile_cont(diff, 0.5), 9) AS median FROM rk GROUP BY 1, 2),
    t AS (SELECT method_a, method_b, count(*) AS n_total, count(diff) AS n_included FROM dd GROUP BY 1, 2)"""


@CATALOG.query("i16_pairwise_statistics", f"WITH {_PAIRED} SELECT method_a, method_b, n_total, n_included, n_zero, r_plus, r_minus, median, coalesce(rank_biserial, 0) AS rank_biserial FROM t JOIN s USING (method_a, method_b) LEFT JOIN e USING (method_a, method_b)")
def i16(spark: SparkSession, directory: str) -> DataFrame:
    """The pairwise report without what needs the normal distribution."""
    out = inference.pairwise_report(values(spark, directory), PAIRS)
    return rounded(out.select("method_a", "method_b", "n_total", "n_included", "n_zero", "r_plus", "r_minus", "median", "rank_biserial"), "median", "rank_biserial")


@CATALOG.query("i30_contrast")
def i30(spark: SparkSession, directory: str) -> DataFrame:
    """The first pair with a bootstrap interval of 10,000 resamples of commits."""
    return inference.contrast(values(spark, directory), PAIRS[0], "RQ1", "PRIMARY", 10_000, "RQ1|recall|1")


@CATALOG.query(
    "i17_family_holm",
    f"""WITH {VALUES}, p AS (SELECT method AS name, CASE WHEN method LIKE 'attention%' THEN 'ATTENTION' ELSE 'OTHER' END AS family, CASE WHEN seed = 13 THEN 'SECONDARY' ELSE 'PRIMARY' END AS role, seed, round(avg(value), 9) AS p_value FROM v GROUP BY 1, 2, 3, 4),
    k AS (SELECT *, row_number() OVER (ORDER BY p_value, name || seed) AS i, count(*) OVER () AS m FROM p WHERE family = 'OTHER' AND role = 'PRIMARY')
    SELECT name, seed, p_value, round(max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i), 9) AS adjusted_p FROM k""",
)
def i17(spark: SparkSession, directory: str) -> DataFrame:
    p = values(spark, directory).groupBy(F.col("method").alias("name"), "seed").agg(F.round(F.avg("value"), 9).alias("p_value"))
    family, role = F.when(F.col("name").startswith("attention"), "ATTENTION").otherwise("OTHER"), F.when(F.col("seed") == 13, "SECONDARY").otherwise("PRIMARY")
    p = p.withColumns({"family": family, "role": role, "__order": F.concat("name", F.col("seed").cast("string"))})
    return rounded(inference.family_holm(p, "OTHER", order="__order").select("name", "seed", "p_value", "adjusted_p"), "adjusted_p")


@CATALOG.query(
    "i19_one_sample_report",
    f"""WITH {_DIFFS}, k AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS r FROM diffs WHERE diff IS NOT NULL),
    z AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS r FROM diffs WHERE diff <> 0)
    SELECT count(*) AS n, count_if(diff = 0) AS n_zero, coalesce(sum(r) FILTER (diff > 0), 0) AS r_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS r_minus, round(avg(diff), 9) AS mean, round(quantile_cont(diff, 0.5), 9) AS median,
        (SELECT round(coalesce((coalesce(sum(r) FILTER (diff > 0), 0) - coalesce(sum(r) FILTER (diff < 0), 0)) / sum(r), 0), 9) FROM z) AS rank_biserial FROM k""",
)
def i19(spark: SparkSession, directory: str) -> DataFrame:
    """Commit values against 0: test, effect size and summary in one row."""
    out = inference.one_sample_report(diffs(spark, directory))
    return rounded(out.select("n", "n_zero", "r_plus", "r_minus", "mean", "median", "rank_biserial"), "mean", "median", "rank_biserial")


@CATALOG.query(
    "i08_expanded_draw",
    f"""WITH {VALUES}, n AS (SELECT commit_id, row_number() OVER (ORDER BY substr(sha256(commit_id), 1, 3), commit_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT commit_id FROM v) u),
    d AS (SELECT ('0x' || substr(sha256('DRAW|' || k), 1, 8))::BIGINT % (SELECT max(n) FROM n) AS i FROM range(50) AS g(k))
    SELECT v.commit_id, v.method, v.seed, count(*) AS times FROM d JOIN n USING (i) JOIN v USING (commit_id) GROUP BY 1, 2, 3""",
)
def i08(spark: SparkSession, directory: str) -> DataFrame:
    """50 commits drawn with replacement, each with all its rows of methods and seeds."""
    v = values(spark, directory).select("commit_id", "method", "seed")
    places = numbered(v.select("commit_id").distinct(), "commit_id", "i")
    draws = F.broadcast(spark.range(50).select(ids.seed(F.lit("DRAW"), F.col("id").cast("string"), modulus=None).alias("h")))
    size = places.agg(F.max("n").alias("m"))
    at = draws.join(F.broadcast(size)).select((F.col("h") % F.col("m")).alias("i"))  # 50 draws, one size
    return inference.expand_draw(at.join(places, "i").select("commit_id"), v, "commit_id").groupBy("commit_id", "method", "seed").agg(F.count(F.lit(1)).alias("times"))


_CELLS = "count_if(score >= t AND y = 1)::DOUBLE AS tp, count_if(score >= t AND y = 0)::DOUBLE AS fp, count_if(score < t AND y = 1)::DOUBLE AS fn, count_if(score < t AND y = 0)::DOUBLE AS tn"


@CATALOG.query(
    "i28_split_metrics",
    f"""WITH {_RISK}, c AS (SELECT method, t AS threshold, {_CELLS}, avg((score - y) ** 2) AS brier FROM risk, (VALUES (0.7::DOUBLE), (0.5::DOUBLE)) AS v(t) GROUP BY 1, 2)
    SELECT method, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(brier, 9) AS brier FROM c""",
)
def i28(spark: SparkSession, directory: str) -> DataFrame:
    """The bundle of a split at its frozen threshold and at 0.5."""
    out = classify.metrics_bundle(risk(spark, directory), [0.7, 0.5], ["method"])
    return rounded(out.select("method", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "brier"), "precision", "recall", "brier")


_TWO = f"""{VALUES}, w2 AS (SELECT commit_id, avg(CASE WHEN method = 'grad_x_input' THEN value END) AS x, avg(CASE WHEN method = 'integrated_gradients' THEN value END) AS y FROM v GROUP BY 1 HAVING x IS NOT NULL AND y IS NOT NULL),
    k AS (SELECT x, y, abs(x - y) AS d, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM w2)"""


def two(spark: SparkSession, directory: str) -> DataFrame:
    mean = lambda m, n: F.avg(F.when(F.col("method") == m, F.col("value"))).alias(n)
    rows = values(spark, directory).groupBy("commit_id").agg(mean("grad_x_input", "x"), mean("integrated_gradients", "y"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL").withColumn("d", F.abs(F.col("x") - F.col("y")))


@CATALOG.query(
    "i15_estimand_profile",
    f"""WITH {_TWO} SELECT count(*) AS n, round(avg(d), 7) AS mean, round(quantile_cont(d, 0.5), 7) AS p50, round(quantile_cont(d, 0.9), 7) AS p90, round(quantile_cont(d, 0.95), 7) AS p95, round(avg((sign(x) = sign(y))::INT), 7) AS sign_agreement,
    round((avg(x * y) - avg(x) * avg(y)) / sqrt((avg(x * x) - avg(x) ** 2) * (avg(y * y) - avg(y) ** 2)), 5) AS pearson, round((avg(rx * ry) - avg(rx) * avg(ry)) / sqrt((avg(rx * rx) - avg(rx) ** 2) * (avg(ry * ry) - avg(ry) ** 2)), 5) AS spearman FROM k""",
)
def i15(spark: SparkSession, directory: str) -> DataFrame:
    """Two estimates of a commit's value: how far apart they are, in sign, in line and in rank."""
    rows = two(spark, directory)
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    same = F.avg((F.signum("x") == F.signum("y")).cast("double"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), q.alias("q"), same.alias("sign_agreement"), inference.guarded_corr(F.col("x"), F.col("y")).alias("pearson"))
    ranked = inference.spearman(rows.withColumn("one", F.lit(1)), ["one"], "x", "y").select(F.col("rho").alias("spearman"))
    out = out.join(ranked)  # one row each
    seven = {c: F.round(x, 7) for c, x in (("mean", F.col("mean")), ("p50", F.col("q")[0]), ("p90", F.col("q")[1]), ("p95", F.col("q")[2]), ("sign_agreement", F.col("sign_agreement")))}
    return out.withColumns(seven).withColumns({c: F.round(c, 5) for c in ("pearson", "spearman")}).drop("q")


@CATALOG.query(
    "o15_difference_gate",
    f"""WITH {_TWO}, g AS (SELECT avg(d) AS mean, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.95) AS p95, max(d) AS max FROM k)
    SELECT round(mean, 7) AS mean, round(median, 7) AS median, round(p95, 7) AS p95, round(max, 7) AS max, CASE WHEN mean <= 0.1 AND p95 <= 0.5 AND max <= 1 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g""",
)
def o15(spark: SparkSession, directory: str) -> DataFrame:
    out = inference.difference_gate(two(spark, directory), "d", 0.1, 0.5, 1.0)
    return out.withColumns({c: F.round(c, 7) for c in ("mean", "median", "p95", "max")})


@CATALOG.query(
    "o16_outcome_strata",
    f"""WITH {_RISK}, m AS (SELECT commit_id, max(y) AS y, (2 * sum((score >= 0.7)::INT) >= count(*))::INT AS vote, avg(score) AS value FROM risk GROUP BY 1 HAVING count(*) >= 2)
    SELECT CASE WHEN vote = 1 THEN 'TP' ELSE 'FN' END AS outcome, count(*) AS n, round(avg(value), 7) AS mean, round(quantile_cont(value, 0.5), 7) AS median FROM m WHERE y = 1 GROUP BY 1""",
)
def o16(spark: SparkSession, directory: str) -> DataFrame:
    """Positives by whether most seeds or methods hit them."""
    rows = risk(spark, directory).withColumn("vote", (F.col("score") >= 0.7).cast("int"))
    votes = classify.majority(rows, ["commit_id"], "vote").join(rows.groupBy("commit_id").agg(F.max("y").alias("y"), F.avg("score").alias("value")), "commit_id").where("y = 1")
    kind = classify.outcome(F.col("y"), F.col("majority") == 1).alias("outcome")
    return votes.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 7).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 7).alias("median"))


@CATALOG.query(
    "c17_rank_spearman",
    f"""WITH {SCORES}, a AS (SELECT commit_id, seed, region_id, rank() OVER (PARTITION BY commit_id, seed ORDER BY abs(score)) + (count(*) OVER (PARTITION BY commit_id, seed, abs(score)) - 1) / 2 AS r, count(*) OVER (PARTITION BY commit_id, seed) AS n FROM scores WHERE method = 'attention_last'),
    o AS (SELECT commit_id, seed, region_id, rank() OVER (PARTITION BY commit_id, seed ORDER BY abs(score)) + (count(*) OVER (PARTITION BY commit_id, seed, abs(score)) - 1) / 2 AS r, count(*) OVER (PARTITION BY commit_id, seed) AS n FROM scores WHERE method = 'occlusion_line'),
    j AS (SELECT commit_id, seed, a.r AS x, o.r AS y, a.n AS na, o.n AS nb FROM a JOIN o USING (commit_id, seed, region_id)) SELECT commit_id, seed, count(*) AS n,
    round(CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN (avg(x * y) - avg(x) * avg(y)) / sqrt((avg(x * x) - avg(x) ** 2) * (avg(y * y) - avg(y) ** 2)) END, 5) AS rho FROM j GROUP BY 1, 2 HAVING count(*) = max(na) AND count(*) = max(nb)""",
)
def c17(spark: SparkSession, directory: str) -> DataFrame:
    """Rank agreement of attention and occlusion where both have the same lines."""
    rows = scores(spark, directory).where("method IN ('attention_last', 'occlusion_line')").select("commit_id", "seed", "region_id", "method", F.abs("score").alias("m"))
    out = inference.rank_agreement(rows, ["commit_id", "seed"], "region_id", "method", "m", "attention_last", "occlusion_line")
    return out.withColumn("rho", F.round("rho", 5))


@CATALOG.query(
    "j02_random_regions",
    f"""WITH {LINES}, k AS (SELECT commit_id, line_id, position, row_number() OVER (PARTITION BY commit_id ORDER BY sha256('J02|' || line_id), line_id) AS i FROM lines WHERE line_id IS NOT NULL)
    SELECT commit_id, line_id, (row_number() OVER (PARTITION BY commit_id ORDER BY position, line_id))::INT AS place FROM k WHERE i <= 5""",
)
def j02(spark: SparkSession, directory: str) -> DataFrame:
    """Five lines of every commit without replacement, in the order of the commit."""
    rows = lines(spark, directory).where(F.col("line_id").isNotNull()).select("commit_id", "line_id", "position")
    return cohorts.random_regions(rows, ["commit_id"], 5, "line_id", ["position", "line_id"], "J02").select("commit_id", "line_id", "place")


@CATALOG.query("j03_length_matched_draws")
def j03(spark: SparkSession, directory: str) -> DataFrame:
    """For every commit a random set of a fifth of its lines with about a fifth of its tokens."""
    rows = lines(spark, directory).where(F.col("line_id").isNotNull() & (F.col("tokens") > 0)).select("commit_id", F.col("line_id").alias("region_id"), "tokens")
    size = rows.groupBy("commit_id").agg(F.ceil(F.sum("tokens") * F.lit(0.2)).alias("target"), F.ceil(F.count(F.lit(1)) * F.lit(0.2)).alias("k"))
    return cohorts.length_matched_draws(rows.join(size, "commit_id"), ["commit_id"], "k", "target")


_MARK = " + ".join(f"contains(text, '{m}')::INT" for m in MARKERS)


@CATALOG.query("j09_leakage_sample", f"SELECT doc_id, {_MARK} AS n_markers FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY sha256('J09|' || doc_id), doc_id LIMIT 100) d")
def j09(spark: SparkSession, directory: str) -> DataFrame:
    """100 random texts, each with the number of forbidden markers in it."""
    rows = table(spark, directory, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", F.col("doc_id").cast("string").alias("k"))
    few = cohorts.hashed_sample(rows, 100, "k", "J09")
    return few.select("doc_id", F.size(lf.markers_in(F.col("text"), MARKERS)).alias("n_markers"))


@CATALOG.query(
    "o08_size_examples",
    f"""WITH {LINES}, n AS (SELECT commit_id, count(*) AS n FROM lines WHERE change_type <> 'context' GROUP BY 1), b AS (SELECT *, CASE WHEN n <= 20 THEN 'small' WHEN n <= 80 THEN 'medium' ELSE 'large' END AS bucket FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY commit_id) AS i FROM b) SELECT commit_id, bucket, n FROM k WHERE i <= 2""",
)
def o08(spark: SparkSession, directory: str) -> DataFrame:
    n = lines(spark, directory).where("change_type <> 'context'").groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return cohorts.bucket_examples(n, "n", {"small": 20, "medium": 80}, "large", 2).select("commit_id", "bucket", "n")


@CATALOG.query(
    "e19_cohort_manifest",
    f"""WITH {COMMITS}, m AS (SELECT * FROM commits WHERE split = 'valid' AND is_positive AND tokens IS NOT NULL AND project IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY tokens, commit_id) - 1 AS k, count(*) OVER () AS n FROM m),
    q AS (SELECT *, least(3, k // greatest(1, n // 4))::INT AS quartile FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY project, quartile ORDER BY k) = 1 AS lead FROM q),
    p AS (SELECT *, (row_number() OVER (ORDER BY NOT lead, CASE WHEN lead THEN project ELSE '' END, quartile, CASE WHEN lead THEN '' ELSE commit_id END) - 1)::INT AS place FROM l)
    SELECT count(*) AS n, count(DISTINCT project) AS n_projects, sha256(coalesce(string_agg(commit_id, chr(10) ORDER BY commit_id), '')) AS manifest FROM p WHERE place < 64""",
)
def e19(spark: SparkSession, directory: str) -> DataFrame:
    """The rehearsal cohort with the digest of its sorted ids."""
    cohort = cohorts.rehearsal_cohort(members(spark, directory).where("split = 'valid' AND is_positive AND project IS NOT NULL"), 64)
    return cohorts.manifest(cohort)


@CATALOG.query(
    "d34_value_profile",
    """SELECT author, count(*) AS n, count(DISTINCT source) AS n_sources, bool_or(lang IS NULL) AS any_unknown, max(k) AS n_most_frequent FROM (SELECT *, count(*) OVER (PARTITION BY author, source) AS k FROM documents) d GROUP BY 1""",
)
def d34(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, distinct values, an any() and the largest cell of a nested histogram per group, from counts per cell."""
    cells = table(spark, directory, "documents").groupBy("author", "source").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("lang").isNull()).alias("u"))
    return cells.groupBy("author").agg(F.sum("k").alias("n"), F.count("source").alias("n_sources"), F.bool_or("u").alias("any_unknown"), F.max("k").alias("n_most_frequent"))


@CATALOG.query("audit_p16_repeated_ids", f"WITH {LINES} SELECT line_id, count(*) AS n FROM lines WHERE line_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def p16(spark: SparkSession, directory: str) -> DataFrame:
    """Line ids that are not unique, as rows."""
    return lines(spark, directory).where(F.col("line_id").isNotNull()).groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@CATALOG.query(
    "audit_p24_category_totals",
    f"WITH {LINES} SELECT upper(change_type) || '_CODE' AS category, count(*) AS n, sum(tokens)::BIGINT AS n_tokens, count(DISTINCT commit_id) AS n_commits FROM lines GROUP BY 1",
)
def p24(spark: SparkSession, directory: str) -> DataFrame:
    """Maps of category to tokens per commit, added up over the commits."""
    per = lines(spark, directory).groupBy("commit_id", F.concat(F.upper("change_type"), F.lit("_CODE")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    maps = per.groupBy("commit_id").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "t")))).alias("m"))
    flat = maps.select("commit_id", F.explode("m").alias("category", "v"))
    return flat.groupBy("category").agg(F.sum("v.n").alias("n"), F.sum("v.t").alias("n_tokens"), F.count(F.lit(1)).alias("n_commits"))


@CATALOG.query(
    "audit_p25_gate",
    f"""WITH {LINES} SELECT count(*) AS n, count_if(line_id IS NULL AND change_type <> 'context') AS n_without_id, count(line_id) - count(DISTINCT line_id) AS n_repeated, count_if(status NOT IN ('POSITIVE', 'NEGATIVE', 'NOT_IN_RQ1_UNIVERSE')) AS n_unknown,
    count_if(line_id IS NULL AND change_type <> 'context') = 0 AND count(line_id) = count(DISTINCT line_id) AS passed FROM lines""",
)
def p25(spark: SparkSession, directory: str) -> DataFrame:
    """A conjunction of assertions on counts, in one row."""
    rows = lines(spark, directory)
    named = F.col("line_id").isNotNull()
    checks = {
        "n_without_id": F.count_if(~named & (F.col("change_type") != "context")), "n_repeated": F.count("line_id") - F.count_distinct("line_id"),
        "n_unknown": F.count_if(~F.col("status").isin("POSITIVE", "NEGATIVE", "NOT_IN_RQ1_UNIVERSE")),
    }
    out = rows.agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in checks.items()))
    return out.withColumn("passed", (F.col("n_without_id") == 0) & (F.col("n_repeated") == 0))


@CATALOG.query(
    "h06_line_scalars",
    f"""WITH {LINES} SELECT line_id, commit_id || '|' || path || '|' || hunk_ordinal || '|' || change_type || '|' || coalesce(old_lineno::VARCHAR, 'NA') || '|' || coalesce(new_lineno::VARCHAR, 'NA') || '|' || occurrence_index AS older_id,
        commit_id || '|' || path || '|CHANGED_ONLY|h' || hunk_ordinal AS hunk_id, path LIKE '%.java' AND path <> '' AS is_code FROM lines WHERE line_id IS NOT NULL""",
)
def h06(spark: SparkSession, directory: str) -> DataFrame:
    """The older line id (h08), the hunk id (h09) and the kind of file of every line."""
    c = F.col
    rows = lines(spark, directory).where(c("line_id").isNotNull())
    older = ids.hunk_line_id(c("commit_id"), c("path"), c("hunk_ordinal"), c("change_type"), c("old_lineno"), c("new_lineno"), c("occurrence_index"))
    return rows.select("line_id", older.alias("older_id"), ids.hunk_id(c("commit_id"), c("path"), "CHANGED_ONLY", c("hunk_ordinal")).alias("hunk_id"), lf.is_code_file(c("path")).alias("is_code"))


@CATALOG.query(
    "h45_formatted_scalars",
    f"""WITH {_RISK} SELECT method, commit_id, CASE WHEN score < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', score) END AS p_text, CASE WHEN score > 0.5 THEN 'FIRST' ELSE 'SECOND' END AS better FROM risk""",
)
def h45(spark: SparkSession, directory: str) -> DataFrame:
    """Scores as they would be printed as p, and which side a difference favours (h46)."""
    s = F.col("score")
    return risk(spark, directory).select("method", "commit_id", sf.format_p(s).alias("p_text"), sf.better_direction(s - 0.5, "HIGHER_BETTER").alias("better"))


@CATALOG.query(
    "h47_parent_lists",
    """SELECT doc_id, len(list_filter(list_transform(CASE WHEN contains(author, ',') THEN string_split(author, ',') ELSE regexp_split_to_array(trim(author), '\\s+') END, lambda x: trim(x)), lambda x: x <> ''))::INT AS n FROM documents WHERE author IS NOT NULL AND lower(trim(author)) <> 'nan'""".replace("\\\\", "\\"),
)
def h47(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").where(F.col("author").isNotNull() & (F.lower(F.trim("author")) != "nan"))
    return rows.select("doc_id", F.size(lf.parent_hashes(F.col("author"))).alias("n"))


@CATALOG.query(
    "h49_length_check",
    f"""WITH {LINES}, a AS (SELECT commit_id, count(*) AS n FROM lines WHERE change_type = 'added' GROUP BY 1), p AS (SELECT lower(regexp_replace(commit_id, '^\\s+|\\s+$', '', 'g')) AS commit_id, count(*) AS m FROM policy_a_rows GROUP BY 1)
    SELECT count(*) AS n, count_if(n = m) AS n_equal, count_if(n > m) AS n_longer, count_if(n < m) AS n_shorter FROM a JOIN p USING (commit_id)""".replace("\\\\", "\\"),
)
def h49(spark: SparkSession, directory: str) -> DataFrame:
    """Added lines against label rows: commits in which both are as many."""
    from sparline.plans.lineage_queries import pol

    a = lines(spark, directory).where("change_type = 'added'").groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    p = pol(spark, directory).groupBy("commit_id").agg(F.count(F.lit(1)).alias("m"))
    n, m = F.col("n"), F.col("m")
    return a.join(p, "commit_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(n == m).alias("n_equal"), F.count_if(n > m).alias("n_longer"), F.count_if(n < m).alias("n_shorter"))


@CATALOG.query(
    "g06_signature_overlap",
    f"""WITH {LINES} SELECT commit_id, path, hunk_ordinal, line_ordinal, trim(regexp_replace(a, '\\s+', ' ', 'g')) = trim(regexp_replace(b, '\\s+', ' ', 'g')) AS same FROM (SELECT *, raw_text AS a, lead(raw_text) OVER (PARTITION BY commit_id, path, hunk_ordinal ORDER BY line_ordinal) AS b FROM lines) x
    WHERE a IS NOT NULL AND b IS NOT NULL""".replace("\\\\", "\\"),
)
def g06(spark: SparkSession, directory: str) -> DataFrame:
    """Whether a line and the next one share a form, here that of collapsed white space."""
    w = Window.partitionBy("commit_id", "path", "hunk_ordinal").orderBy("line_ordinal")
    rows = lines(spark, directory).withColumn("b", F.lead("raw_text").over(w)).where(F.col("raw_text").isNotNull() & F.col("b").isNotNull())
    forms = lambda c: F.array(lf.collapse(F.col(c)))
    return rows.select("commit_id", "path", "hunk_ordinal", "line_ordinal", F.arrays_overlap(forms("raw_text"), forms("b")).alias("same"))


@CATALOG.query(
    "m04_learning_rates",
    "SELECT k AS step, round(CASE WHEN k < 10 THEN k / 10.0::DOUBLE ELSE greatest(0, (100 - k) / 90.0::DOUBLE) END, 9) AS rate FROM range(121) AS g(k)",
)
def m04(spark: SparkSession, directory: str) -> DataFrame:
    return spark.range(121).select(F.col("id").alias("step"), F.round(structure.warmup_rate(F.col("id"), 10, 100), 9).alias("rate"))


@CATALOG.query(
    "b06_valid_faithfulness",
    f"""WITH {_UNITS}, f AS (SELECT commit_id, method, seed, count(*) AS n, round(avg(abs(score)), 9) AS aopc FROM scores GROUP BY 1, 2, 3), g AS (SELECT *, CASE WHEN n < 2 THEN 'NO_PREFIX' ELSE 'OK' END AS fcode, CASE WHEN n >= 3 THEN aopc END AS a FROM f)
    SELECT g.method, count(*) AS n, count_if(fcode = 'OK' AND a IS NOT NULL AND u.status = 'DONE' AND u.code = 'OK') AS n_valid FROM g LEFT JOIN units u USING (commit_id, method, seed) GROUP BY 1""",
)
def b06(spark: SparkSession, directory: str) -> DataFrame:
    """Curves that may be used: made without fault, of a valid attribution, with a value."""
    n = F.count(F.lit(1))
    f = scores(spark, directory).groupBy(*UNIT).agg(n.alias("n"), F.avg(F.abs("score")).alias("aopc"))
    f = f.select(*UNIT, F.when(F.col("n") < 2, "NO_PREFIX").otherwise("OK").alias("faith_code"), F.when(F.col("n") >= 3, F.col("aopc")).alias("aopc"))
    both = f.join(units(spark, directory), UNIT, "left")
    ok = runs.faithfulness_is_valid(F.col("faith_code"), F.col("aopc"), F.col("status"), F.col("code"), F.col("method"))
    return both.groupBy("method").agg(n.alias("n"), F.count_if(ok).alias("n_valid"))


REQUIRED = ("experiment_id", "model_id", "model_seed", "commit_id", "method", "granularity", "region_id", "raw_score", "rank_score", "rq1_status", "schema_version")


@CATALOG.query("b19_required_fields", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) - count({c}) AS n_missing FROM attribution_rows" for c in REQUIRED))
def b19(spark: SparkSession, directory: str) -> DataFrame:
    """Rows without each required field, in one pass."""
    return protocol.missing_fields(table(spark, directory, "attribution_rows"), REQUIRED)


@CATALOG.query("b18_prompt_accounted", f"WITH {LINES} SELECT commit_id, bool_or(change_type = 'context') AS accounted FROM lines GROUP BY 1")
def b18(spark: SparkSession, directory: str) -> DataFrame:
    """Whether a commit's categories hold one of those that must be accounted for."""
    held = lines(spark, directory).groupBy("commit_id").agg(F.collect_set(F.upper("change_type")).alias("categories"))
    return held.select("commit_id", F.arrays_overlap("categories", F.array(F.lit("PROMPT_TEMPLATE"), F.lit("SPECIAL"), F.lit("CONTEXT"))).alias("accounted"))


@CATALOG.query("b20_unknown_categories", "SELECT DISTINCT canonical_path, 'UNKNOWN' AS category FROM hunk_specs")
def b20(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "hunk_specs").select("canonical_path").distinct().withColumn("category", lf.file_category(F.col("canonical_path")))


@CATALOG.query("f06_ordered_units", f"WITH {_UNITS} SELECT commit_id || '|' || seed || '|' || method || '|LINE' AS unit_id, ((row_number() OVER (ORDER BY commit_id || '|' || seed || '|' || method || '|LINE') - 1) // 64)::BIGINT AS batch FROM units")
def f06(spark: SparkSession, directory: str) -> DataFrame:
    """Units in the order of their ids, in batches of 64 (f08), numbered by range partitions instead of one sort."""
    unit_id = F.concat_ws("|", "commit_id", F.col("seed").cast("string"), "method", F.lit("LINE")).alias("unit_id")
    return runs.ordered_batches(units(spark, directory).select(unit_id), "unit_id", 64)


@CATALOG.query("f07_latest_run", "SELECT max(experiment_id) AS run FROM attribution_rows WHERE starts_with(experiment_id, 'e')")
def f07(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "attribution_rows").where(F.col("experiment_id").startswith("e")).agg(F.max("experiment_id").alias("run"))


@CATALOG.query(
    "n07_compute_estimate",
    f"""WITH {SCORES}, k AS (SELECT count(DISTINCT commit_id)::DOUBLE AS c, count(DISTINCT region_id)::DOUBLE / count(DISTINCT commit_id) AS r FROM scores)
    SELECT m AS method, round(CASE WHEN starts_with(m, 'attention') THEN c WHEN m = 'integrated_gradients' THEN c * 32 WHEN m = 'occlusion_line' THEN c * (1 + r) ELSE c END, 6) AS forward, round(CASE WHEN m IN ('gradient', 'grad_x_input') THEN c WHEN m = 'integrated_gradients' THEN c * 32 ELSE 0 END, 6) AS backward
    FROM k, (VALUES {", ".join(f"('{m}')" for m in METHODS)}) AS v(m)""",
)
def n07(spark: SparkSession, directory: str) -> DataFrame:
    """Forward and backward passes with 32 steps of a path."""
    k = scores(spark, directory).agg(F.count_distinct("commit_id").cast("double").alias("c"), F.count_distinct("region_id").cast("double").alias("r"))
    rows = k.select("c", "r", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    forward, backward = runs.compute_passes(F.col("c"), F.col("r") / F.col("c"), F.col("method"), 32)
    return rows.select("method", F.round(forward, 6).alias("forward"), F.round(backward, 6).alias("backward"))


@CATALOG.query(
    "o13_label_profile",
    f"""WITH {LINES}, k AS (SELECT commit_id, count_if(status = 'POSITIVE') AS p, count(*) AS n FROM lines WHERE change_type <> 'context' GROUP BY 1)
    SELECT count(*) AS n_commits, sum(n)::BIGINT AS n_lines, count_if(p > 0) AS n_with_positive, max(p) AS max_positive, round(quantile_cont(p, 0.5), 6) AS median_positive, round(quantile_cont(n, 0.9), 6) AS p90_lines FROM k""",
)
def o13(spark: SparkSession, directory: str) -> DataFrame:
    """Labels per commit, as a profile (o11, o12: the same of other tables, see d21, d26, d27)."""
    k = lines(spark, directory).where("change_type <> 'context'").groupBy("commit_id").agg(F.count_if(F.col("status") == "POSITIVE").alias("p"), F.count(F.lit(1)).alias("n"))
    return k.agg(
        F.count(F.lit(1)).alias("n_commits"), F.sum("n").alias("n_lines"), F.count_if(F.col("p") > 0).alias("n_with_positive"), F.max("p").alias("max_positive"),
        F.round(F.percentile("p", F.lit(0.5)), 6).alias("median_positive"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90_lines"),
    )


@CATALOG.query(
    "o17_headline",
    f"""WITH {VALUES}, c AS (SELECT method, commit_id, avg(value) AS value FROM v GROUP BY 1, 2 HAVING count(*) >= 2), m2 AS (SELECT method, round(avg(value), 6) AS mean, count(*) AS n FROM c GROUP BY 1)
    SELECT method, n, mean, (rank() OVER (ORDER BY mean DESC))::INT AS place FROM m2""",
)
def o17(spark: SparkSession, directory: str) -> DataFrame:
    """Methods by their mean, best first."""
    out = rounded(inference.two_level_mean(values(spark, directory), ["method"]), "mean").withColumn("mean", F.round("mean", 6))
    return out.select("method", F.col("n_commits").alias("n"), "mean", F.rank().over(Window.orderBy(F.desc("mean"))).alias("place"))  # a row per method
