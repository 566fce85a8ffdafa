"""Profiles, consistency checks, job ledgers and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions import ids, scores as sf
from sparline.functions.text import commit_key, project_key, split_key
from sparline.operators import audit, kernels, runs
from sparline.operators.classify import score_distribution
from sparline.plans.base import COMMITS, LINES, SCORES, UNIT, commits, lines, scores, settled, settled_sql
from sparline.plans.catalog import Catalog
from sparline.plans.problem_queries import _PROJECT
from sparline.sources.parquet import table
from sparline.streaming.ledger import hourly_counts

CATALOG = Catalog()
_ID = r"lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g'))"
_SPLIT0 = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g'))"
_SPLIT = f"""CASE WHEN {_SPLIT0} IN ('train', 'training', 'tr', 'trn') THEN 'train' WHEN {_SPLIT0} IN ('valid', 'validation', 'val', 'dev') THEN 'valid'
    WHEN {_SPLIT0} IN ('test', 'testing', 'tst', 'te') THEN 'test' END"""
_META = f"meta AS (SELECT {_ID} AS commit_id, {_PROJECT} AS project, {_SPLIT} AS split, visible_token_count AS tokens, is_positive, commit_message AS message, author_date, ingested_at, removed_at FROM commit_meta)"


def meta(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "commit_meta").select(
        commit_key(F.col("commit_id")).alias("commit_id"), project_key(F.col("project")).alias("project"), split_key(F.col("split")).alias("split"),
        F.col("visible_token_count").alias("tokens"), "is_positive", F.col("commit_message").alias("message"), "author_date", "ingested_at", "removed_at",
    )


@CATALOG.query(
    "d26_duplicate_report",
    f"""WITH {_META}, k AS (SELECT commit_id, count(*) AS n FROM meta GROUP BY 1) SELECT sum(n)::BIGINT AS n, count_if(commit_id IS NOT NULL) AS n_unique,
    coalesce(sum(n) FILTER (commit_id IS NULL), 0)::BIGINT AS n_null, count_if(commit_id IS NOT NULL AND n > 1) AS n_duplicated, coalesce(sum(n - 1) FILTER (commit_id IS NOT NULL), 0)::BIGINT AS n_extra FROM k""",
)
def d26(spark: SparkSession, directory: str) -> DataFrame:
    return audit.duplicate_report(meta(spark, directory), "commit_id")


@CATALOG.query("d27_frequencies", "SELECT author, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, author NULLS LAST LIMIT 50")
def d27(spark: SparkSession, directory: str) -> DataFrame:
    return audit.frequencies(table(spark, directory, "documents"), "author", 50)


@CATALOG.query(
    "d21_quantiles",
    """SELECT source, count(*) AS n, min(length(text)) AS min, max(length(text)) AS max, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text)::DOUBLE, 0.25), 6) AS p25,
    round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(length(text)::DOUBLE, 0.75), 6) AS p75, round(quantile_cont(length(text)::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(length(text)::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(length(text)::DOUBLE, 0.99), 6) AS p99
    FROM documents WHERE text IS NOT NULL GROUP BY 1""",
)
def d21(spark: SparkSession, directory: str) -> DataFrame:
    out = score_distribution(table(spark, directory, "documents").select("source", F.length("text").alias("n_")), ["source"], "n_", (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "p50", "p75", "p90", "p95", "p99")})


@CATALOG.query(
    "g04_split_sets",
    f"""WITH {_META}, k AS (SELECT commit_id, bool_or(coalesce(split = 'train', false)) AS train, bool_or(coalesce(split = 'valid', false)) AS valid, bool_or(coalesce(split = 'test', false)) AS test
    FROM meta WHERE commit_id IS NOT NULL GROUP BY 1) SELECT train, valid, test, count(*) AS n_items FROM k GROUP BY 1, 2, 3""",
)
def g04(spark: SparkSession, directory: str) -> DataFrame:
    return audit.set_counts(meta(spark, directory), "commit_id", {s: F.col("split") == s for s in ("train", "valid", "test")})


@CATALOG.query(
    "audit_p09_project_sets",
    f"""WITH {_META}, k AS (SELECT project, bool_or(coalesce(split = 'train', false)) AS train, bool_or(coalesce(split = 'valid', false)) AS valid, bool_or(coalesce(split = 'test', false)) AS test
    FROM meta WHERE project IS NOT NULL GROUP BY 1) SELECT train, valid, test, count(*) AS n_items FROM k GROUP BY 1, 2, 3""",
)
def p09(spark: SparkSession, directory: str) -> DataFrame:
    return audit.set_counts(meta(spark, directory), "project", {s: F.col("split") == s for s in ("train", "valid", "test")})


_SIDES = rf"""sides AS (SELECT DISTINCT commit_id, change_type, raw_text AS text, 'A' AS side FROM lines WHERE change_type IN ('added', 'deleted') AND raw_text IS NOT NULL
    UNION SELECT DISTINCT {_ID}, lower(regexp_replace(changed_type, '^\s+|\s+$', '', 'g')), raw_changed_line, 'B' FROM policy_a_rows WHERE raw_changed_line IS NOT NULL)"""


def sides(spark: SparkSession, directory: str) -> DataFrame:
    a = lines(spark, directory).where(F.col("change_type").isin("added", "deleted") & F.col("raw_text").isNotNull())
    a = a.select("commit_id", "change_type", F.col("raw_text").alias("text"), F.lit("A").alias("side"))
    b = table(spark, directory, "policy_a_rows").where(F.col("raw_changed_line").isNotNull())
    kind = F.lower(F.regexp_replace("changed_type", r"^\s+|\s+$", ""))
    return a.unionAll(b.select(commit_key(F.col("commit_id")), kind, "raw_changed_line", F.lit("B")))


@CATALOG.query(
    "g02_set_equivalence",
    f"""WITH {LINES}, {_SIDES}, k AS (SELECT commit_id, change_type, text, count(*) AS n FROM sides GROUP BY 1, 2, 3),
    c AS (SELECT commit_id, count_if(n = 1 AND change_type = 'added') AS x, count_if(n = 1 AND change_type = 'deleted') AS y FROM k GROUP BY 1)
    SELECT commit_id, CASE WHEN x = 0 AND y = 0 THEN 'EXACT' WHEN x = 0 THEN 'ADDED' WHEN y = 0 THEN 'DELETED' ELSE 'MISMATCH' END AS equivalence FROM c""",
)
def g02(spark: SparkSession, directory: str) -> DataFrame:
    return audit.set_equivalence(sides(spark, directory), ["commit_id"], "text", "side", "change_type")


@CATALOG.query(
    "g07_multiset_equal",
    rf"""WITH {LINES}, u AS (SELECT commit_id, raw_text AS text, 1 AS a, 0 AS b FROM lines WHERE change_type = 'added' UNION ALL SELECT {_ID}, raw_changed_line, 0, 1 FROM policy_a_rows),
    k AS (SELECT commit_id, text, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2) SELECT commit_id, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, bool_and(a = b) AS equal FROM k GROUP BY 1""",
)
def g07(spark: SparkSession, directory: str) -> DataFrame:
    a = lines(spark, directory).where("change_type = 'added'").select("commit_id", F.col("raw_text").alias("text"))
    b = table(spark, directory, "policy_a_rows").select(commit_key(F.col("commit_id")).alias("commit_id"), F.col("raw_changed_line").alias("text"))
    return audit.multiset_equal(a, b, ["commit_id"], "text")


@CATALOG.query(
    "d32_collisions",
    """WITH k AS (SELECT canonical_line_id AS id, count(*) AS n FROM bridge_results GROUP BY 1) SELECT coalesce(sum(n) FILTER (id IS NOT NULL), 0)::BIGINT AS n_mapped,
    coalesce(sum(n) FILTER (id IS NULL), 0)::BIGINT AS n_unmapped, count_if(id IS NOT NULL) AS n_keys, count_if(id IS NOT NULL AND n > 1) AS n_colliding,
    coalesce(sum(n) FILTER (id IS NOT NULL AND n > 1), 0)::BIGINT AS n_rows_colliding FROM k""",
)
def d32(spark: SparkSession, directory: str) -> DataFrame:
    return audit.collisions(table(spark, directory, "bridge_results"), "canonical_line_id")


@CATALOG.query(
    "audit_p01_chronology",
    f"""WITH {_META}, k AS (SELECT project, {", ".join(f"min(author_date) FILTER (split = '{s}') AS {s}_first, max(author_date) FILTER (split = '{s}') AS {s}_last" for s in ("train", "valid", "test"))} FROM meta GROUP BY 1)
    SELECT *, train_last < valid_first AS train_before_valid, valid_last < test_first AS valid_before_test FROM k""",
)
def p01(spark: SparkSession, directory: str) -> DataFrame:
    return audit.chronology(meta(spark, directory), ["project"], "split", "author_date")


@CATALOG.query(
    "audit_p05_funnel",
    f"""WITH {_META} SELECT project, count(*) AS l0, count_if(split IS NOT NULL) AS l1, count_if(split IS NOT NULL AND coalesce(tokens > 0, false)) AS l2,
    count_if(split IS NOT NULL AND coalesce(tokens > 0, false) AND coalesce(is_positive, false)) AS l3 FROM meta GROUP BY 1""",
)
def p05(spark: SparkSession, directory: str) -> DataFrame:
    steps = [("l0", F.lit(True)), ("l1", F.col("split").isNotNull()), ("l2", F.col("tokens") > 0), ("l3", F.col("is_positive"))]
    return audit.funnel(meta(spark, directory), steps, ["project"])


@CATALOG.query(
    "audit_p03_alignment",
    rf"""WITH {_META}, x AS (SELECT DISTINCT commit_id AS id, split AS v FROM meta), y AS (SELECT DISTINCT lower(regexp_replace(commit_hash, '^\s+|\s+$', '', 'g')) AS id, {_SPLIT} AS v FROM excluded_commits_summary),
    m AS (SELECT x.id AS a, y.id AS b, x.v AS va, y.v AS vb FROM x FULL JOIN y ON x.id = y.id)
    SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS n_both, count_if(b IS NULL) AS n_first_only, count_if(a IS NULL) AS n_second_only, count_if(a IS NOT NULL AND b IS NOT NULL AND va IS DISTINCT FROM vb) AS n_different FROM m""",
)
def p03(spark: SparkSession, directory: str) -> DataFrame:
    b = table(spark, directory, "excluded_commits_summary").select(commit_key(F.col("commit_hash")).alias("commit_id"), split_key(F.col("split")).alias("split"))
    return audit.alignment(meta(spark, directory), b, "commit_id", "split")


@CATALOG.query("audit_p08_rates", f"WITH {_META} SELECT split, project, count(*) AS n, count_if(coalesce(is_positive, false)) AS n_true, round(avg(coalesce(is_positive, false)::INT::DOUBLE), 9) AS rate FROM meta GROUP BY 1, 2")
def p08(spark: SparkSession, directory: str) -> DataFrame:
    return audit.cross_rates(meta(spark, directory), ["split", "project"], F.col("is_positive")).withColumn("rate", F.round("rate", 9))


@CATALOG.query(
    "audit_p23_grouping_sets",
    f"""WITH {_META} SELECT split, project, grouping(split, project)::BIGINT AS grouping, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM meta GROUP BY GROUPING SETS ((split, project), (split), (project), ())""",
)
def p23(spark: SparkSession, directory: str) -> DataFrame:
    sets = [["split", "project"], ["split"], ["project"], []]
    return audit.grouping_rows(meta(spark, directory), sets, F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@CATALOG.query(
    "q03_neighbours",
    """SELECT row_id, lag(idx) OVER w AS previous, lead(idx) OVER w AS next, last_value(label IGNORE NULLS) OVER (PARTITION BY commit_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_before,
    first_value(label IGNORE NULLS) OVER (PARTITION BY commit_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS known_after FROM policy_a_rows WINDOW w AS (PARTITION BY commit_id ORDER BY row_id)""",
)
def q03(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "policy_a_rows")
    idx = audit.neighbours(rows, ["commit_id"], "row_id", "idx").select("row_id", "previous", "next")
    label = audit.neighbours(rows, ["commit_id"], "row_id", "label").select("row_id", "known_before", "known_after")
    return idx.join(label, "row_id")


@CATALOG.query(
    "d30_line_universe",
    f"""WITH {LINES} SELECT commit_id, count(*) AS n, count_if(status = 'POSITIVE') AS n_positive, count_if(status = 'NEGATIVE') AS n_negative, count_if(line_id IS NULL) AS n_context,
    count(DISTINCT path) AS n_files, count(DISTINCT line_id) = count(line_id) AS ids_unique FROM lines GROUP BY 1""",
)
def d30(spark: SparkSession, directory: str) -> DataFrame:
    s = F.col("status")
    return lines(spark, directory).groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "POSITIVE").alias("n_positive"), F.count_if(s == "NEGATIVE").alias("n_negative"), F.count_if(F.col("line_id").isNull()).alias("n_context"),
        F.count_distinct("path").alias("n_files"), (F.count_distinct("line_id") == F.count("line_id")).alias("ids_unique"),
    )


@CATALOG.query(
    "d33_mapping_completeness",
    """SELECT commit_id, count(*) AS n, count(canonical_line_id) AS n_mapped, round(count(canonical_line_id) * 100.0::DOUBLE / count(*), 9) AS percent, bool_and(canonical_line_id IS NOT NULL) AS complete FROM bridge_results GROUP BY 1""",
)
def d33(spark: SparkSession, directory: str) -> DataFrame:
    m = F.count("canonical_line_id")
    return table(spark, directory, "bridge_results").groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("n"), m.alias("n_mapped"), F.round(m * 100.0 / F.count(F.lit(1)), 9).alias("percent"), F.bool_and(F.col("canonical_line_id").isNotNull()).alias("complete")
    )


@CATALOG.query(
    "audit_p06_content_collisions",
    "WITH k AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) AS n_hashes, count_if(n > 1) AS n_repeated, sum(n)::BIGINT AS n_rows FROM k",
)
def p06(spark: SparkSession, directory: str) -> DataFrame:
    k = table(spark, directory, "documents").where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.count(F.lit(1)).alias("n_hashes"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("n").alias("n_rows"))


# Job ledger over the event stream: a unit is a user, its state follows from its events.
_LEDGER = """e AS (SELECT user_id, event_type, ts, event_id, value, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'PENDING' WHEN 'signup' THEN 'NONCONVERGED' ELSE 'FAILED' END AS status FROM events),
    l AS (SELECT user_id, arg_max(struct_pack(status := status, value := value, ts := ts), struct_pack(a := ts, b := event_id)) AS r FROM e GROUP BY 1),
    ledger AS (SELECT user_id, r.status AS status, r.value AS value, r.ts AS ts FROM l)"""


def event_status(event: F.Column) -> F.Column:
    return F.when(event == "purchase", "DONE").when(event == "click", "RUNNING").when(event == "view", "PENDING").when(event == "signup", "NONCONVERGED").otherwise("FAILED")


def ledger(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "events").select("user_id", "ts", "event_id", "value", event_status(F.col("event_type")).alias("status"))
    return runs.latest(rows, ["user_id"], ["ts", "event_id"])


@CATALOG.query("n03_latest_ledger", f"WITH {_LEDGER} SELECT user_id, status, value, ts FROM ledger")
def n03(spark: SparkSession, directory: str) -> DataFrame:
    return ledger(spark, directory).select("user_id", "status", "value", "ts")


@CATALOG.query(
    "n02_status_counts",
    f"""WITH {_LEDGER} SELECT s.status, count(l.user_id) AS n FROM (VALUES ('PENDING'), ('RUNNING'), ('DONE'), ('FAILED'), ('OOM'), ('NONCONVERGED'), ('SKIPPED')) AS s(status) LEFT JOIN ledger l USING (status) GROUP BY 1""",
)
def n02(spark: SparkSession, directory: str) -> DataFrame:
    return runs.status_counts(ledger(spark, directory))


_UNITS = f"""{SCORES}, units AS (SELECT commit_id, method, seed, 'DONE' AS status, CASE WHEN method = 'integrated_gradients' AND count(*) > 40 THEN 'IG_NONCONVERGED' WHEN count(*) > 60 THEN 'TRUNCATED' ELSE 'OK' END AS code FROM scores GROUP BY 1, 2, 3)"""


def units(spark: SparkSession, directory: str) -> DataFrame:
    n = F.count(F.lit(1))
    code = F.when((F.col("method") == "integrated_gradients") & (F.col("n") > 40), "IG_NONCONVERGED").when(F.col("n") > 60, "TRUNCATED").otherwise("OK")
    return scores(spark, directory).groupBy(*UNIT).agg(n.alias("n")).select(*UNIT, F.lit("DONE").alias("status"), code.alias("code"))


METHODS = ("attention_last", "attention_last4", "grad_x_input", "gradient", "integrated_gradients", "occlusion_line")
SEEDS = (13, 42, 73)
_GRID = f"""grid AS (SELECT commit_id, m AS method, s AS seed FROM commits, (VALUES {", ".join(f"('{m}')" for m in METHODS)}) AS a(m), (VALUES (13), (42), (73)) AS b(s))"""


@CATALOG.query("c20_pending_jobs", f"WITH {COMMITS}, {_UNITS}, {_GRID} SELECT method, seed, count(*) AS n_pending FROM grid g ANTI JOIN units u USING (commit_id, method, seed) GROUP BY 1, 2")
def c20(spark: SparkSession, directory: str) -> DataFrame:
    grid = runs.job_grid(commits(spark, directory), METHODS, SEEDS)
    return runs.pending(grid, units(spark, directory), UNIT).groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n_pending"))


@CATALOG.query("d10_missingness", f"WITH {_UNITS} SELECT method, seed, code, count(*) AS n FROM units GROUP BY 1, 2, 3")
def d10(spark: SparkSession, directory: str) -> DataFrame:
    return runs.missingness(units(spark, directory))


@CATALOG.query("d09_method_results", f"WITH {_UNITS} SELECT method, count(*) AS n, count_if(status = 'DONE') AS n_done, count_if(status IN ('FAILED', 'OOM')) AS n_failed, count_if(status = 'NONCONVERGED') AS n_nonconverged FROM units GROUP BY 1")
def d09(spark: SparkSession, directory: str) -> DataFrame:
    return runs.method_results(units(spark, directory))


@CATALOG.query("d36_complete_cases", f"WITH {_UNITS} SELECT commit_id FROM units GROUP BY 1 HAVING count(*) = 18 AND bool_and(code = 'OK')")
def d36(spark: SparkSession, directory: str) -> DataFrame:
    return runs.complete_cases(units(spark, directory), len(METHODS) * len(SEEDS))


@CATALOG.query("b05_valid_units", f"WITH {_UNITS} SELECT method, count(*) AS n, count_if(status = 'DONE' AND code = 'OK') AS n_valid FROM units GROUP BY 1")
def b05(spark: SparkSession, directory: str) -> DataFrame:
    valid = runs.is_valid(F.col("status"), F.col("code"), F.col("method"))
    return units(spark, directory).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"))


@CATALOG.query(
    "n06_cost",
    f"""WITH {SCORES}, k AS (SELECT method, count(DISTINCT commit_id)::DOUBLE AS c, count(DISTINCT region_id) / count(DISTINCT commit_id) AS r FROM scores GROUP BY 1)
    SELECT method, round(CASE WHEN starts_with(method, 'attention') THEN c WHEN method IN ('gradient', 'grad_x_input') THEN 2 * c WHEN method = 'integrated_gradients' THEN c * (100 + 0.25::DOUBLE * 200) ELSE c * (1 + r) END, 6) AS passes,
        ceil(c / 8)::BIGINT AS n_batches FROM k""",
)
def n06(spark: SparkSession, directory: str) -> DataFrame:
    k = scores(spark, directory).groupBy("method").agg(F.count_distinct("commit_id").alias("c"), F.count_distinct("region_id").alias("r"))
    passes = runs.passes(F.col("c"), F.col("method"), F.col("r") / F.col("c"), 50, 100, 0.25)
    return k.select("method", F.round(passes, 6).alias("passes"), runs.batches(F.col("c"), 8).alias("n_batches"))


# Kernels on the embeddings, with fixed weights of a linear scorer.
WEIGHTS = [round(((i * 37) % 17 - 8) / 40, 3) for i in range(64)]
_W = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
_DOT = f"list_sum(list_transform(list_zip(list_transform(embedding, lambda v: v::DOUBLE), {_W}), lambda p: p[1] * p[2]))"


@CATALOG.query("l03_gradient_x_input", f"SELECT vec_id, round({_DOT}, 6) AS score, {settled_sql('list_sum(list_transform(embedding, lambda v: v::DOUBLE))', 5)} AS total FROM embeddings")
def l03(spark: SparkSession, directory: str) -> DataFrame:
    w = F.array(*map(F.lit, WEIGHTS))
    rows = table(spark, directory, "embeddings").select("vec_id", F.round(kernels.gradient_x_input(F.col("embedding"), w), 6).alias("score"), kernels.gradient_sum(F.col("embedding")).alias("total"))
    return rows.withColumn("total", settled("total", 5))


@CATALOG.query("l06_integrated_gradient", f"SELECT vec_id, {settled_sql(f'1 / (1 + exp(-{_DOT})) - 0.5', 6)} AS attribution, true AS complete FROM embeddings")
def l06(spark: SparkSession, directory: str) -> DataFrame:
    """Twenty nodes; the SQL twin states what completeness demands, the change of the score."""
    out = kernels.integrated_gradient(table(spark, directory, "embeddings"), "vec_id", "embedding", WEIGHTS, 20)
    complete = sf.completeness_holds(F.col("error"), F.col("f_input") - F.col("f_baseline"))
    return out.select("vec_id", "attribution", complete.alias("complete")).withColumn("attribution", settled("attribution", 6))


@CATALOG.query(
    "l11_attention_pooling",
    """WITH m AS (SELECT label, vec_id % 4 AS layer, vec_id % 3 AS head, generate_subscripts(embedding, 1) - 1 AS key, unnest(embedding)::DOUBLE AS weight FROM embeddings),
    h AS (SELECT label, layer, key, max(weight) AS w FROM m WHERE layer > 1 GROUP BY 1, 2, 3) SELECT label, key::INT AS key, round(avg(w), 7) AS score FROM h GROUP BY 1, 2""",
)
def l11(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "embeddings")
    maps = e.select("label", (F.col("vec_id") % 4).alias("layer"), (F.col("vec_id") % 3).alias("head"), F.posexplode("embedding").alias("key", "weight")).withColumn("weight", F.col("weight").cast("double"))
    return kernels.pool_attention(maps, ["label"], 2, "max").withColumn("score", F.round("score", 7))


@CATALOG.query(
    "h22_probabilities",
    f"""WITH k AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, round(b - a, 9) AS contrast, round(1 / (1 + exp(a - b)), 9) AS p, true AS identity, 'NA' AS na FROM k""",
)
def h22(spark: SparkSession, directory: str) -> DataFrame:
    a, b = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return table(spark, directory, "embeddings").select(
        "vec_id", F.round(sf.risk_contrast(a, b), 9).alias("contrast"), F.round(sf.probability(a, b), 9).alias("p"), sf.odds_identity_holds(a, b).alias("identity"), sf.format_p(F.lit(None).cast("double")).alias("na"),
    )


@CATALOG.query(
    "h10_digests",
    """SELECT doc_id, sha1(('blob ' || octet_length(encode(text)) || chr(0) || text)) AS blob, sha256(text) AS digest, ('0x' || substr(sha256('O22|' || doc_id), 1, 2))::INT / 255.0::DOUBLE - 0.5 AS first_score FROM documents WHERE text IS NOT NULL""",
)
def h10(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").where(F.col("text").isNotNull())
    pseudo = ids.pseudo_scores(ids.digest(F.lit("O22"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", ids.blob_sha1(F.col("text").cast("binary")).alias("blob"), F.sha2("text", 256).alias("digest"), F.element_at(pseudo, 1).alias("first_score"))


@CATALOG.query(
    "s01_stream_hours",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
def s01(spark: SparkSession, directory: str) -> DataFrame:
    """Events per hour and type, counted by a stream under a watermark."""
    return hourly_counts(spark, directory).withColumns({"total": F.round("total", 6), "start": F.col("start").cast("timestamp_ntz")})
