"""The tables of the domain in the forms that the operators take, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions.text import commit_key, project_key, split_key, token_count
from sparline.sources.parquet import table

UNIT = ["commit_id", "method", "seed"]


def settled(c, digits: int = 7):
    """Rounded for comparison: a nudge keeps exact halves from falling either way with the order of a sum."""
    return F.round(F.col(c) + F.lit(3 * 10.0 ** -(digits + 2)), digits)


def settled_sql(x: str, digits: int = 7) -> str:
    return f"round(({x}) + 3e-{digits + 2}::DOUBLE, {digits})"


_ID = r"lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g'))"

#: DuckDB: one row per line, method and seed with a usable score; repeated deliveries count once.
SCORES = rf"""scores AS (
    SELECT {_ID} AS commit_id, method, model_seed AS seed, region_id, max(raw_score) AS score, min(regexp_replace(rq1_status, '^RQ1_', '')) AS status,
           nullif(regexp_extract(region_id, 'ord(\d+)$', 1), '')::INT AS position, regexp_extract(region_id, '\|(added|deleted)\|', 1) AS change_type
    FROM attribution_rows WHERE granularity = 'LINE' AND rank_score IS NOT NULL AND NOT isnan(rank_score) GROUP BY ALL)"""


def scores(spark: SparkSession, directory: str, granularity: str = "LINE") -> DataFrame:
    rows = table(spark, directory, "attribution_rows").where((F.col("granularity") == granularity) & F.col("rank_score").isNotNull() & ~F.isnan("rank_score"))
    per = rows.groupBy(commit_key(F.col("commit_id")).alias("commit_id"), "method", F.col("model_seed").alias("seed"), "region_id").agg(
        F.max("raw_score").alias("score"), F.min(F.regexp_replace("rq1_status", "^RQ1_", "")).alias("status")
    )
    position = F.nullif(F.regexp_extract("region_id", r"ord(\d+)$", 1), F.lit("")).cast("int")
    return per.withColumns({"position": position, "change_type": F.regexp_extract("region_id", r"\|(added|deleted)\|", 1)})


#: DuckDB: hunk_specs with each hunk once, and its lines.
HUNKS = rf"""hunks AS (
    SELECT {_ID} AS commit_id, canonical_path AS path, hunk_ordinal, min(file_ordinal) AS file_ordinal, arg_min(lines, extracted_at) AS ls,
           arg_min(old_start, extracted_at) AS old_start, arg_min(old_length, extracted_at) AS old_length,
           arg_min(new_start, extracted_at) AS new_start, arg_min(new_length, extracted_at) AS new_length
    FROM hunk_specs GROUP BY ALL)"""
LINES = rf"""{HUNKS}, lines0 AS (
    SELECT commit_id, path, file_ordinal, hunk_ordinal, (generate_subscripts(ls, 1) - 1)::INT AS line_ordinal, unnest(ls) AS l FROM hunks),
    lines AS (SELECT commit_id, path, file_ordinal, hunk_ordinal, line_ordinal, l.change_type AS change_type, l.raw_text AS raw_text,
        l.stable_line_id AS line_id, l.old_lineno AS old_lineno, l.new_lineno AS new_lineno, l.occurrence_index AS occurrence_index,
        l.ordered_position AS position, regexp_replace(l.rq1_status, '^RQ1_', '') AS status,
        coalesce(len(regexp_extract_all(l.raw_text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')), 0)::INT AS tokens FROM lines0)"""


def hunks(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "hunk_specs")
    rest = ["lines", "old_start", "old_length", "new_start", "new_length"]
    per = rows.groupBy(commit_key(F.col("commit_id")).alias("commit_id"), F.col("canonical_path").alias("path"), "hunk_ordinal").agg(
        F.min("file_ordinal").alias("file_ordinal"), F.min_by(F.struct(*rest), "extracted_at").alias("__r")
    )
    return per.select("commit_id", "path", "hunk_ordinal", "file_ordinal", "__r.*")


def lines(spark: SparkSession, directory: str) -> DataFrame:
    rows = hunks(spark, directory).select("commit_id", "path", "file_ordinal", "hunk_ordinal", F.posexplode("lines").alias("line_ordinal", "l"))
    return rows.select(
        "commit_id", "path", "file_ordinal", "hunk_ordinal", "line_ordinal", "l.change_type", "l.raw_text", F.col("l.stable_line_id").alias("line_id"),
        "l.old_lineno", "l.new_lineno", "l.occurrence_index", F.col("l.ordered_position").alias("position"),
        F.regexp_replace("l.rq1_status", "^RQ1_", "").alias("status"), token_count(F.col("l.raw_text")).alias("tokens"),
    )


_PROJECT = r"nullif(nullif(replace(lower(regexp_replace(project, '^\s+|\s+$', '', 'g')), '_', '-'), ''), '?')"
_SPLIT = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g'))"
#: DuckDB: commits with their latest row.
COMMITS = rf"""commits0 AS (SELECT {_ID} AS commit_id, arg_max(struct_pack(project := {_PROJECT},
        split := CASE WHEN {_SPLIT} IN ('train', 'training', 'tr', 'trn') THEN 'train' WHEN {_SPLIT} IN ('valid', 'validation', 'val', 'dev') THEN 'valid'
            WHEN {_SPLIT} IN ('test', 'testing', 'tst', 'te') THEN 'test' END,
        tokens := visible_token_count, is_positive := is_positive, message := commit_message, author_date := author_date),
        struct_pack(a := ingested_at, b := coalesce(visible_token_count, -1), c := coalesce(commit_message, ''), d := coalesce(split, ''), e := coalesce(project, ''))) AS r
    FROM commit_meta GROUP BY 1),
    commits AS (SELECT commit_id, r.project AS project, r.split AS split, r.tokens AS tokens, r.is_positive AS is_positive, r.message AS message, r.author_date AS author_date FROM commits0)"""


def commits(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "commit_meta")
    value = F.struct(
        project_key(F.col("project")).alias("project"), split_key(F.col("split")).alias("split"), F.col("visible_token_count").alias("tokens"), "is_positive",
        F.col("commit_message").alias("message"), "author_date",
    )
    order = F.struct("ingested_at", F.coalesce("visible_token_count", F.lit(-1)), *(F.coalesce(c, F.lit("")) for c in ("commit_message", "split", "project")))
    return rows.groupBy(commit_key(F.col("commit_id")).alias("commit_id")).agg(F.max_by(value, order).alias("r")).select("commit_id", "r.*")
