"""Queries of the general data problems: few keys with most rows (p1), references to nowhere (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions.text import commit_key, project_key, trimmed
from sparline.operators.orphans import orphan_counts, orphans
from sparline.operators.skew import heavy_keys, key_profile
from sparline.plans.catalog import Catalog
from sparline.sources.parquet import table

CATALOG = Catalog()

HEAVY_SHARE = 0.05
PERCENTILES = (0.5, 0.9, 0.99)

_PROJECT = r"nullif(nullif(replace(lower(regexp_replace(project, '^\s+|\s+$', '', 'g')), '_', '-'), ''), '?')"
_PROJECT_ROWS = rf"""
    SELECT 'commit_meta' AS table_name, {_PROJECT} AS project,
           lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g')) AS commit_id, visible_token_count AS tokens FROM commit_meta
    UNION ALL
    SELECT 'excluded_commits_summary', {_PROJECT},
           lower(regexp_replace(commit_hash, '^\s+|\s+$', '', 'g')), NULL FROM excluded_commits_summary
"""


def project_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Both tables with a project: table_name, project, commit_id and, of commit_meta, tokens."""
    meta = table(spark, directory, "commit_meta").select(
        F.lit("commit_meta").alias("table_name"), project_key(F.col("project")).alias("project"),
        commit_key(F.col("commit_id")).alias("commit_id"), F.col("visible_token_count").alias("tokens"),
    )
    excluded = table(spark, directory, "excluded_commits_summary").select(
        F.lit("excluded_commits_summary").alias("table_name"), project_key(F.col("project")).alias("project"),
        commit_key(F.col("commit_hash")).alias("commit_id"), F.lit(None).cast("int").alias("tokens"),
    )
    return meta.unionAll(excluded)


@CATALOG.query(
    "p1_found",
    f"""WITH r AS ({_PROJECT_ROWS}),
    n AS (SELECT table_name, project, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_name) AS total FROM r GROUP BY 1, 2)
    SELECT table_name, project FROM n WHERE project IS NOT NULL AND n >= total * 0.05::DOUBLE""",
)
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    profile = key_profile(project_rows(spark, directory), ["table_name", "project"], "commit_id")
    heavy = heavy_keys(profile, ["table_name"], HEAVY_SHARE)
    return heavy.where(F.col("project").isNotNull()).select("table_name", "project")


@CATALOG.query(
    "p1_project_profile",
    f"""WITH r AS ({_PROJECT_ROWS}),
    m AS (SELECT table_name, project, tokens, row_number() OVER (PARTITION BY table_name, project ORDER BY count(*) DESC, tokens) AS k
          FROM r WHERE tokens IS NOT NULL GROUP BY 1, 2, 3)
    SELECT r.table_name, r.project, count(*) AS n_rows, count(DISTINCT commit_id) AS n_commits, count(r.tokens) AS n_sized,
           sum(r.tokens)::BIGINT AS tokens_total, max(m.tokens) AS tokens_mode,
           round(quantile_cont(r.tokens::DOUBLE, 0.5), 6) AS tokens_p50, round(quantile_cont(r.tokens::DOUBLE, 0.9), 6) AS tokens_p90,
           round(quantile_cont(r.tokens::DOUBLE, 0.99), 6) AS tokens_p99
    FROM r LEFT JOIN m ON r.table_name = m.table_name AND r.project IS NOT DISTINCT FROM m.project AND m.k = 1
    GROUP BY 1, 2""",
)
def p1_project_profile(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, commits and sizes of every project of both tables; no project is a row of its own."""
    profile = key_profile(project_rows(spark, directory), ["table_name", "project"], "commit_id", "tokens", PERCENTILES)
    return profile.select(
        "table_name", "project", "n_rows", F.col("n_distinct").alias("n_commits"), "n_sized",
        F.col("size_total").alias("tokens_total"), F.col("size_mode").alias("tokens_mode"),
        *(F.round(F.col("size_percentiles")[i], 6).alias(f"tokens_p{p * 100:.0f}") for i, p in enumerate(PERCENTILES)),
    )


#: Bridge statuses that claim no mapping.
NO_MAPPING = ("AMBIGUOUS", "UNRESOLVED")

_ORPHANS = r"""
    refs AS (
        SELECT 'policy_a_rows' AS table_name, row_id, loaded_at AS made FROM policy_a_rows WHERE commit_id IS NOT NULL
        UNION ALL
        SELECT 'bridge_results', row_id, mapped_at FROM bridge_results
        WHERE coalesce(upper(regexp_replace(mapping_status, '^\s+|\s+$', '', 'g')), '') NOT IN ('AMBIGUOUS', 'UNRESOLVED')),
    lines AS (SELECT regexp_replace(unnest(lines).stable_line_id, '^\s+|\s+$', '', 'g') AS id, extracted_at, removed_at FROM hunk_specs),
    found AS (
        SELECT 'policy_a_rows' AS table_name, row_id, loaded_at AS made FROM policy_a_rows r
        WHERE commit_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM commit_meta m
            WHERE lower(regexp_replace(m.commit_id, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(r.commit_id, '^\s+|\s+$', '', 'g'))
              AND m.ingested_at <= r.loaded_at AND (m.removed_at IS NULL OR m.removed_at > r.loaded_at))
        UNION ALL
        SELECT 'bridge_results', row_id, mapped_at FROM bridge_results r
        WHERE coalesce(upper(regexp_replace(mapping_status, '^\s+|\s+$', '', 'g')), '') NOT IN ('AMBIGUOUS', 'UNRESOLVED')
          AND (coalesce(regexp_replace(canonical_line_id, '^\s+|\s+$', '', 'g'), '') IN ('', 'NA') OR NOT EXISTS (
            SELECT 1 FROM lines l
            WHERE l.id = regexp_replace(r.canonical_line_id, '^\s+|\s+$', '', 'g')
              AND l.extracted_at <= r.mapped_at AND (l.removed_at IS NULL OR l.removed_at > r.mapped_at))))
"""


def commit_references(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "policy_a_rows").where(F.col("commit_id").isNotNull())
    return rows.select(F.lit("policy_a_rows").alias("table_name"), "row_id", commit_key(F.col("commit_id")).alias("key"), F.col("loaded_at").alias("at"))


def line_references(spark: SparkSession, directory: str) -> DataFrame:
    status = F.coalesce(F.upper(trimmed(F.col("mapping_status"))), F.lit(""))
    rows = table(spark, directory, "bridge_results").where(~status.isin(*NO_MAPPING))
    key = trimmed(F.col("canonical_line_id"))
    named = F.when(~key.isin("", "NA"), key)
    return rows.select(F.lit("bridge_results").alias("table_name"), "row_id", named.alias("key"), F.col("mapped_at").alias("at"))


def orphan_rows(spark: SparkSession, directory: str) -> DataFrame:
    """table_name, row_id, at of every reference to nothing in both tables."""
    commits = table(spark, directory, "commit_meta").select(commit_key(F.col("commit_id")).alias("id"), "ingested_at", "removed_at")
    lines = table(spark, directory, "hunk_specs").select(
        F.explode("lines.stable_line_id").alias("id"), F.col("extracted_at").alias("ingested_at"), "removed_at"
    )
    lines = lines.withColumn("id", trimmed(F.col("id")))
    how = {"key": "key", "at": "at", "payload": ["table_name", "row_id", "at"], "parent_key": "id", "valid_from": "ingested_at", "valid_to": "removed_at"}
    return orphans(commit_references(spark, directory), commits, **how).unionAll(orphans(line_references(spark, directory), lines, **how))


@CATALOG.query("p5_found", f"WITH {_ORPHANS} SELECT table_name, row_id FROM found")
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return orphan_rows(spark, directory).select("table_name", "row_id")


@CATALOG.query(
    "p5_orphan_report",
    f"""WITH {_ORPHANS},
    months AS (SELECT table_name, strftime(made, '%Y-%m') AS month, 1 AS bad, 0 AS one FROM found
               UNION ALL SELECT table_name, strftime(made, '%Y-%m'), 0, 1 FROM refs)
    SELECT table_name, month, sum(bad)::BIGINT AS n_orphans, sum(one)::BIGINT AS n_references FROM months GROUP BY 1, 2""",
)
def p5_orphan_report(spark: SparkSession, directory: str) -> DataFrame:
    """Orphan references and all references per table and month of loaded_at or mapped_at."""
    references = commit_references(spark, directory).unionAll(line_references(spark, directory))
    return orphan_counts(orphan_rows(spark, directory), references, "table_name", "at")
