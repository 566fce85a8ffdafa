"""Checks that are compositions of joins and aggregates, with SQL over the same frames as twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions import lines as lf
from sparline.functions.ids import json_digest
from sparline.functions.text import commit_key, split_key
from sparline.operators import checks, linkage, structure
from sparline.plans.audit_queries import _META, _SPLIT, _UNITS, meta, units
from sparline.plans.base import COMMITS, HUNKS, LINES, SCORES, commits, hunks, lines, scores, settled
from sparline.plans.catalog import Catalog
from sparline.plans.inference_queries import VALUES, values
from sparline.plans.ranking_queries import METRICS, metrics
from sparline.plans.text_queries import _BRIDGE, _SEGMENTS, _TOKENS, _collapse, _mask, bridge, parts
from sparline.session import cut
from sparline.sources.parquet import table

CATALOG = Catalog()
Frame = Callable[[SparkSession, str], DataFrame]

_ID = r"lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g'))"
_EXCLUDED = rf"excluded AS (SELECT lower(regexp_replace(commit_hash, '^\s+|\s+$', '', 'g')) AS hash, {_SPLIT} AS split, our_label FROM excluded_commits_summary)"
_POLICY = rf"policy AS (SELECT row_id, {_ID} AS commit_id, label, raw_changed_line AS raw, changed_line AS changed FROM policy_a_rows)"


def excluded(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "excluded_commits_summary")
    return rows.select(commit_key(F.col("commit_hash")).alias("hash"), split_key(F.col("split")).alias("split"), "our_label")


def policy(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "policy_a_rows")
    return rows.select("row_id", commit_key(F.col("commit_id")).alias("commit_id"), "label", F.col("raw_changed_line").alias("raw"), F.col("changed_line").alias("changed"))


FRAMES: dict[str, tuple[Frame, str]] = {
    "excluded": (excluded, _EXCLUDED), "policy": (policy, _POLICY), "meta": (meta, _META), "lines": (lines, LINES), "scores": (scores, SCORES), "commits": (commits, COMMITS),
    "b": (bridge, _BRIDGE), "units": (units, _UNITS), "metrics": (metrics, METRICS), "v": (values, VALUES), "hunks": (hunks, HUNKS),
}


def twin(name: str, body: str, *frames: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named frames with ``body`` as its SQL, in which {f} stands for frame f."""
    ctes = ", ".join(FRAMES[f][1] for f in frames)
    duck = f"WITH {ctes} SELECT * FROM ({body.format(**{f: f for f in frames})}) AS q"

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CATALOG.query(name, duck)(lambda spark, directory: f(*(FRAMES[x][0](spark, directory) for x in frames)))
        return f

    return add



@twin(
    "c21_known_hashes",
    """SELECT kind, count(*) AS n FROM (SELECT DISTINCT x.hash, CASE WHEN m.id IS NULL THEN 'unknown' ELSE 'known' END AS kind
    FROM {excluded} x LEFT JOIN (SELECT DISTINCT commit_id AS id FROM {meta}) m ON m.id = x.hash) k GROUP BY kind""",
    "excluded", "meta",
)
def c21(excluded_: DataFrame, meta_: DataFrame) -> DataFrame:
    return checks.known_keys(excluded_.where(F.col("hash").isNotNull()), "hash", meta_, "commit_id")


@twin(
    "c22_upsert_sizes",
    """SELECT c.commit_id, coalesce(r.n, c.tokens) AS tokens, CASE WHEN r.n IS NULL THEN 'kept' WHEN c.tokens IS NULL THEN 'inserted' ELSE 'updated' END AS action
    FROM {commits} c LEFT JOIN (SELECT commit_id, CAST(sum(tokens) AS BIGINT) AS n FROM {lines} GROUP BY commit_id) r ON r.commit_id = c.commit_id""",
    "lines", "commits",
)
def c22(lines_: DataFrame, commits_: DataFrame) -> DataFrame:
    sizes = lines_.groupBy("commit_id").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return checks.upsert(commits_.select("commit_id", F.col("tokens").cast("bigint").alias("tokens")), sizes, ["commit_id"], "tokens")


@twin(
    "d35_two_level_share",
    """SELECT method, change_type, round(avg(share) + 3e-9, 7) AS mean_share, count(*) AS n_commits FROM (
        SELECT commit_id, method, change_type, avg(share) AS share FROM (
            SELECT commit_id, method, seed, change_type, sum(abs(score)) / max(total) AS share FROM (
                SELECT *, sum(abs(score)) OVER (PARTITION BY commit_id, method, seed) AS total FROM {scores}) t WHERE total > 0 GROUP BY commit_id, method, seed, change_type) u
        GROUP BY commit_id, method, change_type) w GROUP BY method, change_type""",
    "scores",
)
def d35(scores_: DataFrame) -> DataFrame:
    out = checks.two_level_share(scores_, ["commit_id", "method", "seed"], "change_type", ["commit_id"], ["method"])
    return out.withColumn("mean_share", settled("mean_share"))


@twin(
    "d37_stage_stats",
    """SELECT split, count(*) AS n, count_if(is_positive) AS n_positive, round(avg(CASE WHEN is_positive THEN 1.0E0 ELSE 0.0E0 END), 9) AS prevalence, count(DISTINCT project) AS n_projects,
    min(commit_id) AS first_id, max(commit_id) AS last_id FROM {commits} GROUP BY split""",
    "commits",
)
def d37(commits_: DataFrame) -> DataFrame:
    positive = F.coalesce("is_positive", F.lit(False))
    return commits_.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_positive"), F.round(F.avg(positive.cast("double")), 9).alias("prevalence"), F.count_distinct("project").alias("n_projects"),
        F.min("commit_id").alias("first_id"), F.max("commit_id").alias("last_id"),
    )


@twin(
    "e11_label_multiplicity",
    """SELECT l.line_id, CASE WHEN l.occ < coalesce(p.k, 0) THEN 1 ELSE 0 END AS label FROM (
        SELECT commit_id, line_id, raw_text, row_number() OVER (PARTITION BY commit_id, raw_text ORDER BY position) - 1 AS occ FROM {lines} WHERE change_type = 'added') l
    LEFT JOIN (SELECT commit_id, raw, count(*) AS k FROM {policy} WHERE label = 1 GROUP BY commit_id, raw) p ON p.commit_id = l.commit_id AND p.raw = l.raw_text""",
    "lines", "policy",
)
def e11(lines_: DataFrame, policy_: DataFrame) -> DataFrame:
    added = lines_.where("change_type = 'added'").select("commit_id", "line_id", "position", F.col("raw_text").alias("raw"))
    return checks.label_multiplicity(added, policy_.where("label = 1").select("commit_id", "raw"), ["commit_id"], "raw", "position").select("line_id", "label")


@twin(
    "e20_file_ordinals",
    """SELECT commit_id, path, CAST(row_number() OVER (PARTITION BY commit_id ORDER BY first_at, path) - 1 AS INT) AS file_ordinal, n_hunks FROM (
        SELECT commit_id, path, min(position) AS first_at, count(DISTINCT hunk_ordinal) AS n_hunks FROM {lines} WHERE position IS NOT NULL GROUP BY commit_id, path) f""",
    "lines",
)
def e20(lines_: DataFrame) -> DataFrame:
    return checks.file_ordinals(lines_, "commit_id", "path", "position", "hunk_ordinal")


@twin(
    "audit_p04_coverage",
    """SELECT c.split, count(*) AS n, count(l.commit_id) AS n_represented, count_if(coalesce(l.added, 0) > 0) AS n_added, count_if(coalesce(l.positive, 0) > 0) AS n_positive,
    count_if(coalesce(l.added, 0) > 0 AND coalesce(l.positive, 0) = 0) AS n_added_only FROM {commits} c LEFT JOIN (
        SELECT commit_id, count_if(change_type = 'added') AS added, count_if(status = 'POSITIVE') AS positive FROM {lines} GROUP BY commit_id) l ON l.commit_id = c.commit_id GROUP BY c.split""",
    "lines", "commits",
)
def p04(lines_: DataFrame, commits_: DataFrame) -> DataFrame:
    per = checks.tallies(lines_, "commit_id", {"a": F.col("change_type") == "added", "p": F.col("status") == "POSITIVE"}, commits_.select("commit_id", "split"))
    a, p = F.col("a") > 0, F.col("p") > 0
    return per.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__there").alias("n_represented"), F.count_if(a).alias("n_added"), F.count_if(p).alias("n_positive"), F.count_if(a & ~p).alias("n_added_only")
    )


@twin(
    "audit_p07_zero_changes",
    """SELECT c.is_positive, count_if(coalesce(l.added, 0) = 0) AS zero_added, count_if(coalesce(l.deleted, 0) = 0) AS zero_deleted, count_if(coalesce(l.added, 0) = 0 AND coalesce(l.deleted, 0) = 0) AS zero_both, count(*) AS n
    FROM {commits} c LEFT JOIN (SELECT commit_id, count_if(change_type = 'added') AS added, count_if(change_type = 'deleted') AS deleted FROM {lines} GROUP BY commit_id) l ON l.commit_id = c.commit_id GROUP BY c.is_positive""",
    "lines", "commits",
)
def p07(lines_: DataFrame, commits_: DataFrame) -> DataFrame:
    per = checks.tallies(lines_, "commit_id", {"a": F.col("change_type") == "added", "d": F.col("change_type") == "deleted"}, commits_.select("commit_id", "is_positive"))
    a, d = F.col("a") == 0, F.col("d") == 0
    return per.groupBy("is_positive").agg(F.count_if(a).alias("zero_added"), F.count_if(d).alias("zero_deleted"), F.count_if(a & d).alias("zero_both"), F.count(F.lit(1)).alias("n"))


@twin(
    "audit_p12_count_agreement",
    """SELECT count(*) AS n, count_if(a.n = p.n) AS n_equal, count_if(a.n > p.n) AS n_more FROM (SELECT commit_id, count(*) AS n FROM {lines} WHERE change_type = 'added' GROUP BY commit_id) a
    JOIN (SELECT commit_id, count(*) AS n FROM {policy} GROUP BY commit_id) p ON p.commit_id = a.commit_id""",
    "lines", "policy",
)
def p12(lines_: DataFrame, policy_: DataFrame) -> DataFrame:
    return checks.count_agreement(lines_.where("change_type = 'added'"), policy_, "commit_id")


@twin(
    "audit_p15_commit_classes",
    """SELECT class, count(*) AS n FROM (SELECT commit_id, CASE WHEN count_if(label = 1) = 0 THEN 'NO_POSITIVE' WHEN bool_and(label <> 1 OR label IS NULL OR mapped) THEN 'COMPLETE' WHEN bool_or(label = 1 AND mapped) THEN 'PARTIAL' ELSE 'NONE' END AS class
        FROM (SELECT commit_id, label, new_lineno IS NOT NULL AS mapped FROM {b}) k GROUP BY commit_id) g GROUP BY class""",
    "b",
)
def p15(bridge_: DataFrame) -> DataFrame:
    return checks.mapping_classes(bridge_, "commit_id", F.col("label") == 1, F.col("new_lineno").isNotNull())


@twin(
    "q06_commit_profile",
    """SELECT l.commit_id, count(*) AS n_lines, count_if(l.status = 'POSITIVE') AS n_positive, count(DISTINCT l.path) AS n_files, count(DISTINCT concat(l.path, '#', CAST(l.hunk_ordinal AS STRING))) AS n_hunks,
    round(count_if(l.status = 'POSITIVE') / count(*), 9) AS density, max(c.project) AS project FROM {lines} l LEFT JOIN {commits} c ON c.commit_id = l.commit_id GROUP BY l.commit_id""",
    "lines", "commits",
)
def q06(lines_: DataFrame, commits_: DataFrame) -> DataFrame:
    out = checks.unit_profile(lines_, "commit_id", F.col("status") == "POSITIVE").withColumn("density", F.round("density", 9))
    return out.join(commits_.select("commit_id", "project"), "commit_id", "left")


@twin(
    "q10_project_failures",
    """SELECT c.project, count(*) AS n_commits, count_if(u.done < 18) AS n_incomplete FROM (SELECT commit_id, count_if(code = 'OK') AS done FROM {units} GROUP BY commit_id) u
    JOIN {commits} c ON c.commit_id = u.commit_id GROUP BY c.project""",
    "units", "commits",
)
def q10(units_: DataFrame, commits_: DataFrame) -> DataFrame:
    return checks.incomplete_units(units_, "commit_id", F.col("code") == "OK", 18, commits_, "project")


@twin(
    "q11_largest_difference",
    """SELECT a.seed, count(*) AS n, round(max(abs(a.score - x.score)), 9) AS largest, count_if(abs(a.score - x.score) <= 0.01) AS n_within FROM {scores} a JOIN {scores} x
    ON a.commit_id = x.commit_id AND a.seed = x.seed AND a.region_id = x.region_id WHERE a.method = 'attention_last' AND x.method = 'attention_last4' GROUP BY a.seed""",
    "scores",
)
def q11(scores_: DataFrame) -> DataFrame:
    out = checks.largest_difference(scores_, ["commit_id", "seed", "region_id"], "method", "attention_last", "attention_last4", "score", ["seed"], 0.01)
    return out.withColumn("largest", F.round("largest", 9))


@twin(
    "b10_add_first_degenerate",
    "SELECT degenerate, count(*) AS n FROM (SELECT commit_id, bool_and(change_type = 'added') AS degenerate FROM {lines} WHERE change_type <> 'context' GROUP BY commit_id) k GROUP BY degenerate",
    "lines",
)
def b10(lines_: DataFrame) -> DataFrame:
    per = checks.tallies(lines_.where("change_type <> 'context'"), "commit_id", {"a": F.col("change_type") != "added"}, lines_.where("change_type <> 'context'").select("commit_id").distinct())
    return per.groupBy((F.col("a") == 0).alias("degenerate")).agg(F.count(F.lit(1)).alias("n"))


@twin(
    "m09_metric_rows",
    """SELECT method, metric, count(value) AS n, round(avg(value), 9) AS mean FROM (SELECT method, 'recall_at_effort' AS metric, recall_at_effort AS value FROM {metrics}
    UNION ALL SELECT method, 'effort_at_recall', effort_at_recall FROM {metrics} UNION ALL SELECT method, 'ifa', CAST(ifa AS DOUBLE) FROM {metrics}) u GROUP BY method, metric""",
    "metrics",
)
def m09(metrics_: DataFrame) -> DataFrame:
    out = checks.long_metrics(metrics_, ["method"], ["recall_at_effort", "effort_at_recall", "ifa"])
    return out.withColumn("mean", F.round("mean", 9))



@CATALOG.query(
    "audit_p14_transform_matches",
    f"""WITH {_POLICY} SELECT count(*) AS n, count_if({_collapse("raw")} = changed) AS n_collapsed, count_if({_mask("raw")} = changed) AS n_masked FROM policy WHERE raw IS NOT NULL""",
)
def p14(spark: SparkSession, directory: str) -> DataFrame:
    raw, changed = F.col("raw"), F.col("changed")
    return policy(spark, directory).where(raw.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lf.collapse(raw) == changed).alias("n_collapsed"), F.count_if(lf.mask_literals(raw) == changed).alias("n_masked")
    )


MARKERS = ["buggy", "TODO", "deadlock", "https://", "@@ -"]


@CATALOG.query(
    "b09_leakage_markers",
    f"""SELECT marker, count(*) AS n FROM documents, (VALUES {", ".join(f"('{m}')" for m in MARKERS)}) AS x(marker) WHERE contains(text, marker) GROUP BY 1""",
)
def b09(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").where(F.col("text").isNotNull())
    return rows.select(F.explode(lf.markers_in(F.col("text"), MARKERS)).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "c09_path_resolution",
    f"""WITH {HUNKS}, {_BRIDGE}, p AS (SELECT DISTINCT commit_id, path FROM hunks), q AS (SELECT row_id, commit_id, split_part(path, '/', -1) AS path FROM b WHERE path IS NOT NULL UNION ALL SELECT -1 - row_id, commit_id, path FROM b WHERE path IS NOT NULL),
    m AS (SELECT q.row_id, min(CASE WHEN q.path = p.path THEN 0 ELSE 2 END) AS g FROM q LEFT JOIN p ON p.commit_id = q.commit_id AND (p.path = q.path OR ends_with(p.path, '/' || q.path) OR ends_with(q.path, '/' || p.path)) AND p.path IS NOT NULL GROUP BY 1),
    n AS (SELECT q.row_id, max(CASE WHEN p.path IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM q LEFT JOIN p ON p.commit_id = q.commit_id AND (p.path = q.path OR ends_with(p.path, '/' || q.path) OR ends_with(q.path, '/' || p.path)) GROUP BY 1)
    SELECT row_id, CASE WHEN hit = 0 THEN 'MISSING' WHEN g = 0 THEN 'EXACT' ELSE 'SUFFIX' END AS resolution FROM m JOIN n USING (row_id)""",
)
def c09(spark: SparkSession, directory: str) -> DataFrame:
    """Whole paths and, under negative ids the other way round, bare file names resolved against the files of the commit."""
    rows = bridge(spark, directory).where(F.col("path").isNotNull())
    names = rows.select("row_id", "commit_id", F.element_at(F.split("path", "/"), -1).alias("path"))
    every = names.unionAll(rows.select((-1 - F.col("row_id")).alias("row_id"), "commit_id", "path"))
    return linkage.resolve_paths(every, hunks(spark, directory).withColumnRenamed("path", "known"), ["commit_id"], "path", "known").select("row_id", "resolution")


@CATALOG.query(
    "d31_truncation_audit",
    f"""WITH {_SEGMENTS}, {_TOKENS}, z AS (SELECT commit_id, count(*) AS n_tokens, max(CASE WHEN token_index = 509 THEN e END) AS at_ FROM tok GROUP BY 1),
    c AS (SELECT z.commit_id, coalesce(min(p.char_start) FILTER (p.line_id IS NOT NULL AND p.char_start < at_ AND at_ <= p.char_start + length(p.payload)), any_value(at_)) AS cut_char
          FROM z JOIN sp p USING (commit_id) WHERE n_tokens > 510 GROUP BY 1),
    d AS (SELECT p.line_id, p.char_start >= c.cut_char AS dropped FROM sp p JOIN c USING (commit_id) WHERE p.line_id IS NOT NULL)
    SELECT l.status, count(*) AS n, count_if(coalesce(d.dropped, false)) AS n_dropped FROM lines l LEFT JOIN d USING (line_id) WHERE l.line_id IS NOT NULL GROUP BY 1""",
)
def d31(spark: SparkSession, directory: str) -> DataFrame:
    """Lines by label, and how many of them truncation drops."""
    regions = cut(structure.token_segments(structure.spans(parts(spark, directory))))
    cuts = structure.truncate_segments(regions, 512, 2)
    gone = structure.dropped_lines(regions, cuts).select("line_id", F.lit(True).alias("__gone"))
    rows = lines(spark, directory).where(F.col("line_id").isNotNull()).join(gone, "line_id", "left")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("__gone", F.lit(False))).alias("n_dropped"))


@CATALOG.query(
    "k04_nested_records",
    f"""WITH {LINES} SELECT commit_id, count(DISTINCT path) AS n_files, count(DISTINCT path || '#' || hunk_ordinal) AS n_hunks, count(*) AS n_lines, count(raw_text) AS n_flat FROM lines GROUP BY 1""",
)
def k04(spark: SparkSession, directory: str) -> DataFrame:
    """Records nested and flattened again."""
    nested = structure.nested_records(lines(spark, directory))
    n_hunks = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + F.size(f["hunks"]))
    sizes = nested.select("commit_id", F.size("files").cast("bigint").alias("n_files"), n_hunks.alias("n_hunks"))
    flat = structure.flat_lines(nested).groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("raw_text").alias("n_flat"))
    return sizes.join(flat, "commit_id")


@CATALOG.query(
    "h13_json_digests",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"n":' || n_chars || '}') AS digest FROM documents WHERE n_chars IS NOT NULL""",
)
def h13(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").where(F.col("n_chars").isNotNull())
    return rows.select("doc_id", json_digest([("n", F.col("n_chars")), ("doc_id", F.col("doc_id"))]).alias("digest"))


@CATALOG.query(
    "m05_supervised_examples",
    """SELECT vec_id, array_to_string(list_concat(list_transform(embedding, lambda x: floor(x * 100)::INT), [label::INT, 0]), ' ') AS padded, repeat('-100 ', 64) || label AS targets, 1 AS n_supervised FROM embeddings""",
)
def m05(spark: SparkSession, directory: str) -> DataFrame:
    """Inputs, padded to a width (m06), and targets with one supervised position (o33)."""
    tokens = F.transform("embedding", lambda x: F.floor(x * 100).cast("int"))
    inputs, targets = structure.supervised(tokens, F.col("label").cast("int"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return table(spark, directory, "embeddings").select(
        "vec_id", text(structure.padded(inputs, F.lit(66), 0)).alias("padded"), text(targets).alias("targets"), F.size(F.filter(targets, lambda t: t != -100)).alias("n_supervised")
    )


@CATALOG.query(
    "c12_region_tokens",
    f"""WITH {_SEGMENTS}, {_TOKENS}, m AS (SELECT t.commit_id, t.token_index, any_value(p.line_id) AS owner FROM tok t JOIN sp p ON p.commit_id = t.commit_id AND p.line_id IS NOT NULL
        AND t.s < p.char_start + length(p.payload) AND t.e > p.char_start GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT owner, count(*) AS n FROM m GROUP BY 1)
    SELECT l.line_id, coalesce(n.n, 0) AS n_tokens FROM lines l LEFT JOIN n ON n.owner = l.line_id WHERE l.line_id IS NOT NULL""",
)
def c12(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens of every line in the rendered text, 0 for lines without any."""
    owned = structure.segment_tokens(structure.token_segments(structure.spans(parts(spark, directory))))
    per = owned.where(F.col("owner").isNotNull()).groupBy(F.col("owner").alias("line_id")).agg(F.count(F.lit(1)).alias("n"))
    grid = lines(spark, directory).where(F.col("line_id").isNotNull()).select("line_id")
    return grid.join(per, "line_id", "left").select("line_id", F.coalesce("n", F.lit(0)).alias("n_tokens"))
