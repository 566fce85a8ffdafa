"""Resumable runs, prompts, visibility and cohorts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions import ids
from sparline.operators import cohorts, engine, faithfulness, runs, structure
from sparline.plans.audit_queries import SEEDS
from sparline.plans.base import COMMITS, LINES, commits, lines, settled, settled_sql
from sparline.plans.catalog import Catalog
from sparline.plans.inference_queries import members
from sparline.plans.ranking_queries import _PREFIX, FRACTIONS, effects
from sparline.plans.text_queries import _SEGMENTS, _TOKENS, parts
from sparline.session import cut, ensure_checkpoint_dir

CATALOG = Catalog()


def fresh_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"


def grid(spark: SparkSession, directory: str) -> DataFrame:
    return runs.job_grid(commits(spark, directory).select("commit_id"), ["gradient", "occlusion_line"], SEEDS).withColumn("granularity", F.lit("LINE"))


def toy_executor(fail_first: bool):
    """Pseudo-scores from the digest; in the first attempt units whose id hashes low fail or run out of memory."""

    def execute(todo: DataFrame) -> DataFrame:
        low = F.conv(F.substring(F.sha2(engine.unit_id(), 256), 1, 1), 16, 10).cast("int")
        early = F.lit(fail_first) & (F.col("attempt") == 1)
        status = F.when(early & (low == 0), "FAILED").when(early & (low == 1), "OOM").when(low == 2, "NONCONVERGED").otherwise("DONE")
        code = F.when(status == "DONE", "OK").when(status == "NONCONVERGED", "IG_NONCONVERGED").otherwise("ENGINE_ERROR")
        return todo.select(*engine.UNIT, "digest", status.alias("status"), code.alias("code"), ids.pseudo_scores(F.col("digest")).alias("payload"))

    return execute


_UNIT_LOW = f"""{COMMITS}, g AS (SELECT ('0x' || substr(sha256(commit_id || '|' || s || '|' || m || '|LINE'), 1, 1))::INT AS low FROM commits, (VALUES (13), (42), (73)) AS a(s), (VALUES ('gradient'), ('occlusion_line')) AS b(m) WHERE commit_id IS NOT NULL)"""


@CATALOG.query(
    "n01_resumed_run",
    f"""WITH {_UNIT_LOW} SELECT 1 AS attempt, CASE low WHEN 0 THEN 'FAILED' WHEN 1 THEN 'OOM' WHEN 2 THEN 'NONCONVERGED' ELSE 'DONE' END AS status, count(*) AS n FROM g GROUP BY 2
    UNION ALL SELECT 2, 'DONE', count(*) FROM g WHERE low < 2 HAVING count(*) > 0""",
)
def n01(spark: SparkSession, directory: str) -> DataFrame:
    """A run that fails in part and is resumed: only what failed is executed again."""
    folder = fresh_folder(spark)
    run = engine.Run(spark, folder, {"model": "toy", "protocol": 1}, f"{folder}/cache").open()
    g = grid(spark, directory).where(F.col("commit_id").isNotNull())
    for _ in range(2):
        run.resume(g, toy_executor(True))
    return run.history(g).groupBy("attempt", "status").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "n05_cached_run",
    f"""WITH {_UNIT_LOW} SELECT count(*) AS planned, count_if(low <> 2) AS cached, count_if(low = 2) AS executed, count_if(low <> 2) AS n_results FROM g""",
)
def n05(spark: SparkSession, directory: str) -> DataFrame:
    """A second run of the same identity, which finds the results of the first in the cache."""
    folder = fresh_folder(spark)
    g = grid(spark, directory).where(F.col("commit_id").isNotNull())
    first, second = (engine.Run(spark, f"{folder}/{k}", {"model": "toy", "protocol": 1}, f"{folder}/cache").open() for k in "ab")
    first.resume(g, toy_executor(False))
    counts = second.resume(g, toy_executor(False))
    n = second.results(g).agg(F.count(F.lit(1)).alias("n_results"))
    return n.select(*(F.lit(counts[k]).cast("bigint").alias(k) for k in ("planned", "cached", "executed")), "n_results")


@CATALOG.query(
    "n02_transitions",
    """SELECT * FROM (VALUES ('PENDING', 'RUNNING', true), ('PENDING', 'DONE', false), ('RUNNING', 'DONE', true), ('RUNNING', 'OOM', true), ('FAILED', 'RUNNING', true), ('FAILED', 'DONE', false), ('DONE', 'RUNNING', false), ('NONCONVERGED', 'RUNNING', false)) AS v(before, after, allowed)""",
)
def n02(spark: SparkSession, directory: str) -> DataFrame:
    pairs = [("PENDING", "RUNNING"), ("PENDING", "DONE"), ("RUNNING", "DONE"), ("RUNNING", "OOM"), ("FAILED", "RUNNING"), ("FAILED", "DONE"), ("DONE", "RUNNING"), ("NONCONVERGED", "RUNNING")]
    rows = spark.createDataFrame(pairs, "before string, after string")
    return rows.withColumn("allowed", engine.may_follow(F.col("before"), F.col("after")))


SYSTEM = "You review commits."


@CATALOG.query(
    "k09_prompt_offsets",
    f"""WITH {_SEGMENTS}, t AS (SELECT commit_id, string_agg(marker || ' ' || payload || chr(10), '' ORDER BY f, h, n) AS text FROM mk GROUP BY 1)
    SELECT commit_id, CASE WHEN text <> '' THEN 40 END::INT AS char_offset, (40 + length(text) + 23)::INT AS n_chars FROM t""",
)
def k09(spark: SparkSession, directory: str) -> DataFrame:
    """The rendered text inside a chat prompt, and where it begins: it must stand there once."""
    texts = structure.rendered(parts(spark, directory))
    prompt, offset = structure.chat_prompt(SYSTEM, F.col("text"))
    return texts.select("commit_id", offset.alias("char_offset"), F.length(prompt).alias("n_chars"))


@CATALOG.query(
    "k13_encoded_maps",
    f"""WITH {_SEGMENTS}, {_TOKENS}, m AS (SELECT t.commit_id, t.token_index, count(p.char_start) AS n, any_value(p.line_id) AS owner FROM tok t LEFT JOIN sp p ON p.commit_id = t.commit_id AND p.line_id IS NOT NULL
        AND t.s < p.char_start + length(p.payload) AND t.e > p.char_start WHERE t.token_index < 256 GROUP BY 1, 2)
    SELECT commit_id, 256::INT AS n_positions, (256 - count(*))::INT AS n_padding, count_if(n = 1)::INT AS n_owned FROM m GROUP BY 1""",
)
def k13(spark: SparkSession, directory: str) -> DataFrame:
    """Token maps of a fixed length: the owner of each of the first 256 tokens, then padding (k14: the same of the test split)."""
    first = structure.token_segments(structure.spans(parts(spark, directory))).where("token_from < 256")
    maps = structure.token_map(structure.segment_tokens(first), "commit_id", 256)
    pad = F.size(F.filter("token_map", lambda x: x["category"] == "PADDING"))
    return maps.select("commit_id", F.size("token_map").alias("n_positions"), pad.alias("n_padding"), F.size(F.filter("token_map", lambda x: x["owner"].isNotNull())).alias("n_owned"))


_CUT = f"""{_SEGMENTS}, {_TOKENS}, z AS (SELECT commit_id, count(*) AS n_tokens, max(CASE WHEN token_index = 510 THEN e END) AS at_ FROM tok GROUP BY 1),
    c AS (SELECT z.commit_id, coalesce(min(p.char_start) FILTER (p.line_id IS NOT NULL AND p.char_start < at_ AND at_ <= p.char_start + length(p.payload)), any_value(at_)) AS cut_char
          FROM z JOIN sp p USING (commit_id) WHERE n_tokens > 511 GROUP BY 1)"""


@CATALOG.query(
    "k11_guarded_prompts",
    f"""WITH {_CUT}, t2 AS (SELECT txt.commit_id, CASE WHEN c.cut_char IS NULL THEN text ELSE substr(text, 1, c.cut_char::BIGINT) END AS kept FROM txt LEFT JOIN c USING (commit_id))
    SELECT commit_id, length(kept)::INT AS n_chars, contains(kept, 'rq1_status') OR contains(kept, 'commit_label') AS leaks FROM t2""",
)
def k11(spark: SparkSession, directory: str) -> DataFrame:
    """Rendered and truncated with one place kept free, and whether a forbidden marker is left in the text."""
    p = parts(spark, directory)
    texts = structure.rendered(p)
    cuts = structure.truncate_segments(structure.token_segments(structure.spans(p)), 512, 1)
    kept = structure.truncated_text(texts, cuts)
    return kept.select("commit_id", F.length("text").alias("n_chars"), structure.leaks(F.col("text"), ["rq1_status", "commit_label"]).alias("leaks"))


@CATALOG.query(
    "b16_fully_visible",
    f"""WITH {_CUT}, d AS (SELECT p.line_id FROM sp p JOIN c USING (commit_id) WHERE p.line_id IS NOT NULL AND p.char_start >= c.cut_char)
    SELECT commit_id, bool_and(line_id NOT IN (SELECT line_id FROM d)) AS visible, count(*) AS n_lines FROM lines WHERE status IN ('POSITIVE', 'NEGATIVE') AND line_id IS NOT NULL GROUP BY 1""",
)
def b16(spark: SparkSession, directory: str) -> DataFrame:
    """Commits of which truncation drops no line of the universe."""
    regions = cut(structure.token_segments(structure.spans(parts(spark, directory))))
    cuts = structure.truncate_segments(regions, 512, 1)
    gone = structure.dropped_lines(regions, cuts).select("line_id").distinct().withColumn("__gone", F.lit(True))
    rows = lines(spark, directory).where(F.col("status").isin("POSITIVE", "NEGATIVE") & F.col("line_id").isNotNull()).join(gone, "line_id", "left")
    return rows.groupBy("commit_id").agg(F.bool_and(F.col("__gone").isNull()).alias("visible"), F.count(F.lit(1)).alias("n_lines"))


@CATALOG.query(
    "n09_test_cohorts",
    f"""WITH {LINES}, {COMMITS}, l AS (SELECT commit_id, count_if(status = 'POSITIVE') AS p, count_if(status = 'NEGATIVE') AS q, count_if(status NOT IN ('POSITIVE', 'NEGATIVE')) AS u FROM lines GROUP BY 1)
    SELECT c.commit_id, coalesce(c.is_positive AND p > 0, false) AS localizable, coalesce(c.is_positive AND p > 0 AND q > 0, false) AS rankable, coalesce(c.is_positive AND p > 0 AND u = 0, false) AS complete,
        coalesce(NOT c.is_positive AND coalesce(p, 0) = 0, false) AS clean, coalesce(NOT c.is_positive AND p > 0, false) AS conflicting FROM commits c LEFT JOIN l USING (commit_id) WHERE c.split = 'test'""",
)
def n09(spark: SparkSession, directory: str) -> DataFrame:
    """Test commits with the cohorts that each belongs to, and those whose lines contradict their label."""
    s = F.col("status")
    known = lines(spark, directory).groupBy("commit_id").agg(F.count_if(s == "POSITIVE").alias("p"), F.count_if(s == "NEGATIVE").alias("q"), F.count_if(~s.isin("POSITIVE", "NEGATIVE")).alias("u"))
    return cohorts.test_cohorts(commits(spark, directory).where("split = 'test'"), known)


@CATALOG.query(
    "q12_rehearsal_faithfulness",
    f"""WITH {_PREFIX}, {COMMITS}, m AS (SELECT * FROM commits WHERE split = 'valid' AND is_positive AND tokens IS NOT NULL AND project IS NOT NULL), k0 AS (SELECT *, row_number() OVER (ORDER BY tokens, commit_id) - 1 AS k, count(*) OVER () AS n FROM m),
    q AS (SELECT *, least(3, k // greatest(1, n // 4))::INT AS quartile FROM k0), l0 AS (SELECT *, row_number() OVER (PARTITION BY project, quartile ORDER BY k) = 1 AS lead FROM q),
    p0 AS (SELECT *, (row_number() OVER (ORDER BY NOT lead, CASE WHEN lead THEN project ELSE '' END, quartile, CASE WHEN lead THEN '' ELSE commit_id END) - 1)::INT AS place FROM l0),
    c AS (SELECT commit_id, fraction, abs(sum(effect)) AS impact FROM prefix GROUP BY 1, 2) SELECT commit_id, {settled_sql('avg(impact)')} AS aopc FROM c WHERE commit_id IN (SELECT commit_id FROM p0 WHERE place < 64) GROUP BY 1""",
)
def q12(spark: SparkSession, directory: str) -> DataFrame:
    """Deletion curves of the rehearsal cohort."""
    cohort = cohorts.rehearsal_cohort(members(spark, directory).where("split = 'valid' AND is_positive AND project IS NOT NULL"), 64).select("commit_id")
    few = effects(spark, directory).join(F.broadcast(cohort), "commit_id", "left_semi")  # 64 commits
    curve = faithfulness.absolute_deletion_curve(few, ["commit_id"], FRACTIONS)
    return faithfulness.aopc(curve, ["commit_id"]).withColumn("aopc", settled("aopc"))
