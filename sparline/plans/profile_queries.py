"""Fuller forms of profiles, curves and verdicts, and contents instead of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions import lines as lf, scores as sf
from sparline.operators import audit, diffs, faithfulness, inference, kernels, polarity, ranking, runs, structure
from sparline.plans.audit_queries import _META, _UNITS, meta, units
from sparline.plans.base import COMMITS, HUNKS, LINES, SCORES, UNIT, commits, hunks, lines, scores, settled, settled_sql
from sparline.plans.catalog import Catalog
from sparline.plans.composed_queries import _EXCLUDED, excluded
from sparline.plans.perturbation_queries import _W, _Z, _Z0
from sparline.plans.ranking_queries import _EFFECTS, _POLAR, FRACTIONS, METRICS, effects, metrics
from sparline.plans.text_queries import _DIFF, _SEGMENTS, _TOKENS, _collapse, _mask, _norm, _punct, parts
from sparline.session import cut
from sparline.sources.parquet import table

CATALOG = Catalog()

_TOK = r"coalesce(len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')), 0)"


@CATALOG.query(
    "d29_mapping_stats",
    f"""WITH {_SEGMENTS} SELECT commit_id, sum(3 + {_TOK.format("payload")})::BIGINT AS n_tokens, coalesce(sum({_TOK.format("payload")}) FILTER (line_id IS NOT NULL), 0)::BIGINT AS n_payload, count(line_id) AS n_lines,
    count(line_id) FILTER ({_TOK.format("payload")} = 0) AS n_empty FROM sp GROUP BY 1""",
)
def d29(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens and lines of every rendered commit: all, in the payload of lines, and lines without any."""
    s = structure.token_segments(structure.spans(parts(spark, directory)))
    named = F.col("line_id").isNotNull()
    own = F.col("n_tokens") - 3
    return s.groupBy("commit_id").agg(
        F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.coalesce(F.sum(F.when(named, own)), F.lit(0)).cast("bigint").alias("n_payload"), F.count("line_id").alias("n_lines"), F.count_if(named & (own == 0)).alias("n_empty")
    )


_DROPPED = f"""{_SEGMENTS}, {_TOKENS}, z AS (SELECT commit_id, count(*) AS n_tokens, max(CASE WHEN token_index = 509 THEN e END) AS at_ FROM tok GROUP BY 1),
    c AS (SELECT z.commit_id, coalesce(min(p.char_start) FILTER (p.line_id IS NOT NULL AND p.char_start < at_ AND at_ <= p.char_start + length(p.payload)), any_value(at_)) AS cut_char FROM z JOIN sp p USING (commit_id) WHERE n_tokens > 510 GROUP BY 1),
    d AS (SELECT DISTINCT p.line_id FROM sp p JOIN c USING (commit_id) WHERE p.line_id IS NOT NULL AND p.char_start >= c.cut_char)"""


@CATALOG.query(
    "d31_truncation_by_split",
    f"""WITH {_DROPPED}, k AS (SELECT l.commit_id, count_if(l.line_id IN (SELECT line_id FROM d)) AS lost, count_if(l.status = 'POSITIVE' AND l.line_id IN (SELECT line_id FROM d)) AS lost_positive, count(*) AS n FROM lines l WHERE l.line_id IS NOT NULL GROUP BY 1)
    SELECT c.split, count(*) AS n_commits, count_if(lost > 0) AS n_losing, count_if(lost_positive > 0) AS n_losing_positive, sum(n)::BIGINT AS n_lines, sum(lost)::BIGINT AS n_lost FROM k JOIN commits c USING (commit_id) GROUP BY 1""",
)
def d31(spark: SparkSession, directory: str) -> DataFrame:
    """What truncation takes, from lines to commits to splits."""
    regions = cut(structure.token_segments(structure.spans(parts(spark, directory))))
    gone = structure.dropped_lines(regions, structure.truncate_segments(regions, 512, 2)).select("line_id").distinct().withColumn("__gone", F.lit(True))
    rows = lines(spark, directory).where(F.col("line_id").isNotNull()).join(gone, "line_id", "left")
    lost = F.col("__gone").isNotNull()
    per = rows.groupBy("commit_id").agg(F.count_if(lost).alias("lost"), F.count_if(lost & (F.col("status") == "POSITIVE")).alias("lost_positive"), F.count(F.lit(1)).alias("n"))
    per = per.join(commits(spark, directory).select("commit_id", "split"), "commit_id")
    return per.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_commits"), F.count_if(F.col("lost") > 0).alias("n_losing"), F.count_if(F.col("lost_positive") > 0).alias("n_losing_positive"), F.sum("n").alias("n_lines"), F.sum("lost").alias("n_lost")
    )


@CATALOG.query(
    "d37_ordered_digests",
    f"""WITH {COMMITS}, b AS (SELECT split, substr(commit_id, 1, 3) AS b, sha256(string_agg(commit_id, chr(10) ORDER BY commit_id)) AS h FROM commits WHERE commit_id IS NOT NULL GROUP BY 1, 2)
    SELECT split, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b GROUP BY 1""",
)
def d37(spark: SparkSession, directory: str) -> DataFrame:
    """A digest of the sorted ids of every split, over the digests of 4,096 ranges of ids, so no task holds all."""
    rows = commits(spark, directory).where(F.col("commit_id").isNotNull()).select("split", "commit_id")
    return audit.ordered_digest(rows, ["split"], "commit_id", 3)


@CATALOG.query(
    "d39_curve_means",
    f"""WITH {_EFFECTS}, g AS (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM eff), c AS (SELECT commit_id, fraction, sum(CASE WHEN rk <= greatest(1, ceil(fraction * n)) THEN effect ELSE 0.0 END) AS o
        FROM g, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) AS x(fraction) GROUP BY 1, 2) SELECT commit_id, {settled_sql('avg(o)')} AS deletion, {settled_sql('avg(abs(o))')} AS insertion FROM c GROUP BY 1""",
)
def d39(spark: SparkSession, directory: str) -> DataFrame:
    """Mean signed drop over the fractions, and (d40) mean gain of inserting the same lines."""
    curve = faithfulness.removal_curve(effects(spark, directory), ["commit_id"], FRACTIONS)
    out = curve.groupBy("commit_id").agg(F.coalesce(F.avg("comprehensiveness"), F.lit(0.0)).alias("deletion"), F.coalesce(F.avg("insertion_gain"), F.lit(0.0)).alias("insertion"))
    return out.withColumns({c: settled(c) for c in ("deletion", "insertion")})


@CATALOG.query(
    "g03_intersection_examples",
    f"""WITH {_META}, a AS (SELECT DISTINCT project AS p FROM meta WHERE split = 'train' AND project IS NOT NULL), b AS (SELECT DISTINCT project AS p FROM meta WHERE split = 'test' AND project IS NOT NULL), i AS (SELECT p, sha256(p) AS h FROM a JOIN b USING (p))
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM i) AS n_both, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT h FROM i ORDER BY h LIMIT 5) t) AS examples""",
)
def g03(spark: SparkSession, directory: str) -> DataFrame:
    m = meta(spark, directory).select(F.col("project").alias("p"), "split")
    return audit.intersection(m.where("split = 'train'"), m.where("split = 'test'"), "p", 5)


@CATALOG.query(
    "g05_unseen_projects",
    f"""WITH {_EXCLUDED}, {_META}, x AS (SELECT split, hash, our_label, (SELECT count(*) FROM meta m WHERE m.commit_id = e.hash) AS k FROM excluded e), p AS (SELECT DISTINCT lower(regexp_replace(commit_hash, '^\\s+|\\s+$', '', 'g')) AS hash,
        nullif(nullif(replace(lower(regexp_replace(project, '^\\s+|\\s+$', '', 'g')), '_', '-'), ''), '?') AS project FROM excluded_commits_summary)
    SELECT x.split, p.project, count(DISTINCT x.hash) AS n, bool_and(coalesce(our_label, 0) = 0) AS all_negative FROM x JOIN p USING (hash) WHERE k = 0 GROUP BY 1, 2""".replace("\\\\", "\\"),
)
def g05(spark: SparkSession, directory: str) -> DataFrame:
    """Excluded commits that are not known, by split and project."""
    from sparline.functions.text import commit_key, project_key

    named = table(spark, directory, "excluded_commits_summary").select(commit_key(F.col("commit_hash")).alias("hash"), project_key(F.col("project")).alias("project")).distinct()
    known = meta(spark, directory).select(F.col("commit_id").alias("hash")).distinct()
    rows = excluded(spark, directory).join(known, "hash", "left_anti").join(named, "hash")
    return rows.groupBy("split", "project").agg(F.count_distinct("hash").alias("n"), F.bool_and(F.coalesce("our_label", F.lit(0.0)) == 0).alias("all_negative"))


@CATALOG.query(
    "h25_scores_by_space",
    "SELECT vec_id, s AS space, round(CASE WHEN s = 'logit_contrast' THEN embedding[2]::DOUBLE - embedding[1]::DOUBLE ELSE 1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)) END, 7) AS score FROM embeddings, (VALUES ('logit_contrast'), ('probability')) AS v(s)",
)
def h25(spark: SparkSession, directory: str) -> DataFrame:
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    cells = F.array(*(F.struct(F.lit(s).alias("space"), F.round(sf.score_from_logits(a, b, s), 7).alias("score")) for s in ("logit_contrast", "probability")))
    return table(spark, directory, "embeddings").select("vec_id", F.inline(cells))


@CATALOG.query(
    "i12_guarded_spearman",
    f"""WITH {SCORES}, {LINES}, j AS (SELECT s.commit_id, s.method, s.seed, abs(s.score) AS x, l.tokens AS y FROM scores s JOIN lines l ON l.line_id = s.region_id),
    k AS (SELECT *, rank() OVER (PARTITION BY commit_id, method, seed ORDER BY x) + (count(*) OVER (PARTITION BY commit_id, method, seed, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY commit_id, method, seed ORDER BY y) + (count(*) OVER (PARTITION BY commit_id, method, seed, y) - 1) / 2 AS ry FROM j)
    SELECT commit_id, method, seed, count(*) AS n, round(CASE WHEN count(*) >= 5 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN (avg(rx * ry) - avg(rx) * avg(ry)) / sqrt((avg(rx * rx) - avg(rx) ** 2) * (avg(ry * ry) - avg(ry) ** 2)) END, 5) AS rho FROM k GROUP BY 1, 2, 3""",
)
def i12(spark: SparkSession, directory: str) -> DataFrame:
    """Magnitude against size, null for units of fewer than five lines."""
    size = lines(spark, directory).select(F.col("line_id").alias("region_id"), "tokens")
    rows = scores(spark, directory).join(size, "region_id").withColumn("x", F.abs("score"))
    return inference.spearman(rows, UNIT, "x", "tokens", 5).withColumn("rho", F.round("rho", 5))


@CATALOG.query(
    "m09_metric_spread",
    f"""WITH {METRICS}, s AS (SELECT method, seed, avg(recall_at_effort) AS v FROM metrics WHERE state = 'OK' GROUP BY 1, 2) SELECT method, count(*) AS n, round(avg(v), 9) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE round(stddev_samp(v), 9) END AS sd FROM s GROUP BY 1""",
)
def m09(spark: SparkSession, directory: str) -> DataFrame:
    """Mean and deviation over the seeds' means."""
    per = metrics(spark, directory).where("state = 'OK'").groupBy("method", "seed").agg(F.avg("recall_at_effort").alias("value"))
    out = inference.seed_summary(per, ["method"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


@CATALOG.query(
    "audit_p02_unix_flags",
    f"""WITH {_META}, u AS (SELECT project, split, TRY_CAST(CASE WHEN length(message) % 7 = 0 THEN 'odd' ELSE floor(epoch(author_date))::BIGINT::VARCHAR END AS BIGINT) AS s FROM meta)
    SELECT project, max(s) FILTER (split = 'train') < min(s) FILTER (split = 'valid') AS train_before_valid, max(s) FILTER (split = 'valid') < min(s) FILTER (split = 'test') AS valid_before_test, count(s) AS n_known FROM u GROUP BY 1""",
)
def p02(spark: SparkSession, directory: str) -> DataFrame:
    """Chronology on unix seconds in text, of which some are no numbers: null where either side is unknown."""
    text = F.when(F.length("message") % 7 == 0, "odd").otherwise(F.unix_seconds(F.col("author_date").cast("timestamp")).cast("string"))
    rows = meta(spark, directory).withColumn("s", text.try_cast("bigint"))
    out = audit.chronology(rows, ["project"], "split", "s").join(rows.groupBy("project").agg(F.count("s").alias("n_known")).withColumnRenamed("project", "p"), F.col("project").eqNullSafe(F.col("p")))
    return out.select("project", "train_before_valid", "valid_before_test", "n_known")


@CATALOG.query(
    "audit_p03_order_verdicts",
    f"""WITH {LINES}, a AS (SELECT commit_id, line_id, row_number() OVER (PARTITION BY commit_id ORDER BY position) AS i FROM lines WHERE line_id IS NOT NULL), b AS (SELECT commit_id, line_id, row_number() OVER (PARTITION BY commit_id ORDER BY path, hunk_ordinal, line_ordinal) AS i FROM lines WHERE line_id IS NOT NULL AND status <> 'NOT_IN_RQ1_UNIVERSE'),
    j AS (SELECT coalesce(a.commit_id, b.commit_id) AS commit_id, a.i AS x, b.i AS y FROM a FULL JOIN b ON a.commit_id = b.commit_id AND a.line_id = b.line_id)
    SELECT commit_id, CASE WHEN count(x) = count(*) AND count(y) = count(*) THEN CASE WHEN bool_and(x = y) THEN 'SAME_ORDER' ELSE 'SAME_KEYS' END WHEN count(x) = count(*) OR count(y) = count(*) THEN 'ONE_SIDED' ELSE 'MISMATCH' END AS verdict FROM j GROUP BY 1""",
)
def p03(spark: SparkSession, directory: str) -> DataFrame:
    """Two lists of lines per commit: in the same order, the same in another, one within the other, or neither."""
    from pyspark.sql import Window

    rows = lines(spark, directory).where(F.col("line_id").isNotNull())
    at = lambda order: F.row_number().over(Window.partitionBy("commit_id").orderBy(*order)).alias("i")
    a = rows.select("commit_id", "line_id", at(["position"]))
    b = rows.where("status <> 'NOT_IN_RQ1_UNIVERSE'").select("commit_id", "line_id", at(["path", "hunk_ordinal", "line_ordinal"]))
    return audit.order_verdict(a, b, ["commit_id"], "line_id", "i")


_VARS = """vars AS (SELECT c.commit_id, c.is_positive, 'tokens' AS variable, c.tokens::DOUBLE AS v FROM commits c WHERE c.is_positive IS NOT NULL UNION ALL SELECT c.commit_id, c.is_positive, 'lines', n.lines FROM commits c JOIN n USING (commit_id) WHERE c.is_positive IS NOT NULL
    UNION ALL SELECT c.commit_id, c.is_positive, 'files', n.files FROM commits c JOIN n USING (commit_id) WHERE c.is_positive IS NOT NULL)"""


@CATALOG.query(
    "q07_group_balance",
    f"""WITH {LINES}, {COMMITS}, n AS (SELECT commit_id, count(*)::DOUBLE AS lines, count(DISTINCT path)::DOUBLE AS files FROM lines GROUP BY 1), {_VARS},
    s AS (SELECT variable, avg(v) FILTER (is_positive) AS a, avg(v) FILTER (NOT is_positive) AS b, stddev_pop(v) FILTER (is_positive) AS sa, stddev_pop(v) FILTER (NOT is_positive) AS sb FROM vars WHERE v IS NOT NULL GROUP BY 1)
    SELECT variable, round(a, 6) AS mean_1, round(b, 6) AS mean_0, round((a - b) / sqrt((sa * sa + sb * sb) / 2), 6) AS smd, abs((a - b) / sqrt((sa * sa + sb * sb) / 2)) >= 0.25 AS unbalanced FROM s""",
)
def q07(spark: SparkSession, directory: str) -> DataFrame:
    """Positive and negative commits in several variables, with the standardised difference and whether it is large."""
    n = lines(spark, directory).groupBy("commit_id").agg(F.count(F.lit(1)).cast("double").alias("lines"), F.count_distinct("path").cast("double").alias("files"))
    rows = commits(spark, directory).where(F.col("is_positive").isNotNull()).join(n, "commit_id", "left").select("is_positive", F.col("tokens").cast("double").alias("tokens"), "lines", "files")
    out = inference.group_balance(rows, "is_positive", ["tokens", "lines", "files"], 0.25)
    return out.select("variable", F.round("mean_1", 6).alias("mean_1"), F.round("mean_0", 6).alias("mean_0"), F.round("smd", 6).alias("smd"), "unbalanced")


@CATALOG.query(
    "b15_visible_order",
    f"""WITH {_DROPPED} SELECT commit_id, sha256(string_agg(line_id, chr(10) ORDER BY position)) AS digest, count(*) AS n FROM lines WHERE line_id IS NOT NULL AND line_id NOT IN (SELECT line_id FROM d) GROUP BY 1""",
)
def b15(spark: SparkSession, directory: str) -> DataFrame:
    """The lines that truncation leaves, in order, by a digest of their list."""
    regions = cut(structure.token_segments(structure.spans(parts(spark, directory))))
    gone = structure.dropped_lines(regions, structure.truncate_segments(regions, 512, 2)).select("line_id")
    left = lines(spark, directory).where(F.col("line_id").isNotNull()).join(gone, "line_id", "left_anti")
    held = left.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("position", "line_id"))).alias("ls"))
    return held.select("commit_id", F.sha2(F.array_join(F.transform("ls", lambda x: x["line_id"]), "\n"), 256).alias("digest"), F.size("ls").cast("bigint").alias("n"))


@CATALOG.query(
    "k04_record_digests",
    f"""WITH {LINES} SELECT commit_id, sha256(string_agg(path || '#' || hunk_ordinal || '#' || line_ordinal || '#' || change_type || '#' || coalesce(raw_text, ''), chr(10) ORDER BY file_ordinal, path, hunk_ordinal, line_ordinal)) AS digest FROM lines GROUP BY 1""",
)
def k04(spark: SparkSession, directory: str) -> DataFrame:
    """Nested records read out in their own order, as a digest of all that is in them (k05: the files and hunks as rows)."""
    files = structure.nested_records(lines(spark, directory).select("commit_id", "path", "file_ordinal", "hunk_ordinal", "line_ordinal", "change_type", "raw_text"))
    line = lambda f, h, x: F.concat_ws("#", f["path"], h["hunk_ordinal"].cast("string"), x["line_ordinal"].cast("string"), x["change_type"], F.coalesce(x["raw_text"], F.lit("")))
    each = F.flatten(F.flatten(F.transform("files", lambda f: F.transform(f["hunks"], lambda h: F.transform(h["lines"], lambda x: line(f, h, x))))))
    return files.select("commit_id", F.sha2(F.array_join(each, "\n"), 256).alias("digest"))


@CATALOG.query(
    "k15_text_digests",
    f"""WITH {HUNKS}, k AS (SELECT commit_id, path, hunk_ordinal, ls, list_filter(list_transform(ls, lambda x: x.stable_line_id), lambda i: ('0x' || substr(sha256(i), 1, 2))::INT < 64) AS ids FROM hunks)
    SELECT commit_id, path, hunk_ordinal, sha256(array_to_string(list_transform(ls, lambda x: CASE WHEN coalesce(list_contains(ids, x.stable_line_id), false) THEN '' ELSE coalesce(x.raw_text, '') END), chr(10))) AS blanked,
        sha256(array_to_string(list_transform(ls, lambda x: coalesce(x.raw_text, '')), chr(10))) AS restored, sha256(array_to_string(list_transform(list_filter(ls, lambda x: x.stable_line_id IS NULL OR NOT list_contains(ids, x.stable_line_id)), lambda x: coalesce(x.raw_text, '')), chr(10))) AS deleted,
        array_to_string(list_transform(ls, lambda x: CASE x.change_type WHEN 'added' THEN 'deleted' WHEN 'deleted' THEN 'added' ELSE x.change_type END), ',') AS swapped FROM k""",
)
def k15(spark: SparkSession, directory: str) -> DataFrame:
    """A hashed quarter of the lines of each hunk blanked, restored, deleted, and all kinds swapped: the texts themselves."""
    pick = F.filter(F.transform("lines", lambda x: x["stable_line_id"]), lambda i: F.conv(F.substring(F.sha2(i, 256), 1, 2), 16, 10).cast("int") < 64)
    h = hunks(spark, directory).withColumn("ids", pick)
    blanked = structure.blank_lines(F.col("lines"), F.col("ids"))
    digest = lambda a: F.sha2(F.array_join(F.transform(a, lambda x: F.coalesce(x["raw_text"], F.lit(""))), "\n"), 256)
    kinds = F.array_join(F.transform(structure.swap_changes(F.col("lines")), lambda x: x["change_type"]), ",")
    restored = structure.restore_lines(blanked, F.col("lines"), F.col("ids"))
    deleted = structure.delete_lines(F.col("lines"), F.col("ids"))
    return h.select("commit_id", "path", "hunk_ordinal", digest(blanked).alias("blanked"), digest(restored).alias("restored"), digest(deleted).alias("deleted"), kinds.alias("swapped"))


@CATALOG.query(
    "k08_message_digests",
    f"""WITH {_SEGMENTS}, t AS (SELECT commit_id, string_agg(marker || ' ' || payload || chr(10), '' ORDER BY f, h, n) AS text FROM mk GROUP BY 1)
    SELECT commit_id, sha256('system:S' || chr(10) || 'user:' || text) AS chat, sha256(replace(replace(replace(replace(replace(replace(text, '[MSG]', '     '), '[FILE]', '      '), '[HUNK]', '      '), '[ADD]', '     '), '[DEL]', '     '), '[CTX]', '     ')) AS blanked FROM t""",
)
def k08(spark: SparkSession, directory: str) -> DataFrame:
    """The chat messages of every rendered commit, and (k25) the text with its markers blanked."""
    texts = structure.rendered(parts(spark, directory))
    said = F.array_join(F.transform(structure.chat_messages("S", F.col("text")), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return texts.select("commit_id", F.sha2(said, 256).alias("chat"), F.sha2(structure.blank_markers(F.col("text")), 256).alias("blanked"))


@CATALOG.query(
    "h03_form_digests",
    f"""WITH {LINES}, t AS (SELECT DISTINCT raw_text AS x FROM lines WHERE raw_text IS NOT NULL), f AS (SELECT x, {_norm("x")} AS n, {_punct("x")} AS p, {_collapse("x")} AS c, {_punct("replace(x, '_', ' ')")} AS s, {_mask("x")} AS m FROM t)
    SELECT x, sha256(array_to_string(list_sort(list_distinct([x, p, s, c, n, {_punct("n")}, {_norm("p")}])), chr(10))) AS variants, sha256(array_to_string(list_sort(list_distinct([x, c, p, s, n, m, {_mask("p")}, {_mask("c")}, {_punct("n")}])), chr(10))) AS signatures FROM f""",
)
def h03(spark: SparkSession, directory: str) -> DataFrame:
    """The forms of every text and (h05) its signatures, as sorted lists."""
    t = lines(spark, directory).where(F.col("raw_text").isNotNull()).select(F.col("raw_text").alias("x")).distinct()
    digest = lambda a: F.sha2(F.array_join(F.array_sort(a), "\n"), 256)
    return t.select("x", digest(lf.text_variants(F.col("x"))).alias("variants"), digest(lf.signatures(F.col("x"))).alias("signatures"))


@CATALOG.query("k30_added_code", f"SELECT * FROM ({_DIFF}) q WHERE change_type = 'added' AND path LIKE '%.java'")
def k30(spark: SparkSession, directory: str) -> DataFrame:
    """The added lines of Java files in all diffs inside the documents."""
    return diffs.added_code(table(spark, directory, "documents"), "doc_id", "text")


@CATALOG.query(
    "o36_completeness_modes",
    f"""SELECT k AS mode, count(*) AS n, count(*) AS n_complete FROM embeddings, (VALUES ('COMBINED'), ('RELATIVE')) AS v(k) GROUP BY 1""",
)
def o36(spark: SparkSession, directory: str) -> DataFrame:
    """Path integrals with enough steps add up in either mode."""
    start = kernels.baseline(F.col("embedding"), "ZERO_EMBEDDING")
    out = kernels.path_gradient(table(spark, directory, "embeddings"), "vec_id", "embedding", start, _W, 20)
    delta = F.col("f_input") - F.col("f_baseline")
    cells = F.array(*(F.struct(F.lit(m).alias("mode"), sf.completeness_by_mode(F.col("e_abs"), F.col("e_rel"), delta, m).alias("ok")) for m in ("COMBINED", "RELATIVE")))
    return out.select(F.inline(cells)).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_complete"))


@CATALOG.query(
    "n15_unit_results",
    f"""WITH {METRICS}, q AS (WITH {_POLAR} SELECT commit_id, method, seed, count_if(polarity = 'POSITIVE') AS n_up, count_if(polarity = 'NEGATIVE') AS n_down FROM c GROUP BY 1, 2, 3)
    SELECT commit_id, method, seed, state, ifa::BIGINT AS ifa, round(recall_at_effort, 9) AS recall_at_effort, n_up, n_down FROM metrics JOIN q USING (commit_id, method, seed)""",
)
def n15(spark: SparkSession, directory: str) -> DataFrame:
    """Every unit with its ranking metrics and the signs of its scores, as a run writes it."""
    rows = scores(spark, directory)
    signs = polarity.classify(rows, UNIT).groupBy(*UNIT).agg(F.count_if(F.col("polarity") == "POSITIVE").alias("n_up"), F.count_if(F.col("polarity") == "NEGATIVE").alias("n_down"))
    m = metrics(spark, directory).select(*UNIT, "state", F.col("ifa").cast("bigint").alias("ifa"), F.round("recall_at_effort", 9).alias("recall_at_effort"))
    return m.join(signs, UNIT)


@CATALOG.query(
    "n17_run_summary",
    f"""WITH {_UNITS}, k AS (SELECT method, commit_id, count_if(code = 'OK') AS ok, count(*) AS n FROM units GROUP BY 1, 2) SELECT method, sum(n)::BIGINT AS n_units, sum(ok)::BIGINT AS n_ok, count_if(ok = 3) AS n_complete, round(sum(ok) / sum(n), 9) AS share_ok FROM k GROUP BY 1""",
)
def n17(spark: SparkSession, directory: str) -> DataFrame:
    """Units, faultless ones and commits with all seeds, per method."""
    per = units(spark, directory).groupBy("method", "commit_id").agg(F.count_if(F.col("code") == "OK").alias("ok"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy("method").agg(F.sum("n").alias("n_units"), F.sum("ok").alias("n_ok"), F.count_if(F.col("ok") == 3).alias("n_complete"))
    return out.withColumn("share_ok", F.round(F.col("n_ok") / F.col("n_units"), 9))


@CATALOG.query(
    "o11_changes_profile",
    f"""WITH {_META} SELECT split, count(*) AS n, count_if(message IS NULL) AS n_null, count_if(message = '') AS n_empty, count_if(is_positive) AS n_positive, count(DISTINCT sha256(message)) AS n_contents, round(quantile_cont(length(message), 0.5), 6) AS median_length, max(length(message)) AS max_length FROM meta GROUP BY 1""",
)
def o11(spark: SparkSession, directory: str) -> DataFrame:
    """Labels, null and empty messages, contents and lengths per split."""
    m = meta(spark, directory)
    n = F.length("message")
    return m.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("message").isNull()).alias("n_null"), F.count_if(F.col("message") == "").alias("n_empty"), F.count_if("is_positive").alias("n_positive"),
        F.count_distinct(F.sha2("message", 256)).alias("n_contents"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median_length"), F.max(n).alias("max_length"),
    )


_ROLES = {"commit_id": "ID", "project": "GROUP", "visible_token_count": "OTHER", "split": "GROUP", "is_positive": "LABEL", "commit_message": "OTHER", "author_date": "TIME", "ingested_at": "TIME", "removed_at": "TIME"}


@CATALOG.query("o12_column_roles", " UNION ALL ".join(f"SELECT '{c}' AS column, '{r}' AS role, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM commit_meta" for c, r in _ROLES.items()))
def o12(spark: SparkSession, directory: str) -> DataFrame:
    return audit.column_roles(table(spark, directory, "commit_meta"))
