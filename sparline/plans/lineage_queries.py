"""How label rows become line labels: matching, classes, coverage and what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparline.functions import lines as lf
from sparline.functions.text import commit_key, trimmed
from sparline.operators import linkage
from sparline.operators.alignment import align, consume_once
from sparline.plans.audit_queries import _META, meta
from sparline.plans.base import LINES, lines
from sparline.plans.catalog import Catalog
from sparline.plans.text_queries import _collapse, _distinct, _mask, _norm, _punct
from sparline.sources.parquet import table

CATALOG = Catalog()

_ID = r"lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g'))"
_T = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_POL = f"""pol AS (SELECT row_id, {_ID} AS commit_id, idx, lower({_T.format('changed_type')}) AS changed_type, label, raw_changed_line AS raw, changed_line AS changed, {_collapse("raw_changed_line")} AS norm FROM policy_a_rows)"""
_BR = f"""br AS (SELECT row_id, {_ID} AS commit_id, idx, label, upper({_T.format('mapping_status')}) AS status, {_T.format('canonical_line_id')} AS line_id, file_path AS path, hunk_index, new_lineno, occurrence_index AS occ FROM bridge_results)"""
_MAPPED = "mapped AS (SELECT line_id, max(label) AS label FROM br WHERE line_id IS NOT NULL AND line_id NOT IN ('', 'NA') AND coalesce(status, '') NOT IN ('AMBIGUOUS', 'UNRESOLVED') GROUP BY 1)"


def pol(spark: SparkSession, directory: str) -> DataFrame:
    raw = F.col("raw_changed_line")
    return table(spark, directory, "policy_a_rows").select(
        "row_id", commit_key(F.col("commit_id")).alias("commit_id"), "idx", F.lower(trimmed(F.col("changed_type"))).alias("changed_type"), "label",
        raw.alias("raw"), F.col("changed_line").alias("changed"), lf.collapse(raw).alias("norm"),
    )


def br(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "bridge_results").select(
        "row_id", commit_key(F.col("commit_id")).alias("commit_id"), "idx", "label", F.upper(trimmed(F.col("mapping_status"))).alias("status"),
        trimmed(F.col("canonical_line_id")).alias("line_id"), F.col("file_path").alias("path"), "hunk_index", "new_lineno", F.col("occurrence_index").alias("occ"),
    )


def mapped(rows: DataFrame) -> DataFrame:
    named = F.col("line_id").isNotNull() & ~F.col("line_id").isin("", "NA") & ~F.coalesce("status", F.lit("")).isin("AMBIGUOUS", "UNRESOLVED")
    return rows.where(named).groupBy("line_id").agg(F.max("label").alias("label"))


@CATALOG.query(
    "b07_label_status",
    f"""WITH {LINES}, {_BR}, {_MAPPED} SELECT l.line_id, CASE WHEN m.line_id IS NULL OR m.label IS NULL OR m.label NOT IN (0, 1) THEN 'NOT_IN_RQ1_UNIVERSE' WHEN m.label = 1 THEN 'RQ1_POSITIVE' ELSE 'RQ1_NEGATIVE' END AS label_status
    FROM lines l LEFT JOIN mapped m ON m.line_id = l.line_id WHERE l.line_id IS NOT NULL""",
)
def b07(spark: SparkSession, directory: str) -> DataFrame:
    """Every line of every diff against the ids that label rows were mapped to."""
    known = mapped(br(spark, directory)).withColumn("in_universe", F.lit(True))
    rows = lines(spark, directory).where(F.col("line_id").isNotNull()).select("line_id").join(known, "line_id", "left")
    return rows.select("line_id", linkage.label_status(F.col("in_universe"), F.col("label")).alias("label_status"))


@CATALOG.query(
    "q09_status_histogram",
    f"""WITH {LINES}, {_BR}, {_MAPPED}, k AS (SELECT change_type, (SELECT 1 FROM mapped m WHERE m.line_id = l.line_id AND m.label = 1) AS p, (SELECT 1 FROM mapped m WHERE m.line_id = l.line_id AND m.label = 0) AS n FROM lines l WHERE line_id IS NOT NULL)
    SELECT change_type, coalesce(sum(p), 0)::BIGINT AS n_positive, coalesce(sum(n), 0)::BIGINT AS n_negative, count(*) AS n FROM k GROUP BY 1""",
)
def q09(spark: SparkSession, directory: str) -> DataFrame:
    known = mapped(br(spark, directory)).withColumn("in_universe", F.lit(True))
    rows = lines(spark, directory).where(F.col("line_id").isNotNull()).select("line_id", "change_type").join(known, "line_id", "left")
    s = linkage.label_status(F.col("in_universe"), F.col("label"))
    return rows.groupBy("change_type").agg(F.count_if(s == "RQ1_POSITIVE").alias("n_positive"), F.count_if(s == "RQ1_NEGATIVE").alias("n_negative"), F.count(F.lit(1)).alias("n"))


_CODE = r"path LIKE '%.java' AND NOT coalesce(regexp_matches(regexp_replace(raw_text, '^\s+|\s+$', '', 'g'), '^(//|/\*|\*)|\*/$|^$'), false)"


@CATALOG.query(
    "b12_conflict_classes",
    rf"""WITH {LINES}, {_POL}, t AS (SELECT commit_id, {_collapse("raw_text")} AS norm, change_type, {_CODE} AS code FROM lines),
    k AS (SELECT row_id, commit_id, norm, EXISTS (SELECT 1 FROM t WHERE t.commit_id = p.commit_id AND t.norm = p.norm AND change_type = 'added' AND code) AS f,
        EXISTS (SELECT 1 FROM t WHERE t.commit_id = p.commit_id AND t.norm = p.norm AND change_type = 'added') AS u, EXISTS (SELECT 1 FROM t WHERE t.commit_id = p.commit_id AND t.norm = p.norm AND change_type <> 'deleted') AS c,
        EXISTS (SELECT 1 FROM t WHERE t.commit_id = p.commit_id AND t.norm = p.norm AND change_type <> 'added') AS q FROM pol p WHERE raw IS NOT NULL)
    SELECT row_id, CASE WHEN u AND NOT f THEN 'LINE_PRESENT_BUT_FILTERED' WHEN u THEN 'PRESENT_IN_DIFF' WHEN c AND NOT q THEN 'LINE_PRESENT_IN_CHILD_ONLY' WHEN q AND NOT c THEN 'LINE_PRESENT_IN_PARENT_ONLY'
        WHEN c THEN 'LINE_PRESENT_BOTH_BLOBS_NOT_IN_DIFF' ELSE 'NO_RAW_GIT_TEXT_MATCH' END AS taxonomy,
        CASE WHEN f THEN 'RECOVERED' WHEN u THEN 'UNRESOLVED' ELSE 'DATASET_CONFLICT' END AS final FROM k""",
)
def b12(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows by where their text is found (q01), and the state that leaves them in (q05)."""
    kind = F.col("change_type")
    code = lf.is_code_file(F.col("path")) & ~F.coalesce(lf.is_comment_or_blank(F.col("raw_text")), F.lit(False))
    where = {"f": (kind == "added") & code, "u": kind == "added", "c": kind != "deleted", "p": kind != "added"}
    texts = lines(spark, directory).withColumn("norm", lf.collapse(F.col("raw_text"))).groupBy("commit_id", "norm").agg(*(F.bool_or(c).alias(n) for n, c in where.items()))
    rows = pol(spark, directory).where(F.col("raw").isNotNull()).select("row_id", "commit_id", "norm").join(texts, ["commit_id", "norm"], "left")
    f, u, c, p = (F.coalesce(n, F.lit(False)) for n in where)
    rows = rows.select("row_id", linkage.conflict_class(f, u, c, p).alias("taxonomy"), f.alias("recovered"))
    return rows.select("row_id", "taxonomy", linkage.final_class(F.col("taxonomy"), F.lit(False), F.col("recovered")).alias("final"))


def label_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows with a file, as far as the bridge names one: commit_id, path, change_type, place, text."""
    files = br(spark, directory).where(F.col("path").isNotNull()).groupBy("commit_id", "idx").agg(F.min("path").alias("path"))
    rows = pol(spark, directory).join(files, ["commit_id", "idx"])
    return rows.select("commit_id", "path", F.col("changed_type").alias("change_type"), F.col("row_id").alias("place"), F.col("raw").alias("text"))


def diff_rows(spark: SparkSession, directory: str) -> DataFrame:
    rows = lines(spark, directory).where(F.col("position").isNotNull())
    return rows.select("commit_id", "path", "change_type", F.col("position").cast("bigint").alias("place"), F.col("raw_text").alias("text"), "line_id")


@CATALOG.query("c06_file_alignment")
def c06(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows assigned to lines of the same file and kind of change; only equally many open rows and lines are zipped."""
    unit = ["commit_id", "path", "change_type"]
    resolved = linkage.resolve_paths(label_rows(spark, directory), diff_rows(spark, directory).withColumnRenamed("path", "known"), ["commit_id"], "path", "known")
    left = resolved.where(F.col("resolved").isNotNull()).select("commit_id", F.col("resolved").alias("path"), "change_type", "place", "text")
    return align(left, diff_rows(spark, directory), unit, prefix=False)


@CATALOG.query("o02_enhanced_alignment")
def o02(spark: SparkSession, directory: str) -> DataFrame:
    """c05 under the larger set of forms."""
    left = pol(spark, directory).where(F.col("commit_id").isNotNull()).select("commit_id", F.col("row_id").alias("place"), F.col("raw").alias("text"))
    return align(left, diff_rows(spark, directory), ["commit_id"], forms=lf.enhanced_variants)


@CATALOG.query("audit_p13_consumed_positives")
def p13(spark: SparkSession, directory: str) -> DataFrame:
    """Positive label rows, each taking the only unused added line of its commit with one of its forms."""
    left = pol(spark, directory).where("label = 1 AND commit_id IS NOT NULL").select("commit_id", F.col("row_id").alias("place"), F.col("raw").alias("text"))
    return consume_once(left, diff_rows(spark, directory).where("change_type = 'added'"), ["commit_id"], forms=lf.line_variants)


@CATALOG.query("q02_accepted_candidates")
def q02(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows taking the only free line of code or, without any, the only free line of another kind."""
    left = pol(spark, directory).where(F.col("commit_id").isNotNull()).select("commit_id", F.col("row_id").alias("place"), F.col("raw").alias("text"))
    code = lf.is_code_file(F.col("path")) & ~F.coalesce(lf.is_comment_or_blank(F.col("text")), F.lit(False))
    return consume_once(left, diff_rows(spark, directory).where("change_type = 'added'"), ["commit_id"], rank=F.when(code, 0).otherwise(1))


@CATALOG.query(
    "c10_path_classes",
    r"""SELECT k, count(*) AS n FROM (SELECT CASE WHEN canonical_path = old_path THEN 'EXACT' WHEN regexp_replace(replace(canonical_path, '\', '/'), '^(\./)+', '') = regexp_replace(replace(old_path, '\', '/'), '^(\./)+', '') THEN 'NORMALIZED'
        WHEN ends_with(replace(canonical_path, '\', '/'), '/' || replace(old_path, '\', '/')) OR ends_with(replace(old_path, '\', '/'), '/' || replace(canonical_path, '\', '/')) THEN 'SUFFIX' END AS k FROM hunk_specs) q GROUP BY 1""",
)
def c10(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "hunk_specs").select(lf.path_class(F.col("canonical_path"), F.col("old_path")).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "o01_chained_links",
    f"""WITH {LINES}, {_POL}, {_BR}, a AS (SELECT p.row_id, min(l.line_id) AS line_id FROM pol p JOIN lines l ON l.commit_id = p.commit_id AND {_mask("l.raw_text")} = p.changed AND l.change_type = 'added' AND l.line_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT l.line_id) = 1),
    b AS (SELECT line_id, min(row_id) AS bridge_row FROM br WHERE line_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT row_id) = 1)
    SELECT p.row_id, a.line_id, b.bridge_row FROM pol p LEFT JOIN a USING (row_id) LEFT JOIN b ON b.line_id = a.line_id""",
)
def o01(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows to bridge rows, over the only line whose masked text is the row's and the only bridge row of that line."""
    rows = pol(spark, directory)
    added = lines(spark, directory).where("change_type = 'added' AND line_id IS NOT NULL").select("commit_id", lf.mask_literals(F.col("raw_text")).alias("changed"), "line_id")
    first = rows.select("row_id", "commit_id", "changed").join(added, ["commit_id", "changed"]).select("row_id", "line_id")
    second = br(spark, directory).where(F.col("line_id").isNotNull()).select("line_id", F.col("row_id").alias("bridge_row"))
    return linkage.chained(rows.select("row_id"), first, second, "row_id", "line_id", "bridge_row").select("row_id", "line_id", "bridge_row")


@CATALOG.query(
    "o03_form_counts",
    f"""WITH {LINES}, t AS (SELECT DISTINCT raw_text AS x FROM lines WHERE raw_text IS NOT NULL), f AS (SELECT x, {_norm("x")} AS n, {_punct("x")} AS p, {_collapse("x")} AS c, {_punct("replace(x, '_', ' ')")} AS s FROM t)
    SELECT x, {_distinct("x", "p", "s", "c", "n", _punct("n"), _norm("p"))}::INT AS n_enhanced, {_distinct("x", "p", "s", "c")}::INT AS n_plain FROM f""",
)
def o03(spark: SparkSession, directory: str) -> DataFrame:
    """How many forms each text has in the enhanced and (o34) in the plain set."""
    t = lines(spark, directory).where(F.col("raw_text").isNotNull()).select(F.col("raw_text").alias("x")).distinct()
    return t.select("x", F.size(lf.enhanced_variants(F.col("x"))).alias("n_enhanced"), F.size(lf.line_variants(F.col("x"))).alias("n_plain"))


@CATALOG.query(
    "o05_flattened_files",
    f"""WITH {LINES} SELECT line_id, (row_number() OVER (PARTITION BY commit_id, path ORDER BY hunk_ordinal, line_ordinal) - 1)::INT AS ordinal FROM lines WHERE change_type = 'added' AND line_id IS NOT NULL""",
)
def o05(spark: SparkSession, directory: str) -> DataFrame:
    """Maps of file to added lines, taken apart again with the place of each line in its file."""
    rows = lines(spark, directory).where("change_type = 'added' AND line_id IS NOT NULL")
    held = rows.groupBy("commit_id", "path").agg(F.array_sort(F.collect_list(F.struct("hunk_ordinal", "line_ordinal", "line_id"))).alias("ls"))
    return held.select(F.posexplode("ls").alias("ordinal", "l")).select("l.line_id", "ordinal")


@CATALOG.query(
    "h48_added_texts",
    f"""WITH {LINES} SELECT commit_id, path, hunk_ordinal, count(*) FILTER (change_type = 'added')::INT AS n, coalesce(sum(length(coalesce(raw_text, ''))) FILTER (change_type = 'added'), 0)::BIGINT AS n_chars FROM lines GROUP BY 1, 2, 3""",
)
def h48(spark: SparkSession, directory: str) -> DataFrame:
    """Hunks as arrays that alternate kinds and texts, of which the added texts are kept."""
    rows = lines(spark, directory).select("commit_id", "path", "hunk_ordinal", "line_ordinal", "change_type", F.coalesce("raw_text", F.lit("")).alias("t"))
    held = rows.groupBy("commit_id", "path", "hunk_ordinal").agg(F.array_sort(F.collect_list(F.struct("line_ordinal", "change_type", "t"))).alias("ls"))
    added = lf.added_texts(F.flatten(F.transform("ls", lambda x: F.array(x["change_type"], x["t"]))))
    total = F.aggregate(added, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return held.select("commit_id", "path", "hunk_ordinal", F.size(added).alias("n"), total.alias("n_chars"))


@CATALOG.query(
    "audit_p17_availability",
    f"""WITH {LINES}, {_META}, g AS (SELECT commit_id, bool_or(n > 1) AS repeats FROM (SELECT commit_id, change_type, raw_text, count(*) AS n FROM lines WHERE change_type <> 'context' GROUP BY 1, 2, 3) x GROUP BY 1)
    SELECT split, count(*) AS n, count_if(project IS NULL) AS n_unresolved, count_if(project IS NOT NULL AND g.commit_id IS NULL) AS n_missing, count_if(project IS NOT NULL AND g.commit_id IS NOT NULL) AS n_found,
        count_if(project IS NOT NULL AND coalesce(repeats, false)) AS n_repeats FROM meta m LEFT JOIN g USING (commit_id) GROUP BY 1""",
)
def p17(spark: SparkSession, directory: str) -> DataFrame:
    """Per split: rows whose project or diff is not known, and found ones with texts that occur several times."""
    changed = lines(spark, directory).where("change_type <> 'context'").groupBy("commit_id", "change_type", "raw_text").agg((F.count(F.lit(1)) > 1).alias("m"))
    diff = changed.groupBy("commit_id").agg(F.bool_or("m").alias("repeats"), F.lit(True).alias("there"))
    project, there = F.col("project").isNotNull(), F.coalesce("there", F.lit(False))
    rows = meta(spark, directory).join(diff, "commit_id", "left")
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~project).alias("n_unresolved"), F.count_if(project & ~there).alias("n_missing"), F.count_if(project & there).alias("n_found"),
        F.count_if(project & F.coalesce("repeats", F.lit(False))).alias("n_repeats"),
    )


@CATALOG.query(
    "audit_p18_mapping_classes",
    f"""WITH {LINES}, {_POL}, t AS (SELECT commit_id, change_type, {_collapse("raw_text")} AS norm, count(*) AS n FROM lines GROUP BY ALL),
    m AS (SELECT p.commit_id, p.label, coalesce(t.n, 0) AS n FROM pol p LEFT JOIN t ON t.commit_id = p.commit_id AND t.change_type = p.changed_type AND t.norm = p.norm WHERE p.commit_id IS NOT NULL)
    SELECT commit_id, count_if(n = 1) AS n_unique, count_if(n > 1) AS n_ambiguous, count_if(n = 0) AS n_missing, CASE WHEN bool_and(n = 1) THEN 'FULLY_MAPPED' WHEN count_if(label = 1 AND n <> 1) = 0 THEN 'PARTIALLY_MAPPED'
        WHEN count_if(label = 1 AND n > 1) > 0 THEN 'AMBIGUOUS' ELSE 'PARTIALLY_MAPPED' END AS class FROM m GROUP BY 1""",
)
def p18(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows of a commit by how many lines have their text, and the class that makes of the commit."""
    texts = lines(spark, directory).select("commit_id", F.col("change_type").alias("changed_type"), lf.collapse(F.col("raw_text")).alias("norm"))
    rows = linkage.match_by_count(pol(spark, directory).where(F.col("commit_id").isNotNull()), texts.withColumn("one", F.lit(1)), ["commit_id", "changed_type", "norm"], "one")
    n, positive = F.col("n_matches"), F.coalesce(F.col("label") == 1, F.lit(False))
    cls = F.when(F.bool_and(n == 1), "FULLY_MAPPED").when(F.count_if(positive & (n != 1)) == 0, "PARTIALLY_MAPPED").when(F.count_if(positive & (n > 1)) > 0, "AMBIGUOUS").otherwise("PARTIALLY_MAPPED")
    return rows.groupBy("commit_id").agg(F.count_if(n == 1).alias("n_unique"), F.count_if(n > 1).alias("n_ambiguous"), F.count_if(n == 0).alias("n_missing"), cls.alias("class"))


@CATALOG.query(
    "audit_p19_coverage",
    f"""WITH {_BR}, m AS (SELECT * FROM br WHERE line_id IS NOT NULL AND line_id NOT IN ('', 'NA')) SELECT count(*) AS n, round(100 * avg((path IS NOT NULL)::INT), 6) AS path_pct, round(100 * avg((hunk_index IS NOT NULL)::INT), 6) AS hunk_pct,
    round(100 * avg((new_lineno IS NOT NULL)::INT), 6) AS new_pct, count(DISTINCT line_id) = count(*) AS ids_unique FROM m""",
)
def p19(spark: SparkSession, directory: str) -> DataFrame:
    rows = br(spark, directory).where(F.col("line_id").isNotNull() & ~F.col("line_id").isin("", "NA"))
    pct = lambda c, n: F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 6).alias(n)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), pct("path", "path_pct"), pct("hunk_index", "hunk_pct"), pct("new_lineno", "new_pct"), (F.count_distinct("line_id") == n).alias("ids_unique"))


@CATALOG.query(
    "audit_p20_residual_keys",
    f"""WITH {_BR} SELECT commit_id, coalesce(string_agg(DISTINCT idx::VARCHAR, ',' ORDER BY idx::VARCHAR) FILTER (status IN ('AMBIGUOUS', 'UNRESOLVED')), '') AS residual, count(DISTINCT line_id) FILTER (line_id NOT IN ('', 'NA')) AS n_used FROM br
    WHERE commit_id IS NOT NULL GROUP BY 1""",
)
def p20(spark: SparkSession, directory: str) -> DataFrame:
    """Per commit the keys that are still open and how many ids are used already."""
    open_ = F.when(F.col("status").isin("AMBIGUOUS", "UNRESOLVED"), F.col("idx").cast("string"))
    used = F.when(~F.col("line_id").isin("", "NA"), F.col("line_id"))
    rows = br(spark, directory).where(F.col("commit_id").isNotNull())
    return rows.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set(open_)), ",").alias("residual"), F.count_distinct(used).alias("n_used"))


@CATALOG.query(
    "audit_p21_anchors",
    f"""WITH {LINES}, {_POL}, {_BR}, a AS (SELECT commit_id, path, hunk_ordinal, new_lineno, occurrence_index, min(line_id) AS line_id FROM lines WHERE line_id IS NOT NULL AND new_lineno IS NOT NULL GROUP BY ALL),
    u AS (SELECT commit_id, {_collapse("raw_text")} AS norm, min(line_id) AS line_id FROM lines WHERE line_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
    r AS (SELECT commit_id, idx, min(norm) AS norm FROM pol WHERE norm IS NOT NULL GROUP BY 1, 2)
    SELECT b.row_id, coalesce(a.line_id, u.line_id) AS anchor, CASE WHEN a.line_id IS NOT NULL THEN 'PLACE' WHEN u.line_id IS NOT NULL THEN 'TEXT' ELSE 'NONE' END AS how FROM br b
    LEFT JOIN a ON a.commit_id = b.commit_id AND a.path = b.path AND a.hunk_ordinal = b.hunk_index AND a.new_lineno = b.new_lineno AND a.occurrence_index = b.occ LEFT JOIN r ON r.commit_id = b.commit_id AND r.idx = b.idx
    LEFT JOIN u ON u.commit_id = r.commit_id AND u.norm = r.norm""",
)
def p21(spark: SparkSession, directory: str) -> DataFrame:
    """Bridge rows anchored by place (hunk, line number, occurrence) or else by the only line with their text."""
    named = lines(spark, directory).where(F.col("line_id").isNotNull())
    places = named.where(F.col("new_lineno").isNotNull()).groupBy("commit_id", "path", F.col("hunk_ordinal").alias("hunk_index"), "new_lineno", F.col("occurrence_index").alias("occ"))
    places = places.agg(F.min("line_id").alias("by_place"))
    texts = named.select("commit_id", lf.collapse(F.col("raw_text")).alias("norm"), F.col("line_id").alias("id"))
    row_text = pol(spark, directory).where(F.col("norm").isNotNull()).groupBy("commit_id", "idx").agg(F.min("norm").alias("norm"))
    rows = br(spark, directory).join(places, ["commit_id", "path", "hunk_index", "new_lineno", "occ"], "left").join(row_text, ["commit_id", "idx"], "left")
    out = linkage.unique_fallback(rows, texts, ["commit_id", "norm"], "id", "by_text")
    how = F.when(F.col("by_place").isNotNull(), "PLACE").when(F.col("by_text").isNotNull(), "TEXT").otherwise("NONE")
    return out.select("row_id", F.coalesce("by_place", "by_text").alias("anchor"), how.alias("how"))


@CATALOG.query(
    "audit_p22_scoped_candidates",
    f"""WITH {LINES}, {_POL}, {_BR}, f AS (SELECT commit_id, idx, min(path) AS path FROM br WHERE path IS NOT NULL GROUP BY 1, 2), free AS (SELECT commit_id, path, {_collapse("raw_text")} AS norm FROM lines l
        WHERE line_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM br WHERE br.line_id = l.line_id)), known AS (SELECT DISTINCT commit_id, path FROM lines WHERE line_id IS NOT NULL)
    SELECT p.row_id, (SELECT count(*) FROM free x WHERE x.commit_id = p.commit_id AND x.norm = p.norm AND (k.path IS NULL OR x.path = k.path)) AS n_free
    FROM pol p LEFT JOIN f ON f.commit_id = p.commit_id AND f.idx = p.idx LEFT JOIN known k ON k.commit_id = p.commit_id AND k.path = f.path""",
)
def p22(spark: SparkSession, directory: str) -> DataFrame:
    """Unused lines with the text of each label row, in its file if that is known, else in its commit."""
    files = br(spark, directory).where(F.col("path").isNotNull()).groupBy("commit_id", "idx").agg(F.min("path").alias("path"))
    rows = pol(spark, directory).select("row_id", "commit_id", "idx", "norm").join(files, ["commit_id", "idx"], "left")
    named = lines(spark, directory).where(F.col("line_id").isNotNull()).select("commit_id", "path", lf.collapse(F.col("raw_text")).alias("norm"), "line_id")
    return linkage.scoped_candidates(rows, named, br(spark, directory), ["commit_id"], "path", "norm", "line_id").select("row_id", "n_free")


@CATALOG.query("q04_residual_gaps")
def q04(spark: SparkSession, directory: str) -> DataFrame:
    """Open label rows of a file paired with unclaimed lines in gaps of equal size between anchored ones."""
    unit = ["commit_id", "path"]
    rows = label_rows(spark, directory).where("change_type = 'added'").select(*unit, "place")
    right = diff_rows(spark, directory).where("change_type = 'added'")
    anchored = pol(spark, directory).select("commit_id", "idx", F.col("row_id").alias("left_place"))
    claims = br(spark, directory).where(F.col("line_id").isNotNull()).join(right.select("line_id", "path", F.col("place").alias("right_place")), ["line_id", "path"])
    anchors = claims.join(anchored, ["commit_id", "idx"]).groupBy(*unit, "left_place").agg(F.min("right_place").alias("right_place"))
    # Anchors in the same order on both sides: those that no other crosses.
    w = Window.partitionBy(*unit).orderBy("left_place")
    ends = anchors.withColumns({
        "__low": F.max("right_place").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__high": F.min("right_place").over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    straight = ends.where("(__low IS NULL OR __low < right_place) AND (__high IS NULL OR __high > right_place)").drop("__low", "__high")
    residual = rows.withColumnRenamed("place", "left_place").join(anchors.select(*unit, "left_place"), [*unit, "left_place"], "left_anti")
    return linkage.residual_gaps(rows, right.select(*unit, "place"), straight, residual, anchors.select(*unit, "right_place"), unit)
