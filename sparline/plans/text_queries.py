"""Text forms, identities, diffs, linkage and the structured form of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.functions import ids
from sparline.functions import lines as lf
from sparline.operators import diffs, linkage, structure
from sparline.operators.alignment import align
from sparline.plans.base import COMMITS, HUNKS, LINES, commits, hunks, lines
from sparline.plans.catalog import Catalog
from sparline.sources.parquet import table

CATALOG = Catalog()

# DuckDB twins of the text functions; \p{{L}}\p{{N}} for Java's Unicode word characters.
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return _WS.format(x)


def _punct(x: str) -> str:
    return _collapse(rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}\p{{M}}_\s])', ' \1 ', 'g')")


def _norm(x: str) -> str:
    bare = rf"regexp_replace({_punct(x)}, '(^| )_(\p{{L}})', '\1\2', 'g')"
    return rf"""regexp_replace({bare}, '"\s+([^"]*?)\s+"', '"\1"', 'g')"""


def _mask(x: str) -> str:
    out = rf"replace(translate({x}, '(){{}}[].:;,', '          '), ' _ ', '_')"
    for quoted in ("``.*``", "''.*''", '".*"'):
        out = f"regexp_replace({out}, '{quoted}', '<STR>', 'g')"
    return _collapse(rf"regexp_replace({out}, '\d+', '<NUM>', 'g')")


_TEXTS = f"{LINES}, t AS (SELECT DISTINCT raw_text AS x FROM lines WHERE raw_text IS NOT NULL)"


def texts(spark: SparkSession, directory: str) -> DataFrame:
    return lines(spark, directory).where(F.col("raw_text").isNotNull()).select(F.col("raw_text").alias("x")).distinct()


@CATALOG.query(
    "h01_normal_forms",
    f"""WITH {_TEXTS} SELECT x, {_collapse("x")} AS collapsed, {_punct("x")} AS spaced, {_norm("x")} AS normalized, {_punct("replace(x, '_', ' ')")} AS split_names, {_mask("x")} AS masked FROM t""",
)
def h01(spark: SparkSession, directory: str) -> DataFrame:
    x = F.col("x")
    return texts(spark, directory).select(
        "x", lf.collapse(x).alias("collapsed"), lf.space_punctuation(x).alias("spaced"), lf.normalize_line(x).alias("normalized"), lf.split_underscores(x).alias("split_names"), lf.mask_literals(x).alias("masked"),
    )


def _distinct(*forms: str) -> str:
    return f"len(list_distinct([{', '.join(forms)}]))"


@CATALOG.query(
    "h03_variant_counts",
    f"""WITH {_TEXTS}, f AS (SELECT x, {_norm("x")} AS n, {_punct("x")} AS p, {_collapse("x")} AS c, {_punct("replace(x, '_', ' ')")} AS s, {_mask("x")} AS m FROM t),
    g AS (SELECT x, {_distinct("x", "p", "s", "c", "n", _punct("n"), _norm("p"))} AS n_variants, {_distinct("x", "c", "p", "s", "n", "m", _mask("p"), _mask("c"), _punct("n"))} AS n_signatures FROM f)
    SELECT n_variants::INT AS n_variants, n_signatures::INT AS n_signatures, count(*) AS n FROM g GROUP BY 1, 2""",
)
def h03(spark: SparkSession, directory: str) -> DataFrame:
    x = F.col("x")
    return texts(spark, directory).groupBy(F.size(lf.text_variants(x)).alias("n_variants"), F.size(lf.signatures(x)).alias("n_signatures")).agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "h07_line_identities",
    f"""WITH {LINES} SELECT line_id, commit_id || '|' || path || '|' || change_type || '|old' || coalesce(old_lineno::VARCHAR, 'NA') || '|new' || coalesce(new_lineno::VARCHAR, 'NA')
        || '|occ' || occurrence_index || '|ord' || position AS rebuilt, sha256(line_id) AS digest, ('0x' || substr(sha256('S|' || line_id), 1, 8))::BIGINT % 2147483647 AS seed FROM lines WHERE line_id IS NOT NULL""",
)
def h07(spark: SparkSession, directory: str) -> DataFrame:
    c = F.col
    rebuilt = ids.stable_line_id(c("commit_id"), c("path"), c("change_type"), c("old_lineno"), c("new_lineno"), c("occurrence_index"), c("position"))
    rows = lines(spark, directory).where(c("line_id").isNotNull())
    return rows.select("line_id", rebuilt.alias("rebuilt"), ids.digest(c("line_id")).alias("digest"), ids.seed(F.lit("S"), c("line_id")).alias("seed"))


@CATALOG.query(
    "b03_code_lines",
    rf"""WITH {LINES}, k AS (SELECT *, regexp_replace(raw_text, '^\s+|\s+$', '', 'g') AS t FROM lines)
    SELECT change_type, count(*) AS n, count_if(path LIKE '%.java') AS n_code, count_if(t = '' OR starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR ends_with(t, '*/')) AS n_comment FROM k GROUP BY 1""",
)
def b03(spark: SparkSession, directory: str) -> DataFrame:
    return lines(spark, directory).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lf.is_code_file(F.col("path"))).alias("n_code"), F.count_if(lf.is_comment_or_blank(F.col("raw_text"))).alias("n_comment")
    )


_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_HEAD_PART = "last_value(CASE WHEN h THEN coalesce(nullif(regexp_extract(t, '{}', {}), ''), '1')::INT END IGNORE NULLS) OVER u"
_DIFF = rf"""WITH l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]|\x{{85}}') AS ls FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INT AS ordinal, unnest(ls) AS t FROM l0),
    a AS (SELECT *, regexp_matches(t, '{_HEAD}') AS h, starts_with(t, '+++ ') AND coalesce(starts_with(lag(t) OVER w, '--- '), false) AS n, starts_with(t, '--- ') AND coalesce(starts_with(lead(t) OVER w, '+++ '), false) AS o
          FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
    b AS (SELECT *, sum(h::INT) OVER u - 1 AS hunk, last_value(CASE WHEN n THEN regexp_extract(t, '^\+\+\+ (?:b/)?([^\t]+)', 1) END IGNORE NULLS) OVER u AS p,
          last_value(CASE WHEN o THEN regexp_extract(t, '^--- (?:a/)?([^\t]+)', 1) END IGNORE NULLS) OVER u AS q,
          {_HEAD_PART.format(_HEAD, 1)} AS os, {_HEAD_PART.format(_HEAD, 2)} AS onum, {_HEAD_PART.format(_HEAD, 3)} AS ns, {_HEAD_PART.format(_HEAD, 4)} AS nnum
          FROM a WINDOW u AS (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, CASE WHEN h OR n OR o THEN 'head' WHEN starts_with(t, '+') THEN 'added' WHEN starts_with(t, '-') THEN 'deleted' WHEN starts_with(t, ' ') THEN 'context' ELSE 'other' END AS kind FROM b WHERE hunk >= 0),
    d AS (SELECT *, sum((kind IN ('deleted', 'context'))::INT) OVER i AS co, sum((kind IN ('added', 'context'))::INT) OVER i AS cn, sum((kind = 'other')::INT) OVER i AS cx
          FROM c WINDOW i AS (PARTITION BY doc_id, hunk ORDER BY ordinal ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, ordinal, CASE WHEN p = '/dev/null' THEN q ELSE p END AS path, hunk::BIGINT AS hunk, kind AS change_type, CASE WHEN kind <> 'added' THEN os + co - 1 END::BIGINT AS old_lineno,
        CASE WHEN kind <> 'deleted' THEN ns + cn - 1 END::BIGINT AS new_lineno, substr(t, 2) AS raw_text FROM d WHERE kind IN ('added', 'deleted', 'context') AND co <= onum AND cn <= nnum AND cx = 0"""


@CATALOG.query("k01_diff_lines", _DIFF)
def k01(spark: SparkSession, directory: str) -> DataFrame:
    """All lines of all diffs inside the documents."""
    return diffs.parse_diff(table(spark, directory, "documents"), "doc_id", "text")


@CATALOG.query(
    "k02_hunk_headers",
    r"""WITH h AS (SELECT doc_id, regexp_extract_all(replace(text, chr(13), ''), '(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@') AS hs FROM documents),
    x AS (SELECT doc_id, (generate_subscripts(hs, 1) - 1)::INT AS hunk, unnest(hs) AS h FROM h)
    SELECT doc_id, hunk, regexp_extract(h, '-(\d+)', 1)::INT AS old_start, coalesce(nullif(regexp_extract(h, '-\d+,(\d+)', 1), ''), '1')::INT AS old_length,
        regexp_extract(h, '\+(\d+)', 1)::INT AS new_start, coalesce(nullif(regexp_extract(h, '\+\d+,(\d+)', 1), ''), '1')::INT AS new_length FROM x""",
)
def k02(spark: SparkSession, directory: str) -> DataFrame:
    return diffs.hunk_headers(table(spark, directory, "documents"), "doc_id", "text")


@CATALOG.query(
    "e10_occurrences",
    f"""WITH {LINES}, c AS (SELECT commit_id, path, hunk_ordinal, line_ordinal, change_type, {_norm("raw_text")} AS norm_text, row_number() OVER (PARTITION BY commit_id ORDER BY path, hunk_ordinal, line_ordinal) AS ordinal FROM lines
        WHERE change_type <> 'context' AND path LIKE '%.java' AND NOT coalesce(regexp_matches(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g'), '^(//|/\\*|\\*)|\\*/$|^$'), false))
    SELECT commit_id, path, hunk_ordinal, line_ordinal, (row_number() OVER (PARTITION BY commit_id, change_type, norm_text ORDER BY ordinal) - 1)::INT AS occurrence_index,
        (row_number() OVER (PARTITION BY commit_id ORDER BY ordinal) - 1)::INT AS ordered_position FROM c WHERE norm_text <> ''""".replace("\\\\", "\\"),
)
def e10(spark: SparkSession, directory: str) -> DataFrame:
    rows = lines(spark, directory).select("commit_id", "path", "hunk_ordinal", "line_ordinal", "change_type", "raw_text")
    rows = rows.withColumn("ordinal", F.struct("path", "hunk_ordinal", "line_ordinal"))
    return diffs.code_lines(rows, ["commit_id"]).select("commit_id", "path", "hunk_ordinal", "line_ordinal", "occurrence_index", "ordered_position")


# Label rows (bridge_results) against lines.
_KEYS = ["commit_id", "path", "old_lineno", "new_lineno"]
_BRIDGE = r"""b AS (SELECT row_id, lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g')) AS commit_id, file_path AS path, old_lineno, new_lineno, label FROM bridge_results)"""


def bridge(spark: SparkSession, directory: str) -> DataFrame:
    from sparline.functions.text import commit_key

    return table(spark, directory, "bridge_results").select("row_id", commit_key(F.col("commit_id")).alias("commit_id"), F.col("file_path").alias("path"), "old_lineno", "new_lineno", "label")


@CATALOG.query(
    "c01_null_safe_lookup",
    f"""WITH {LINES}, {_BRIDGE}, r AS (SELECT commit_id, path, old_lineno, new_lineno, arg_max(line_id, struct_pack(a := hunk_ordinal, b := line_ordinal)) AS line_id FROM lines GROUP BY ALL)
    SELECT row_id, label, line_id FROM b LEFT JOIN r ON b.commit_id IS NOT DISTINCT FROM r.commit_id AND b.path IS NOT DISTINCT FROM r.path
        AND b.old_lineno IS NOT DISTINCT FROM r.old_lineno AND b.new_lineno IS NOT DISTINCT FROM r.new_lineno""",
)
def c01(spark: SparkSession, directory: str) -> DataFrame:
    right = lines(spark, directory).select(*_KEYS, "line_id", "hunk_ordinal", "line_ordinal")
    out = linkage.null_safe_lookup(bridge(spark, directory), right, _KEYS, ["line_id"], ["hunk_ordinal", "line_ordinal"])
    return out.select("row_id", "label", "line_id")


@CATALOG.query(
    "c02_unique_fallback",
    f"""WITH {LINES}, {_BRIDGE}, r AS (SELECT commit_id, path, new_lineno, any_value(line_id) AS line_id FROM lines GROUP BY 1, 2, 3 HAVING count(*) = 1)
    SELECT row_id, line_id FROM b LEFT JOIN r USING (commit_id, path, new_lineno)""",
)
def c02(spark: SparkSession, directory: str) -> DataFrame:
    out = linkage.unique_fallback(bridge(spark, directory), lines(spark, directory), ["commit_id", "path", "new_lineno"], "line_id", "line_id")
    return out.select("row_id", "line_id")


_POLICY = rf"""a AS (SELECT row_id, lower(regexp_replace(commit_id, '^\s+|\s+$', '', 'g')) AS commit_id, raw_changed_line AS text, {_norm("raw_changed_line")} AS norm FROM policy_a_rows WHERE raw_changed_line IS NOT NULL)"""


def policy(spark: SparkSession, directory: str) -> DataFrame:
    from sparline.functions.text import commit_key

    rows = table(spark, directory, "policy_a_rows").where(F.col("raw_changed_line").isNotNull())
    return rows.select("row_id", "idx", commit_key(F.col("commit_id")).alias("commit_id"), F.col("raw_changed_line").alias("text"))


@CATALOG.query(
    "c04_match_by_count",
    f"""WITH {LINES}, {_POLICY}, r AS (SELECT commit_id, {_norm("raw_text")} AS norm, count(*) AS n, any_value(line_id) AS line_id FROM lines WHERE line_id IS NOT NULL GROUP BY 1, 2)
    SELECT row_id, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN line_id END AS match, CASE coalesce(n, 0) WHEN 1 THEN 'UNIQUE' WHEN 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS state
    FROM a LEFT JOIN r USING (commit_id, norm)""",
)
def c04(spark: SparkSession, directory: str) -> DataFrame:
    left = policy(spark, directory).withColumn("norm", lf.normalize_line(F.col("text")))
    right = lines(spark, directory).where(F.col("line_id").isNotNull()).withColumn("norm", lf.normalize_line(F.col("raw_text")))
    return linkage.match_by_count(left, right, ["commit_id", "norm"], "line_id").select("row_id", "n_matches", "match", "state")


@CATALOG.query(
    "c08_variant_candidates",
    f"""WITH {LINES}, {_POLICY}, x AS (SELECT row_id, commit_id, unnest(list_distinct([text, norm, {_punct("text")}, {_collapse("text")}, {_punct("replace(text, '_', ' ')")}, {_punct("norm")}, {_norm(_punct("text"))}])) AS f FROM a),
    y AS (SELECT line_id, commit_id, unnest(list_distinct([raw_text, {_norm("raw_text")}, {_punct("raw_text")}, {_collapse("raw_text")}, {_punct("replace(raw_text, '_', ' ')")}, {_punct(_norm("raw_text"))}, {_norm(_punct("raw_text"))}])) AS f FROM lines WHERE line_id IS NOT NULL AND raw_text IS NOT NULL)
    SELECT DISTINCT commit_id, row_id, line_id FROM x JOIN y USING (commit_id, f)""",
)
def c08(spark: SparkSession, directory: str) -> DataFrame:
    right = lines(spark, directory).where(F.col("line_id").isNotNull()).select("commit_id", "line_id", "raw_text")
    return linkage.variant_candidates(policy(spark, directory), right, ["commit_id"], "row_id", "line_id", "text", "raw_text")


@CATALOG.query("c05_alignment")
def c05(spark: SparkSession, directory: str) -> DataFrame:
    """Label rows assigned one to one to the lines of their commit."""
    left = policy(spark, directory).where(F.col("commit_id").isNotNull()).select("commit_id", F.col("row_id").alias("place"), "text")
    right = lines(spark, directory).where(F.col("position").isNotNull()).select("commit_id", F.col("position").cast("bigint").alias("place"), F.col("raw_text").alias("text"))
    return align(left, right, ["commit_id"])


def _gaps(kind: str, col: str) -> str:
    return f"""SELECT commit_id, gap, place AS {col}, row_number() OVER (PARTITION BY commit_id, gap ORDER BY place) AS k, count(*) OVER (PARTITION BY commit_id, gap) AS n FROM (
        SELECT commit_id, place, mark, sum(mark) OVER (PARTITION BY commit_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS gap FROM (
            SELECT commit_id, {col} AS place, 1 AS mark FROM anchors UNION ALL SELECT commit_id, position, 0 FROM lines l
            WHERE change_type = '{kind}' AND position IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.commit_id = l.commit_id AND a.{col} = l.position)) u) v WHERE mark = 0"""


@CATALOG.query(
    "c07_gap_pairs",
    f"""WITH {LINES}, f AS (SELECT commit_id, path, hunk_ordinal, min(position) FILTER (change_type = 'deleted') AS left_place, min(position) FILTER (change_type = 'added') AS right_place FROM lines GROUP BY 1, 2, 3),
    anchors AS (SELECT commit_id, left_place, right_place FROM f WHERE left_place IS NOT NULL AND right_place IS NOT NULL),
    x AS ({_gaps("deleted", "left_place")}), y AS ({_gaps("added", "right_place")}) SELECT commit_id, left_place, right_place FROM x JOIN y USING (commit_id, gap, k, n)""",
)
def c07(spark: SparkSession, directory: str) -> DataFrame:
    """Deleted and added lines paired between anchors, the first of both kinds in each hunk."""
    rows = lines(spark, directory).where(F.col("position").isNotNull())
    first = lambda kind: F.min(F.when(F.col("change_type") == kind, F.col("position")))
    anchors = rows.groupBy("commit_id", "path", "hunk_ordinal").agg(first("deleted").alias("left_place"), first("added").alias("right_place"))
    anchors = anchors.where("left_place IS NOT NULL AND right_place IS NOT NULL")
    side = lambda kind: rows.where(F.col("change_type") == kind).select("commit_id", F.col("position").alias("place"))
    return linkage.gap_pairs(side("deleted"), side("added"), anchors, ["commit_id"])


@CATALOG.query(
    "q08_merge_sources",
    f"""WITH {LINES}, {_POLICY}, u AS (SELECT commit_id || '|' || norm AS key, row_id AS claim, 1 AS priority, row_id AS ord FROM a WHERE commit_id IS NOT NULL
        UNION ALL SELECT commit_id || '|' || {_norm("raw_text")}, position, 0, position FROM lines WHERE line_id IS NOT NULL AND raw_text IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, ord, claim) AS i FROM u),
    g AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY priority, ord, key) AS j FROM f WHERE i = 1)
    SELECT CASE WHEN claim IS NULL THEN 'UNRESOLVED' WHEN j > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS state, count(*) AS n FROM g GROUP BY 1""",
)
def q08(spark: SparkSession, directory: str) -> DataFrame:
    key = lambda c: F.concat(F.col("commit_id"), F.lit("|"), lf.normalize_line(F.col(c)))
    a = policy(spark, directory).where(F.col("commit_id").isNotNull()).select(key("text").alias("key"), F.col("row_id").alias("claim"), F.lit(1).alias("priority"), F.col("row_id").alias("ord"))
    rows = lines(spark, directory).where(F.col("line_id").isNotNull() & F.col("raw_text").isNotNull())
    b = rows.select(key("raw_text").alias("key"), F.col("position").cast("bigint").alias("claim"), F.lit(0).alias("priority"), F.col("position").cast("bigint").alias("ord"))
    return linkage.merge_sources(a.unionAll(b), "key", "claim", "priority", "ord").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Structure: commits as marked-up text.
_HEADER = "hunk_ordinal || ' -' || old_start || ',' || old_length || ' +' || new_start || ',' || new_length"
_SEGMENTS = rf"""{LINES}, {COMMITS}, seg AS (
    SELECT commit_id, -1 AS f, -1 AS h, -1 AS n, 'message' AS kind, regexp_replace(coalesce(message, ''), '\n$', '') AS payload, NULL AS line_id FROM commits
    UNION ALL SELECT commit_id, min(file_ordinal), -1, -1, 'file', path, NULL FROM hunks GROUP BY commit_id, path
    UNION ALL SELECT commit_id, file_ordinal, hunk_ordinal, -1, 'hunk', {_HEADER}, NULL FROM hunks
    UNION ALL SELECT commit_id, file_ordinal, hunk_ordinal, line_ordinal, change_type, coalesce(raw_text, ''), line_id FROM lines),
    mk AS (SELECT *, CASE kind WHEN 'message' THEN '[MSG]' WHEN 'file' THEN '[FILE]' WHEN 'hunk' THEN '[HUNK]' WHEN 'added' THEN '[ADD]' WHEN 'deleted' THEN '[DEL]' ELSE '[CTX]' END AS marker FROM seg),
    sp AS (SELECT *, row_number() OVER w - 1 AS segment, sum(length(marker) + length(payload) + 2) OVER w - length(payload) - 1 AS char_start FROM mk WINDOW w AS (PARTITION BY commit_id ORDER BY f, h, n))"""


def parts(spark: SparkSession, directory: str) -> DataFrame:
    h = hunks(spark, directory)
    header = F.concat(F.col("hunk_ordinal"), F.lit(" -"), F.col("old_start"), F.lit(","), F.col("old_length"), F.lit(" +"), F.col("new_start"), F.lit(","), F.col("new_length"))
    return structure.segments(commits(spark, directory).select("commit_id", "message"), h.withColumn("header", header), lines(spark, directory))


@CATALOG.query("k06_spans", f"WITH {_SEGMENTS} SELECT commit_id, segment::INT AS segment, kind, line_id, char_start::BIGINT AS char_start, (char_start + length(payload))::BIGINT AS char_end FROM sp")
def k06(spark: SparkSession, directory: str) -> DataFrame:
    return structure.spans(parts(spark, directory)).select("commit_id", "segment", "kind", "line_id", "char_start", "char_end")


@CATALOG.query("k07_rendered", f"WITH {_SEGMENTS} SELECT commit_id, sha256(string_agg(marker || ' ' || payload || chr(10), '' ORDER BY f, h, n)) AS digest FROM mk GROUP BY 1")
def k07(spark: SparkSession, directory: str) -> DataFrame:
    return structure.rendered(parts(spark, directory)).select("commit_id", F.sha2("text", 256).alias("digest"))


_TOKENS = rf"""txt AS (SELECT commit_id, string_agg(marker || ' ' || payload || chr(10), '' ORDER BY f, h, n) AS text FROM mk GROUP BY 1),
    pc0 AS (SELECT commit_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]|[ \t\r\n]+') AS ps FROM txt),
    pc AS (SELECT commit_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS token FROM pc0),
    pl AS (SELECT *, sum(length(token)) OVER (PARTITION BY commit_id ORDER BY i) AS e FROM pc),
    tok AS (SELECT commit_id, row_number() OVER (PARTITION BY commit_id ORDER BY i) - 1 AS token_index, e - length(token) AS s, e FROM pl WHERE NOT regexp_matches(token, '^[ \t\r\n]'))"""


@CATALOG.query(
    "c11_token_owners",
    f"""WITH {_SEGMENTS}, {_TOKENS}, m AS (SELECT t.commit_id, t.token_index, count(p.char_start) AS n, any_value(p.line_id) AS owner
        FROM tok t LEFT JOIN sp p ON p.commit_id = t.commit_id AND p.line_id IS NOT NULL AND t.s < p.char_start + length(p.payload) AND t.e > p.char_start GROUP BY 1, 2)
    SELECT commit_id, count(*) AS n_tokens, count_if(n = 1) AS n_mapped, count_if(n > 1) AS n_errors, count(DISTINCT CASE WHEN n = 1 THEN owner END) AS n_lines FROM m GROUP BY 1""",
)
def c11(spark: SparkSession, directory: str) -> DataFrame:
    owned = structure.segment_tokens(structure.token_segments(structure.spans(parts(spark, directory))))
    return owned.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("mapping") == "MAPPED").alias("n_mapped"),
        F.count_if(F.col("mapping") == "ERROR").alias("n_errors"), F.count_distinct("owner").alias("n_lines"),
    )


@CATALOG.query(
    "k10_truncation",
    f"""WITH {_SEGMENTS}, {_TOKENS}, z AS (SELECT commit_id, count(*) AS n_tokens, max(CASE WHEN token_index = 509 THEN e END) AS at_ FROM tok GROUP BY 1),
    c AS (SELECT z.commit_id, coalesce(min(p.char_start) FILTER (p.line_id IS NOT NULL AND p.char_start < at_ AND at_ <= p.char_start + length(p.payload)), any_value(at_)) AS cut_char
          FROM z JOIN sp p USING (commit_id) WHERE n_tokens > 510 GROUP BY 1)
    SELECT z.commit_id, z.n_tokens, z.n_tokens > 510 AS truncated, c.cut_char::BIGINT AS cut_char,
        CASE WHEN z.n_tokens > 510 THEN (SELECT count(*) FROM tok t WHERE t.commit_id = z.commit_id AND t.e <= c.cut_char) ELSE z.n_tokens END AS n_kept FROM z LEFT JOIN c USING (commit_id)""",
)
def k10(spark: SparkSession, directory: str) -> DataFrame:
    return structure.truncate_segments(structure.token_segments(structure.spans(parts(spark, directory))), 512, 2)


@CATALOG.query(
    "k15_perturbations",
    f"""WITH {HUNKS}, k AS (SELECT commit_id, path, hunk_ordinal, ls, list_filter(list_transform(ls, lambda x: x.stable_line_id), lambda i: ('0x' || substr(sha256(i), 1, 2))::INT < 64) AS ids FROM hunks)
    SELECT commit_id, path, hunk_ordinal, len(list_filter(ls, lambda x: x.stable_line_id IS NULL OR NOT list_contains(ids, x.stable_line_id)))::INT AS n_left,
        coalesce(list_sum(list_transform(ls, lambda x: CASE WHEN list_contains(ids, x.stable_line_id) THEN 0 ELSE length(x.raw_text) END)), 0)::BIGINT AS n_chars_blanked,
        coalesce(list_sum(list_transform(ls, lambda x: length(x.raw_text))), 0)::BIGINT AS n_chars_restored, len(list_filter(ls, lambda x: x.change_type = 'added'))::INT AS n_deleted_swapped FROM k""",
)
def k15(spark: SparkSession, directory: str) -> DataFrame:
    """Deletion, blanking, restoration and swapping of a hashed quarter of the lines of each hunk."""
    pick = F.filter(F.transform("lines", lambda x: x["stable_line_id"]), lambda i: F.conv(F.substring(F.sha2(i, 256), 1, 2), 16, 10).cast("int") < 64)
    h = hunks(spark, directory).withColumn("ids", pick)
    blanked = structure.blank_lines(F.col("lines"), F.col("ids"))
    chars = lambda a: F.aggregate(F.transform(a, lambda x: F.coalesce(F.length(x["raw_text"]), F.lit(0))), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return h.select(
        "commit_id", "path", "hunk_ordinal", F.size(structure.delete_lines(F.col("lines"), F.col("ids"))).alias("n_left"), chars(blanked).alias("n_chars_blanked"),
        chars(structure.restore_lines(blanked, F.col("lines"), F.col("ids"))).alias("n_chars_restored"),
        F.size(F.filter(structure.swap_changes(F.col("lines")), lambda x: x["change_type"] == "deleted")).alias("n_deleted_swapped"),
    )


@CATALOG.query(
    "k08_chat_messages",
    f"""WITH {_SEGMENTS}, {_TOKENS.split("pc0 AS")[0].rstrip().rstrip(",")} SELECT commit_id, 2 AS n_messages, length(text)::INT AS n_chars, length(text) - length(replace(text, '[ADD]', '     ')) AS moved,
    (length(text) - length(replace(text, '[ADD]', ''))) // 5 AS n_added FROM txt""",
)
def k08(spark: SparkSession, directory: str) -> DataFrame:
    """Chat messages around the text, and its markers blanked in place."""
    t = structure.rendered(parts(spark, directory)).withColumn("m", structure.chat_messages("Rate the change.", F.col("text")))
    n_added = F.floor((F.length("text") - F.length(F.replace("text", F.lit("[ADD]"), F.lit("")))) / 5)
    moved = (F.length("text") - F.length(structure.blank_markers(F.col("text")))).cast("bigint")
    return t.select("commit_id", F.size("m").alias("n_messages"), F.length(F.element_at("m", 2)["content"]).alias("n_chars"), moved.alias("moved"), n_added.alias("n_added"))
