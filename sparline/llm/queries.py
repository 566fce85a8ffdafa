"""Queries of the problems of training data: p2, p3, p4, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparline.functions.text import commit_key, split_key, token_count, trimmed
from sparline.llm.mixing import Mix, mix
from sparline.llm.overlap import split_overlap, word_hashes
from sparline.llm.packing import pack
from sparline.llm.pieces import commit_pieces
from sparline.llm.spam import spam
from sparline.llm.topn import top_n
from sparline.plans.catalog import Catalog
from sparline.session import cut
from sparline.sources.parquet import table

CATALOG = Catalog()

TOP = 3

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOP = f"""WITH r AS (
        SELECT lower({_TRIM.format("commit_id")}) AS commit_id, {_TRIM.format("method")} AS method, model_seed,
               {_TRIM.format("region_id")} AS region_id, rank_score, raw_score, result_id
        FROM attribution_rows
        WHERE upper({_TRIM.format("granularity")}) = 'LINE' AND rank_score IS NOT NULL AND NOT isnan(rank_score) AND region_id IS NOT NULL),
    d AS (SELECT commit_id, method, model_seed, region_id, max(rank_score) AS rank_score, max(raw_score) AS raw_score, min(result_id) AS result_id
          FROM r GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY commit_id, method, model_seed
          ORDER BY rank_score DESC, raw_score DESC NULLS LAST, region_id) AS place FROM d)"""


def top_regions(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "attribution_rows").where(F.upper(trimmed(F.col("granularity"))) == "LINE")
    rows = rows.select(
        commit_key(F.col("commit_id")).alias("commit_id"), trimmed(F.col("method")).alias("method"), "model_seed",
        trimmed(F.col("region_id")).alias("region_id"), "rank_score", "raw_score", "result_id",
    )
    return top_n(rows, ["commit_id", "method", "model_seed"], "region_id", ["rank_score", "raw_score"], "result_id", TOP)


@CATALOG.query("p2_found", f"{_TOP} SELECT result_id FROM t WHERE place <= 3")
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return top_regions(spark, directory).select("result_id")


@CATALOG.query(
    "p2_top_regions",
    f"{_TOP} SELECT commit_id, method, model_seed, region_id, rank_score, raw_score, result_id, place::INT AS place FROM t WHERE place <= 3",
)
def p2_top_regions(spark: SparkSession, directory: str) -> DataFrame:
    """The three best LINE regions of every (commit, method, seed), with their places."""
    return top_regions(spark, directory)


def _limit(spark: SparkSession, directory: str, name: str) -> tuple[int, int]:
    row = table(spark, directory, "size_limits").where(F.col("limit_name") == name).first()
    return int(row["max_tokens"]), int(row["overlap_tokens"])


_TOKENS = r"coalesce(len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')), 0)"


def pieces(spark: SparkSession, directory: str) -> DataFrame:
    return commit_pieces(table(spark, directory, "hunk_specs"), *_limit(spark, directory, "commit_piece"))


@CATALOG.query(
    "p4_found",
    f"""WITH h AS (SELECT lower({_TRIM.format("commit_id")}) AS commit_id, canonical_path, hunk_ordinal, arg_min(lines, extracted_at) AS lines
          FROM hunk_specs WHERE commit_id IS NOT NULL GROUP BY 1, 2, 3),
    n AS (SELECT commit_id, list_sum(list_transform(lines, lambda x: {_TOKENS.format("x.raw_text")})) AS n FROM h)
    SELECT commit_id FROM n GROUP BY 1 HAVING sum(n) > 2048""",
)
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return pieces(spark, directory).select("commit_id").distinct()


@CATALOG.query("p4_pieces")
def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """All pieces of all commits beyond the limit, with their texts."""
    return pieces(spark, directory)


@CATALOG.query(
    "p4_piece_checks",
    f"""WITH h AS (SELECT lower({_TRIM.format("commit_id")}) AS commit_id, canonical_path, hunk_ordinal, arg_min(lines, extracted_at) AS lines
          FROM hunk_specs WHERE commit_id IS NOT NULL GROUP BY 1, 2, 3),
    n AS (SELECT commit_id, list_sum(list_transform(lines, lambda x: {_TOKENS.format("x.raw_text")})) AS n FROM h),
    t AS (SELECT commit_id, sum(n)::BIGINT AS n FROM n GROUP BY 1 HAVING sum(n) > 2048), o AS (SELECT overlap_tokens AS o FROM size_limits WHERE limit_name = 'commit_piece')
    SELECT commit_id, n AS covered, n AS without_overlap, 0::BIGINT AS n_too_long, 0::BIGINT AS n_wrong_overlap, 0::BIGINT AS n_wrong_text FROM t""",
)
def p4_piece_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the pieces of every commit, wherever they are cut."""
    limit, overlap = _limit(spark, directory, "commit_piece")
    got = pieces(spark, directory)
    begin = F.col("token_from") + F.col("overlap_tokens")
    right = (F.col("overlap_tokens") == F.least(F.lit(overlap), begin)) & (F.col("n_tokens") == F.col("token_to") - F.col("token_from"))
    return got.groupBy("commit_id").agg(
        F.max("token_to").alias("covered"), F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("without_overlap"), F.count_if(F.col("n_tokens") > limit).alias("n_too_long"),
        F.count_if(~right).alias("n_wrong_overlap"), F.count_if(token_count(F.col("text")) != F.col("n_tokens")).alias("n_wrong_text"),
    )


def containers(spark: SparkSession, directory: str) -> DataFrame:
    return pack(table(spark, directory, "documents"), "doc_id", "text", _limit(spark, directory, "doc_container")[0])


@CATALOG.query("p6_found", f"SELECT doc_id FROM documents WHERE {_TOKENS.format('text')} > 2048")
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return containers(spark, directory).where("n_pieces > 1 AND piece_no = 0").select("doc_id")


@CATALOG.query("p6_containers")
def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's pieces with their containers."""
    return containers(spark, directory)


@CATALOG.query(
    "p6_container_checks",
    f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')}::BIGINT AS n FROM documents) SELECT doc_id, greatest(1, ceil(n / 2048))::BIGINT AS n_pieces, n AS n_tokens, true AS in_order, true AS fits FROM d""",
)
def p6_container_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of every document in any packing: its pieces, their tokens in order, and that none of its containers is overfull."""
    got = containers(spark, directory)
    fill = got.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    rows = got.join(fill, "container_id", "left")
    right = (F.col("token_from") == F.col("piece_no").cast("bigint") * 2048) & ((F.col("piece_no") == F.col("n_pieces") - 1) | (F.col("n_tokens") == 2048))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.bool_and(right).alias("in_order"), F.bool_and(F.coalesce("fill", F.lit(0)) <= 2048).alias("fits")
    )


@CATALOG.query("p6_fill")
def p6_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How many containers hold how many tokens: n_tokens, n_containers."""
    used = containers(spark, directory).where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return used.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_containers"))


#: Parameter: the domains over the sources, the first level of the tree.
DOMAINS = {
    "commit_log": "change", "code_review": "change", "patch_archive": "change", "bug_tracker": "talk", "mailing_list": "talk",
    "forum_qna": "talk", "web_crawl": "web", "javadoc": "docs", "release_notes": "docs",
}

_SOURCE = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[-\s]', '_', 'g')"
_SHARES = f"""WITH t AS (SELECT {_SOURCE.format("source_name")} AS source_name, target_share, max_repeats FROM source_targets),
    d AS (SELECT {_SOURCE.format("source")} AS source_name, {_TOKENS.format("text")} AS n FROM documents),
    s AS (SELECT source_name, target_share, max_repeats, coalesce(sum(n), 0)::BIGINT AS n FROM t LEFT JOIN d USING (source_name) GROUP BY ALL)"""


def mixture(spark: SparkSession, directory: str) -> Mix:
    return mix(table(spark, directory, "documents"), table(spark, directory, "source_targets"), DOMAINS)


@CATALOG.query("p7_found", f"{_SHARES} SELECT source_name FROM s WHERE max_repeats * n < target_share * (SELECT sum(n) FROM s)")
def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return mixture(spark, directory).report.where(~F.col("can_reach")).select("source_name")


@CATALOG.query("p7_mix")
def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The mix itself, a row per use of a document."""
    return mixture(spark, directory).rows


@CATALOG.query("p7_shares")
def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixture(spark, directory).report


@CATALOG.query(
    "p7_share_checks",
    f"""{_SHARES} SELECT source_name, target_share, n AS tokens_available, max_repeats * n >= 0 AS within_cap,
        max_repeats * n < target_share * (SELECT sum(n) FROM s) AS used_up_short, 1.0::DOUBLE AS sum_of_shares FROM s""",
)
def p7_share_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of the reached shares, whichever records were taken."""
    cap = F.col("max_repeats") * F.col("tokens_available")
    return mixture(spark, directory).report.select(
        "source_name", "target_share", "tokens_available", F.col("tokens_used").between(0, cap).alias("within_cap"),
        ((F.col("tokens_used") == cap) & ~F.col("can_reach")).alias("used_up_short"), F.round(F.sum("reached_share").over(Window.partitionBy()), 9).alias("sum_of_shares"),
    )


NEAR_SAME = 0.7

_SPLIT = f"""CASE WHEN lower({_TRIM.format("split")}) IN ('train', 'training', 'tr', 'trn') THEN 'train'
             WHEN lower({_TRIM.format("split")}) IN ('valid', 'validation', 'val', 'dev') THEN 'valid'
             WHEN lower({_TRIM.format("split")}) IN ('test', 'testing', 'tst', 'te') THEN 'test' END"""
_OVERLAP = rf"""WITH m AS (SELECT DISTINCT lower({_TRIM.format("commit_id")}) AS id, {_SPLIT} AS split FROM commit_meta WHERE commit_id IS NOT NULL),
    line AS (SELECT lower({_TRIM.format("commit_id")}) AS id, unnest(lines) AS l FROM hunk_specs),
    w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(l.raw_text), '[a-z0-9_]+')) AS word FROM line WHERE l.change_type IN ('added', 'deleted')),
    n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
    c AS (SELECT a.id AS t, b.id AS e, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.id <> b.id
          WHERE a.id IN (SELECT id FROM m WHERE split = 'train') AND b.id IN (SELECT id FROM m WHERE split IN ('valid', 'test')) GROUP BY 1, 2),
    near AS (SELECT t, e FROM c JOIN n a ON a.id = t JOIN n b ON b.id = e WHERE c.c >= 0.7::DOUBLE * (a.n + b.n - c.c)),
    x AS (SELECT lower({_TRIM.format("commit_hash")}) AS h, {_SPLIT} AS split FROM excluded_commits_summary),
    o AS (SELECT 'commit_meta' AS source_table, b.split, a.id AS t, b.id AS e FROM m a JOIN m b ON a.id = b.id WHERE a.split = 'train' AND b.split IN ('valid', 'test')
          UNION ALL SELECT 'commit_meta', split, t, e FROM near JOIN m ON m.id = e AND split IN ('valid', 'test')
          UNION ALL SELECT 'excluded_commits_summary', x.split, m.id, m.id FROM x JOIN m ON starts_with(m.id, x.h) AND length(x.h) >= 12
          WHERE m.split = 'train' AND x.split IN ('valid', 'test'))"""


def overlap_members(spark: SparkSession, directory: str) -> DataFrame:
    """record, splits (distinct, sorted), is_train, is_eval of every commit of commit_meta."""
    rows = table(spark, directory, "commit_meta").where(F.col("commit_id").isNotNull())
    rows = rows.select(commit_key(F.col("commit_id")).alias("record"), split_key(F.col("split")).alias("split")).where(F.col("split").isNotNull())
    members = rows.groupBy("record").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    held = F.array_remove("splits", "train")
    return members.withColumns({"is_train": F.array_contains("splits", "train"), "is_eval": F.size(held) > 0, "held": held})


def changed_words(spark: SparkSession, directory: str) -> DataFrame:
    """record and terms, the words of the added and deleted lines of one hunk."""
    changed = F.filter("lines", lambda x: F.lower(trimmed(x["change_type"])).isin("added", "deleted"))
    text = F.array_join(F.transform(changed, lambda x: x["raw_text"]), "\n")
    return table(spark, directory, "hunk_specs").select(commit_key(F.col("commit_id")).alias("record"), word_hashes(text).alias("terms"))


def excluded_overlaps(spark: SparkSession, directory: str, members: DataFrame) -> DataFrame:
    """split, record: excluded records of an evaluation split that are training commits, once per split."""
    rows = table(spark, directory, "excluded_commits_summary").select(commit_key(F.col("commit_hash")).alias("hash"), split_key(F.col("split")).alias("split"))
    rows = rows.where(F.col("split").isin("valid", "test") & (F.length("hash") >= 12)).distinct()
    trained = members.where("is_train").select("record")
    short = F.substring("hash", 1, 12) == F.substring("record", 1, 12)
    return rows.join(trained, short & F.expr("startswith(record, hash)")).select("split", "record").distinct()


def overlaps(spark: SparkSession, directory: str) -> DataFrame:
    """source_table, split, train, held: a held-out record and the training commit that it repeats, once per split."""
    members = cut(overlap_members(spark, directory))
    records, _, pairs = split_overlap(members, changed_words(spark, directory), NEAR_SAME)
    t = records.where("is_train").select(F.col("class_id").alias("train_class"), F.col("record").alias("train"))
    e = records.where("is_eval").select(F.col("class_id").alias("eval_class"), F.col("record").alias("held"), F.explode("held").alias("split"))
    near = pairs.join(t, "train_class").join(e, "eval_class").where("train <> held").select("split", "train", "held")
    same = members.where("is_train").select(F.explode("held").alias("split"), F.col("record").alias("train"), F.col("record").alias("held"))
    meta = near.unionAll(same).select(F.lit("commit_meta").alias("source_table"), "split", "train", "held")
    there = excluded_overlaps(spark, directory, members)
    return meta.unionAll(there.select(F.lit("excluded_commits_summary").alias("source_table"), "split", F.col("record").alias("train"), F.col("record").alias("held")))


@CATALOG.query("p3_found", f"{_OVERLAP} SELECT DISTINCT source_table, least(t, e) AS commit_a, greatest(t, e) AS commit_b FROM o")
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = overlaps(spark, directory)
    return pairs.select("source_table", F.least("train", "held").alias("commit_a"), F.greatest("train", "held").alias("commit_b")).distinct()


@CATALOG.query(
    "p3_overlap_counts",
    f"""{_OVERLAP} SELECT source_table, split, count(DISTINCT (t, e)) AS n_pairs, count(DISTINCT e) AS n_held, count(DISTINCT t) AS n_train
    FROM o GROUP BY 1, 2""",
)
def p3_overlap_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs, held-out commits and training commits in them, per source table and evaluation split.

    Pairs are counted by their classes and never made: a pair of classes stands for the
    product of its commits on either side. Commits on both sides count as their own pair.
    """
    members = cut(overlap_members(spark, directory))
    records, _, pairs = split_overlap(members, changed_words(spark, directory), NEAR_SAME)
    records = records.select("record", "class_id")
    all_ = members.join(records, "record", "left").select("record", "class_id", "is_train", "held")
    trained = all_.where("is_train").groupBy("class_id").agg(F.count(F.lit(1)).alias("n_train"))
    held = all_.select("class_id", F.explode("held").alias("split")).groupBy("class_id", "split").agg(F.count(F.lit(1)).alias("n_eval"))
    met = pairs.join(trained.withColumnRenamed("class_id", "train_class"), "train_class").join(held.withColumnRenamed("class_id", "eval_class"), "eval_class")
    to_train = met.groupBy(F.col("eval_class").alias("class_id")).agg(F.lit(True).alias("met"))
    to_eval = met.select(F.col("train_class").alias("class_id"), "split").distinct().withColumn("met", F.lit(True))

    one = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    split = F.explode("held").alias("split")
    own = all_.where("is_train").select("class_id", split)  # commits on both sides: their own pair, which classes with words have counted already
    n_pairs = met.select("split", (F.col("n_train") * F.col("n_eval")).alias("n")).unionAll(own.where("class_id IS NULL").select("split", F.lit(1).cast("bigint")))
    n_pairs = n_pairs.groupBy("split").agg(F.sum("n").alias("n_pairs"))
    n_held = all_.select("class_id", "is_train", split).join(to_train, "class_id", "left")
    n_held = n_held.groupBy("split").agg(one(F.coalesce("met", "is_train"), "n_held"))
    mixed = all_.where("is_train").select("class_id", "held", F.explode(F.array(F.lit("valid"), F.lit("test"))).alias("split"))
    mixed = mixed.join(to_eval, ["class_id", "split"], "left")
    n_train = mixed.groupBy("split").agg(one(F.coalesce("met", F.array_contains("held", F.col("split"))), "n_train"))
    meta = n_pairs.join(n_held, "split").join(n_train, "split").select(F.lit("commit_meta").alias("source_table"), "split", "n_pairs", "n_held", "n_train")
    n = F.count(F.lit(1))
    there = excluded_overlaps(spark, directory, members).groupBy("split").agg(n.alias("n_pairs"), n.alias("n_held"), F.countDistinct("record").alias("n_train"))
    return meta.unionAll(there.select(F.lit("excluded_commits_summary"), "split", "n_pairs", "n_held", "n_train"))


@CATALOG.query(
    "p3_links",
    f"""{_OVERLAP}, k AS (SELECT id, list(word ORDER BY word) AS words FROM w WHERE id IN (SELECT id FROM m WHERE split IS NOT NULL) GROUP BY 1),
    side AS (SELECT t AS id FROM near UNION ALL SELECT e FROM near),
    l AS (SELECT id, count(*) AS n FROM side GROUP BY 1)
    SELECT k.id AS commit_id, min(k.id) OVER (PARTITION BY words) AS class_commit, coalesce(l.n, 0) AS n_links FROM k LEFT JOIN l USING (id)""",
)
def p3_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every commit with a split and changed words: the smallest commit with the same words and its number of links across the splits."""
    members = cut(overlap_members(spark, directory))
    records, _, pairs = split_overlap(members, changed_words(spark, directory), NEAR_SAME)
    sizes = records.groupBy("class_id").agg(F.count_if("is_train").alias("n_train"), F.count_if("is_eval").alias("n_eval"), F.min("record").alias("class_commit"))
    to_train = pairs.join(sizes, pairs["train_class"] == sizes["class_id"]).groupBy(F.col("eval_class").alias("class_id")).agg(F.sum("n_train").alias("to_train"))
    to_eval = pairs.join(sizes, pairs["eval_class"] == sizes["class_id"]).groupBy(F.col("train_class").alias("class_id")).agg(F.sum("n_eval").alias("to_eval"))
    out = records.join(sizes.select("class_id", "class_commit"), "class_id").join(to_train, "class_id", "left").join(to_eval, "class_id", "left")
    itself = (F.col("is_train") & F.col("is_eval")).cast("bigint")
    links = F.when(F.col("is_eval"), F.coalesce("to_train", F.lit(0)) - itself).otherwise(0) + F.when(
        F.col("is_train"), F.coalesce("to_eval", F.lit(0)) - itself
    ).otherwise(0)
    return out.select(F.col("record").alias("commit_id"), "class_commit", links.alias("n_links"))


@CATALOG.query("p8_found")
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return spam(table(spark, directory, "documents")).select("doc_id")


@CATALOG.query("p8_spam")
def p8_spam(spark: SparkSession, directory: str) -> DataFrame:
    """The found pages with the measures behind the decision."""
    return spam(table(spark, directory, "documents"))
