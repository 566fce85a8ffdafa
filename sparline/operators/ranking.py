"""Ranking of lines and effort-aware localization.

Contract: one row per candidate line and ranking, with the columns of ``unit`` (say
commit_id, method, seed), region_id, score, status (POSITIVE, NEGATIVE or
NOT_IN_RQ1_UNIVERSE) and position. One window per unit serves every metric, followed by
one aggregation on the same key: a single shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.ids import hash_order
from sparline.functions.scores import effort_items, ranking_score
from sparline.operators.cohorts import hash_text

UNIVERSE = ("POSITIVE", "NEGATIVE")
OUTSIDE = "NOT_IN_RQ1_UNIVERSE"


def rq1_universe(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows with a known label; any status beyond the three known ones is an error."""
    name = F.regexp_replace(F.col(status), "^RQ1_", "")
    bad = F.raise_error(F.concat(F.lit("unexpected status "), F.coalesce(name, F.lit("null")))).cast("string")
    checked = F.when(name.isin(*UNIVERSE, OUTSIDE), name).otherwise(bad)
    return df.withColumn(status, checked).where(F.col(status) != OUTSIDE)


def ranked(df: DataFrame, unit: Sequence[str], transform: str = "RAW") -> DataFrame:
    """Adds rank_score and rank (from 1): score descending, then position, then region_id ascending."""
    scored = df.withColumn("rank_score", ranking_score(F.col("score"), transform))
    order = Window.partitionBy(*unit).orderBy(F.desc("rank_score"), F.asc("position"), F.asc("region_id"))
    return scored.withColumn("rank", F.row_number().over(order))


def ranked_by_magnitude(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Adds rank (from 0): |score| descending, then region_id; the order of stability and faithfulness."""
    order = Window.partitionBy(*unit).orderBy(F.desc(F.abs("score")), F.asc("region_id"))
    return df.withColumn("rank", F.row_number().over(order) - 1)


def metrics_of_ranks(df: DataFrame, unit: Sequence[str], rank: str = "rank", effort: float = 0.2, recall: float = 0.2) -> DataFrame:
    """Localization metrics of ranked lines (rank from 1, status POSITIVE or NEGATIVE).

    n, n_positive, top1, top5, top10, ifa (negatives before the first positive, n if there
    is none), recall_at_effort, effort_at_recall and state: OK, or NO_POSITIVE with null
    metrics. Units without a line are absent.
    """
    positive = F.col("status") == "POSITIVE"
    w = Window.partitionBy(*unit)
    one = positive.cast("int")
    seen = F.sum(one).over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__pos": F.sum(one).over(w), "__seen": seen})
    need = F.greatest(F.lit(1), F.floor(F.lit(recall) * F.col("__pos")))
    hit = lambda k: F.max(F.when(positive & (F.col(rank) <= k), 1).otherwise(0))
    out = rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"), F.sum(one).alias("n_positive"), *(hit(k).alias(f"top{k}") for k in (1, 5, 10)),
        F.coalesce(F.min(F.when(positive, F.col(rank))) - 1, F.count(F.lit(1))).alias("ifa"),
        F.sum((positive & (F.col(rank) <= effort_items(F.col("__n"), effort))).cast("int")).alias("__found"),
        F.min(F.when(F.col("__seen") >= need, F.col(rank))).alias("__at"),
    )
    none = F.col("n_positive") == 0
    out = out.withColumns({
        "recall_at_effort": F.when(~none, F.col("__found") / F.col("n_positive")),
        "effort_at_recall": F.when(~none, F.col("__at") / F.col("n")),
        "state": F.when(none, "NO_POSITIVE").otherwise("OK"),
    })
    return out.withColumns({c: F.when(~none, F.col(c)) for c in ("top1", "top5", "top10", "ifa")}).drop("__found", "__at")


def localization(df: DataFrame, unit: Sequence[str], transform: str = "RAW") -> DataFrame:
    """Filter to the labelled universe, rank, measure."""
    return metrics_of_ranks(ranked(rq1_universe(df), unit, transform), unit)


def length_baseline(tokens: Column) -> Column:
    return tokens.cast("double")


def order_baseline(position: Column) -> Column:
    return -position.cast("double")


def add_first_baseline(df: DataFrame, unit: Sequence[str], change: str = "change_type") -> DataFrame:
    """Score 1 for added lines, 0 for others; null where all lines of the unit are added, which ranks nothing."""
    added = F.upper(F.col(change)).isin("ADD", "ADDED", "ADDED_CODE", "+")
    degenerate = F.bool_and(added).over(Window.partitionBy(*unit))
    return df.withColumn("score", F.when(~degenerate, added.cast("double")))


def negative_hit_rate(df: DataFrame, unit: Sequence[str], k: int, eps: float = 0.0) -> DataFrame:
    """Of the positives among the k lines of largest |score|: how many, and the part with a score below -eps."""
    top = ranked_by_magnitude(df, unit).where((F.col("rank") < k) & (F.col("status") == "POSITIVE"))
    return top.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg((F.col("score") < -eps).cast("double")).alias("negative_rate")
    )


def random_baseline(df: DataFrame, unit: Sequence[str], repeats: int, salt: str = "RANDOM") -> DataFrame:
    """Mean recall at 20 % effort over ``repeats`` hashed permutations of the labelled lines of a unit.

    Every line is ranked once per repeat, a shuffle of repeats times the rows, all within
    the key of the unit and the repeat.
    """
    rows = rq1_universe(df).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = hash_order(F.col("region_id"), F.lit(salt), F.col("repeat").cast("string"))
    order = Window.partitionBy(*unit, "repeat").orderBy(key, "region_id")
    per = metrics_of_ranks(rows.withColumn("rank", F.row_number().over(order)), [*unit, "repeat"])
    return per.where("state = 'OK'").groupBy(*unit).agg(F.avg("recall_at_effort").alias("recall_at_effort"), F.count(F.lit(1)).alias("n_repeats"))


def permuted_baseline(df: DataFrame, unit: str, repeats: int, salt: str = "RANDOM", effort: float = 0.2) -> DataFrame:
    """As ``random_baseline`` with permutations of numpy's generator, for many repeats.

    The labels of a unit come together once, in the order of region_id, and are permuted
    in place, so a repeat costs no row. The generator is seeded by the salt and the unit.
    Units without a positive line are left out; a unit must fit a task with its region_ids.
    """
    lines = F.sort_array(F.collect_list(F.struct("region_id", (F.col("status") == "POSITIVE").alias("p"))))
    per = rq1_universe(df).groupBy(unit).agg(F.transform(lines, lambda x: x["p"].cast("tinyint")).alias("__p"))
    per = per.where(F.array_contains("__p", F.lit(1).cast("tinyint"))).select(unit, "__p", effort_items(F.size("__p"), effort).alias("__k"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = []
            for key, flags, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                p = flags.values.to_numpy()
                rng = np.random.default_rng(hash_text(f"{salt}|{key}"))
                found = sum(int(rng.permutation(p)[:k].sum()) for _ in range(repeats))
                means.append(found / int(p.sum()) / repeats)
            n = pa.array([repeats] * len(means), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(means, pa.float64()), n], [unit, "recall_at_effort", "n_repeats"])

    return per.mapInArrow(draw, f"{unit} {dict(df.dtypes)[unit]}, recall_at_effort double, n_repeats bigint")


def signed_minus_absolute(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Recall at 20 % effort of the positive part of the scores minus that of their magnitude."""
    kinds = {"SIGNED_POSITIVE": "signed", "ABS": "absolute"}
    cells = F.array(*(F.struct(F.lit(n).alias("__kind"), ranking_score(F.col("score"), k).alias("__s")) for k, n in kinds.items()))
    both = df.select("*", F.inline(cells)).withColumn("score", F.col("__s")).drop("__s")
    per = localization(both, [*unit, "__kind"], "RAW").where("state = 'OK'")  # both rankings in one pass
    out = per.groupBy(*unit).agg(*(F.max(F.when(F.col("__kind") == n, F.col("recall_at_effort"))).alias(n) for n in kinds.values()))
    return out.where("signed IS NOT NULL AND absolute IS NOT NULL").withColumn("delta", F.col("signed") - F.col("absolute"))
