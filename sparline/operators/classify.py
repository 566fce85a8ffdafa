"""Evaluation of scores against binary labels: one row in, per group one row out.

Ranks, thresholds and curves go through the distinct scores with their counts, so ties are
handled once and the windows run over distinct scores only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.scores import mcc


def confusion(df: DataFrame, threshold: float, group: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    cells = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    return df.groupBy(*group).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))


def rates(cm: DataFrame) -> DataFrame:
    """Adds precision, recall, specificity, f1, balanced_accuracy, mcc and positive_rate to a confusion; empty ratios are 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cm.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({
        "f1": ratio(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2, "mcc": mcc(tp, tn, fp, fn), "positive_rate": ratio(tp + fp, tp + fp + fn + tn),
    })


def _distinct_scores(df: DataFrame, group: Sequence[str], y: str, score: str) -> DataFrame:
    """Distinct scores with positives (__p) and rows (__n), and both from the top down to them (__tp, __k) and in all."""
    per = df.groupBy(*group, F.col(score).alias("__s")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group)
    down = w.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumns({"__tp": F.sum("__p").over(down), "__k": F.sum("__n").over(down), "__pos": F.sum("__p").over(w), "__all": F.sum("__n").over(w)})


def ranking_metrics(df: DataFrame, group: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """n, n_positive, roc_auc, average_precision (both null for one class), brier."""
    c = _distinct_scores(df, group, y, score)
    neg = F.col("__n") - F.col("__p")
    below = F.col("__all") - F.col("__pos") - (F.col("__k") - F.col("__tp"))  # negatives under this score
    wins = F.sum(F.col("__p") * (below + neg / 2))
    ap = F.sum(F.col("__p").cast("double") * F.col("__tp") / F.col("__k"))
    curve = c.groupBy(*group).agg(
        F.sum("__n").alias("n"), F.sum("__p").alias("n_positive"), wins.alias("__wins"), ap.alias("__ap"),
        (F.sum(F.col("__p") * F.pow(F.col("__s") - 1, F.lit(2))) + F.sum(neg * F.pow("__s", F.lit(2)))).alias("__sq"),
    )
    p, n = F.col("n_positive").cast("double"), F.col("n").cast("double")
    two = (p > 0) & (p < n)
    return curve.withColumns({
        "roc_auc": F.when(two, F.try_divide(F.col("__wins"), p * (n - p))), "average_precision": F.when(two, F.try_divide(F.col("__ap"), p)), "brier": F.col("__sq") / n,
    }).drop("__wins", "__ap", "__sq")


def best_f1_threshold(df: DataFrame, group: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """The threshold of best f1, then recall, then the lowest, among the distinct scores, 0 and 1; a hit is score >= threshold."""
    c = _distinct_scores(df, group, y, score).select(*group, F.col("__s").alias("threshold"), "__tp", "__k", "__pos", "__all")
    w = Window.partitionBy(*group)
    top = c.withColumn("__first", F.row_number().over(w.orderBy(F.desc("threshold")))).where("__first = 1").drop("__first")
    at0 = top.select(*group, F.lit(0.0).alias("threshold"), F.col("__pos").alias("__tp"), F.col("__all").alias("__k"), "__pos", "__all")
    at1 = c.where("threshold >= 1").groupBy(*group).agg(F.max("__tp").alias("__t1"), F.max("__k").alias("__k1"))
    ends = top.select(*group, F.lit(1.0).alias("threshold"), "__pos", "__all")
    ends = (ends.join(at1, list(group), "left") if group else ends.crossJoin(at1)).select(
        *group, "threshold", F.coalesce("__t1", F.lit(0)).alias("__tp"), F.coalesce("__k1", F.lit(0)).alias("__k"), "__pos", "__all"
    )
    every = c.unionByName(at0).unionByName(ends)
    zero = F.lit(0.0)
    every = every.withColumns({
        "recall": F.coalesce(F.try_divide(F.col("__tp").cast("double"), F.col("__pos")), zero),
        "f1": F.coalesce(F.try_divide(2.0 * F.col("__tp"), F.col("__k") + F.col("__pos")), zero),
    })
    best = F.max_by(F.struct("threshold", "f1", "recall"), F.struct("f1", "recall", -F.col("threshold")))
    return every.groupBy(*group).agg(best.alias("__b")).select(*group, "__b.*")


def score_distribution(df: DataFrame, group: Sequence[str], score: str, probabilities: Sequence[float]) -> DataFrame:
    """n, min, max, mean and the linear percentiles as p01, p25 and so on."""
    q = F.percentile(score, F.array(*(F.lit(float(p)) for p in probabilities)))
    out = df.where(F.col(score).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), q.alias("__q")
    )
    return out.withColumns({f"p{round(p * 100):02d}": F.col("__q")[i] for i, p in enumerate(probabilities)}).drop("__q")


def class_stats(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """n, mean, median, population deviation, min and max per class 0 and 1, null for a class without rows."""
    both = df.sparkSession.createDataFrame([(0,), (1,)], f"{y} int")
    per = df.groupBy(F.col(y).cast("int").alias(y)).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(score).alias("mean"), F.percentile(score, F.lit(0.5)).alias("median"), F.stddev_pop(score).alias("sd"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    return F.broadcast(both).join(per, y, "left").withColumn("n", F.coalesce("__n", F.lit(0))).drop("__n")


def best_checkpoint(epochs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The epoch of best pr_auc, then roc_auc, then the earliest."""
    best = F.max_by(F.struct("epoch", "pr_auc", "roc_auc"), F.struct("pr_auc", "roc_auc", -F.col("epoch")))
    return epochs.groupBy(*group).agg(best.alias("__b")).select(*group, "__b.*")


def outcome(y: Column, hit: Column) -> Column:
    return F.when(hit & (y == 1), "TP").when(~hit & (y == 1), "FN").when(hit, "FP").otherwise("TN")


def majority(df: DataFrame, keys: Sequence[str], vote: str, least: int = 2) -> DataFrame:
    """1 if at least half of the votes (0 or 1) say so, of keys with enough votes."""
    out = df.where(F.col(vote).isNotNull()).groupBy(*keys).agg(F.sum(vote).alias("__s"), F.count(F.lit(1)).alias("n_votes"))
    return out.where(F.col("n_votes") >= least).withColumn("majority", (2 * F.col("__s") >= F.col("n_votes")).cast("int")).drop("__s")


def metrics_bundle(df: DataFrame, thresholds: Sequence[float], group: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """All metrics of ``rates`` at each threshold with those of ``ranking_metrics``: a row per group and threshold."""
    group = list(group)
    at = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit, pos = F.col(score) >= F.col("threshold"), F.col(y) == 1
    cells = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    out = rates(at.groupBy(*group, "threshold").agg(*(F.count_if(c).alias(n) for n, c in cells.items())))
    ranked = ranking_metrics(df, group, y, score)
    return out.join(ranked, group) if group else out.join(ranked)  # without groups one row
