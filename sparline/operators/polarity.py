"""Signed scores: classes under a relative epsilon, agreement of methods, extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.scores import polarity, polarity_epsilon


def classify(df: DataFrame, unit: Sequence[str], score: str = "score", name: str = "polarity") -> DataFrame:
    largest = F.max(F.abs(score)).over(Window.partitionBy(*unit))
    return df.withColumn(name, polarity(F.col(score), largest))


def summary(df: DataFrame, unit: Sequence[str], top_k: int = 5) -> DataFrame:
    """Per unit: n, epsilon, fractions of the classes, ids of the k most positive and most negative regions."""
    rows = classify(df, unit)
    w = Window.partitionBy(*unit)
    up, down = (F.row_number().over(w.orderBy(o, "region_id")) for o in (F.desc("score"), F.asc("score")))
    rows = rows.withColumns({"__up": up, "__down": down})
    share = lambda c: F.avg((F.col("polarity") == c).cast("double"))
    ids = lambda k, c: F.transform(
        F.array_sort(F.collect_list(F.when((F.col(k) <= top_k) & (F.col("polarity") == c), F.struct(k, "region_id")))), lambda x: x["region_id"]
    )
    return rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"), polarity_epsilon(F.max(F.abs("score"))).alias("epsilon"), share("POSITIVE").alias("positive_fraction"),
        share("NEGATIVE").alias("negative_fraction"), share("NEAR_ZERO").alias("near_zero_fraction"), ids("__up", "POSITIVE").alias("top_positive"),
        ids("__down", "NEGATIVE").alias("top_negative"),
    )


def sign_agreement(a: DataFrame, b: DataFrame, unit: Sequence[str], item: str = "region_id") -> DataFrame:
    """Per unit, over the regions both sides score, each under its own epsilon: n, n_agree, n_opposite, agreement."""
    met = a.select(*unit, item, F.col("score").alias("__a")).join(b.select(*unit, item, F.col("score").alias("__b")), [*unit, item])
    met = classify(classify(met, unit, "__a", "__pa"), unit, "__b", "__pb")
    signed = (F.col("__pa") != "NEAR_ZERO") & (F.col("__pb") != "NEAR_ZERO")
    out = met.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(signed).alias("n_signed"), F.count_if(signed & (F.col("__pa") == F.col("__pb"))).alias("n_agree"),
        F.count_if(signed & (F.col("__pa") != F.col("__pb"))).alias("n_opposite"),
    )
    return out.withColumn("agreement", F.coalesce(F.try_divide(F.col("n_agree").cast("double"), F.col("n_signed")), F.lit(0.0)))


def top_hunks_negative(attention: DataFrame, deltas: DataFrame, unit: Sequence[str], k: int = 2) -> DataFrame:
    """Of the k hunks of highest score, the part whose occlusion delta is negative; the epsilon is over these deltas alone."""
    order = Window.partitionBy(*unit).orderBy(F.desc("score"), F.asc("region_id"))
    top = attention.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).select(*unit, "region_id")
    met = top.join(deltas.select(*unit, "region_id", F.col("score").alias("__d")), [*unit, "region_id"], "left")
    met = classify(met, unit, "__d", "__p")
    return met.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n_top"), F.count("__d").alias("n_scored"), F.avg((F.coalesce("__p", F.lit("")) == "NEGATIVE").cast("double")).alias("negative_fraction")
    )
