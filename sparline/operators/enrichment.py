"""Aggregation of token scores to lines and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The categories of tokens.
CATEGORIES = (
    "PROMPT_INSTRUCTION", "COMMIT_MESSAGE", "FILE_PATH", "HUNK_HEADER", "ADDED_CODE",
    "DELETED_CODE", "CONTEXT_CODE", "STRUCTURAL_MARKUP", "SPECIAL_TOKEN",
)
REDUCTIONS = ("SUM", "MEAN", "MAX_ABS_WITH_SIGN")


def reduce_scores(df: DataFrame, keys: Sequence[str], reduction: str = "SUM", score: str = "score", order: str = "position") -> DataFrame:
    """One score per key: the sum, the mean, or the score of largest magnitude (of ties the first by ``order``). Null keys are left out."""
    agg = {
        "SUM": F.sum(score), "MEAN": F.avg(score), "MAX_ABS_WITH_SIGN": F.max_by(score, F.struct(F.abs(score), -F.col(order))),
    }[reduction]
    return df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(agg.alias("score"))


def category_mass(df: DataFrame, unit: Sequence[str], category: str = "category", score: str = "score") -> DataFrame:
    """All categories of every unit: n_tokens, signed sum, absolute mass, shares of both, enrichment.

    enrichment is the share of mass over the share of tokens, null for a category without
    tokens; without any mass all shares of mass are 0. An unknown category is an error.
    """
    known = F.col(category).isin(*CATEGORIES)
    bad = F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(F.col(category), F.lit("null")))).cast("string")
    rows = df.withColumn("__c", F.when(known, F.col(category)).otherwise(bad))
    per = rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.abs(score)).alias("__mass"),
        *(agg.alias(f"__{i}{c}") for c in CATEGORIES for i, agg in (
            ("n", F.count_if(F.col("__c") == c)), ("s", F.coalesce(F.sum(F.when(F.col("__c") == c, F.col(score))), F.lit(0.0))),
            ("m", F.coalesce(F.sum(F.when(F.col("__c") == c, F.abs(score))), F.lit(0.0))),
        )),
    )
    cells = [F.struct(F.lit(c).alias("category"), F.col(f"__n{c}").alias("n_tokens"), F.col(f"__s{c}").alias("signed_sum"), F.col(f"__m{c}").alias("mass")) for c in CATEGORIES]
    out = per.select(*unit, "__n", "__mass", F.inline(F.array(*cells)))
    token_share = F.col("n_tokens") / F.col("__n")
    mass_share = F.coalesce(F.try_divide(F.col("mass"), F.col("__mass")), F.lit(0.0))
    out = out.withColumns({"token_share": token_share, "mass_share": mass_share})
    return out.withColumn("enrichment", F.try_divide("mass_share", "token_share")).drop("__n", "__mass")
