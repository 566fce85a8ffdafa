"""Perturbation curves over ranked regions under token or item budgets.

Scores of perturbed inputs are a table, not a callback: the prefixes of all fractions are
rows first, and whatever scores them runs over these rows. The additive scorer here (score
of an input = sum of the effects of its regions) needs no model and stays in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.scores import top_fraction


def budget_prefix(df: DataFrame, unit: Sequence[str], fractions: Sequence[float], rank: str = "rank", tokens: str = "tokens") -> DataFrame:
    """Rows of the shortest ranked prefix that reaches each token budget, with ``fraction`` and ``budget``.

    The budget is the fraction of the unit's tokens, rounded up, one at least; the region
    that crosses it is kept whole.
    """
    w = Window.partitionBy(*unit)
    run = F.sum(tokens).over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"__total": F.sum(tokens).over(w), "__run": run})
    rows = rows.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    budget = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("__total"))).cast("bigint")
    kept = rows.withColumn("budget", budget).where(F.col("__run") - F.col(tokens) < F.col("budget"))
    return kept.drop("__total", "__run")


def budget_realised(prefixes: DataFrame, unit: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Per unit and fraction: budget, n_regions, realised tokens and overshoot."""
    out = prefixes.groupBy(*unit, "fraction", "budget").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(tokens).alias("realised"))
    return out.withColumn("overshoot", F.greatest(F.lit(0), F.col("realised") - F.col("budget")))


def absolute_deletion_curve(df: DataFrame, unit: Sequence[str], fractions: Sequence[float], effect: str = "effect") -> DataFrame:
    """|change of the score| when the prefix of each fraction is blanked, under the additive scorer: unit, fraction, impact."""
    gone = budget_prefix(df, unit, fractions)
    return gone.groupBy(*unit, "fraction").agg(F.abs(F.sum(effect)).alias("impact"))


def removal_curve(df: DataFrame, unit: Sequence[str], fractions: Sequence[float], effect: str = "effect", rank: str = "rank") -> DataFrame:
    """Comprehensiveness, sufficiency (raw and as an error) and insertion gain of the first k = ceil(f n) regions.

    Under the additive scorer: the score of an input is the sum of the effects in it.
    """
    w = Window.partitionBy(*unit)
    rows = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__full": F.sum(effect).over(w)})
    rows = rows.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    k = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("__n")))
    only = F.sum(F.when(F.col(rank) <= k, F.col(effect)).otherwise(0.0))
    out = rows.groupBy(*unit, "fraction").agg(F.first("__full").alias("__full"), only.alias("__only"), F.count_if(F.col(rank) <= k).alias("k"))
    return out.select(
        *unit, "fraction", "k", F.col("__only").alias("comprehensiveness"), (F.col("__full") - F.col("__only")).alias("sufficiency"),
        F.abs(F.col("__full") - F.col("__only")).alias("sufficiency_error"), F.abs("__only").alias("insertion_gain"),
    )


def aopc(curve: DataFrame, unit: Sequence[str], value: str = "impact") -> DataFrame:
    """Mean over the fractions of a curve, 0 if it has none."""
    return curve.groupBy(*unit).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("aopc"))


def items_of_fraction(n: str, fraction: float):
    return top_fraction(F.col(n), fraction)
