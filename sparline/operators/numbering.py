"""Row numbers without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, name: str, digits: int = 3) -> DataFrame:
    """Adds ``name``, 0 to n - 1 over distinct keys in hash order, and ``n``.

    Rows fall into 16**digits buckets by the leading digits of the key's SHA-256; the
    buckets' sizes are summed up on at most so many rows and each bucket is ordered by
    itself, so the order is (bucket, key) and no task sees more than its bucket.
    """
    rows = df.withColumn("__bucket", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits))
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"), F.sum("__size").over(Window.partitionBy()).alias("n")
    )
    at = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    placed = rows.withColumn("__at", at).join(F.broadcast(offsets), "__bucket")  # 16**digits rows at most
    return placed.withColumn(name, F.col("__offset") + F.col("__at")).drop("__bucket", "__at", "__offset")


#: Steps into which the values between two powers of two fall when sums are run over them.
STEPS = 256


def _step(value: Column) -> Column:
    """A number that never falls as the value grows: its power of two and the part of the way to the next."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    at = (power + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    return F.when(value == 0, F.lit(0)).when(value > 0, at).otherwise(-at).cast("bigint")


def running_before(df: DataFrame, group: Sequence[str], by: str, size: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of the group with a smaller ``by`` (a number, distinct within its group).

    Values fall into ``STEPS`` steps between any two powers of two; sums are run over the
    steps, a few thousand at most, and values are put in order within a step only.
    """
    group = list(group)
    rows = df.withColumn("__step", _step(F.col(by).cast("double")))
    sums = rows.groupBy(*group, "__step").agg(F.sum(size).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "__step", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*group, "__step").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum(size).over(within), F.lit(0))).join(sums, [*group, "__step"])
    return placed.withColumn(name, F.col("__base") + F.col("__in")).drop("__step", "__in", "__base")


def values_at(counts: DataFrame, group: Sequence[str], by: str, size: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at given ranks (from 0, expressions of ``__total``, the rows of the group): group and a column per name.

    counts: group, ``by`` (distinct), ``size`` (its rows).
    """
    group = list(group)
    before = running_before(counts, group, by, size, "__before")
    total = counts.groupBy(*group).agg(F.sum(size).alias("__total"))
    rows = before.join(F.broadcast(total), group) if group else before.join(F.broadcast(total))
    hit = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col(size))
    return rows.groupBy(*group).agg(*(F.max(F.when(hit(r), F.col(by))).alias(n) for n, r in ranks.items()))
