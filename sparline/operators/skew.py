"""Per-key results where a few keys hold most of the rows.

Value-frequency compression: rows are counted by (key, value) first, which spreads a hot
key over as many tasks as it has values and leaves one weighted row per value. Everything
per key (rows, exact distinct counts, modes, sums, exact percentiles) follows from the
weighted rows. Percentiles need an order within a key; it is built by radix levels of
2**16 buckets, so no window ever holds more than 2**16 rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.session import cut

RADIX_BITS = 16


def compress(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row per (key, value) with its number of rows as ``__n``; nulls are a key and a value like any other."""
    return df.groupBy(*key, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[names[k]]) for k in keys))
    return left.join(renamed, condition, how).drop(*names.values())


def weighted_percentiles(
    weighted: DataFrame, key: Sequence[str], probabilities: Sequence[float], bits: int = 64
) -> DataFrame:
    """Exact percentiles with linear interpolation per key from weighted integral values.

    weighted has the key columns, ``__v`` (byte to bigint, null rows are left out) and
    ``__n``. bits is the width of the value type, 32 or 64. Returns the key columns and
    ``percentiles``, an array of doubles in the order of ``probabilities``; keys without
    a value are absent. ``percentile`` of Spark gives the same numbers, but holds all the
    values of a key in one task.
    """
    rows = weighted.where(F.col("__v").isNotNull()).select(*key, F.col("__v").cast("bigint").alias("__v"), "__n")
    totals = rows.groupBy(*key).agg(F.sum("__n").alias("__total"))
    wanted = []
    for p in probabilities:
        at = (F.col("__total") - 1) * F.lit(float(p))
        wanted += [F.floor(at), F.ceil(at)]
    targets = totals.select(*key, F.array_distinct(F.array(*wanted)).alias("__ranks")).withColumn("__base", F.lit(0).cast("bigint"))

    path: list[str] = []
    for level, shift in enumerate(range(bits - RADIX_BITS, -1, -RADIX_BITS)):
        bucket = f"__b{level}"
        groups = [*key, *path]
        cells = rows.withColumn(bucket, F.shiftright("__v", shift))
        for i, name in enumerate(path):
            cells = cells.withColumn(name, F.shiftright("__v", bits - RADIX_BITS * (i + 1)))
        cells = cells.groupBy(*groups, bucket).agg(F.sum("__n").alias("__n"))
        found = _null_safe_join(cells, targets, groups)
        w = Window.partitionBy(*groups).orderBy(bucket)
        found = found.withColumn("__to", F.col("__base") + F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = found.withColumn("__from", F.col("__to") - F.col("__n"))
        hit = F.filter("__ranks", lambda r: (r >= F.col("__from")) & (r < F.col("__to")))
        found = found.withColumn("__ranks", hit).where(F.size("__ranks") > 0)
        targets = found.select(*groups, bucket, "__ranks", F.col("__from").alias("__base"))
        path.append(bucket)

    by_rank = (
        targets.select(*key, F.explode("__ranks").alias("__rank"), F.col(path[-1]).alias("__v"))
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    )
    done = _null_safe_join(totals, by_rank, key)
    values = []
    for p in probabilities:
        at = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col("__at")[F.floor(at)].cast("double"), F.col("__at")[F.ceil(at)].cast("double")
        values.append(low + (high - low) * (at - F.floor(at)))
    return done.select(*key, F.array(*values).alias("percentiles"))


def key_profile(
    df: DataFrame,
    key: Sequence[str],
    distinct: str,
    size: str | None = None,
    probabilities: Sequence[float] = (0.5, 0.9, 0.99),
    bits: int = 32,
) -> DataFrame:
    """Rows, distinct values, sizes, mode and percentiles for every key, hot or not.

    Returns the key columns and ``n_rows`` (all rows, null values too), ``n_distinct``
    (distinct non-null values of ``distinct``); with ``size``, an integral column, also
    ``n_sized``, ``size_total``, ``size_mode`` (the most frequent size, of ties the
    smallest) and ``size_percentiles``. A null key is a key; keys without a size have
    null totals, modes and percentiles; an empty table gives no rows. Columns that
    aren't named here are not read.
    """
    by_value = compress(df, key, distinct)
    rows = by_value.groupBy(*key).agg(
        F.sum("__n").alias("n_rows"), F.count("__v").alias("n_distinct")
    )
    if size is None:
        return rows
    weighted = cut(compress(df, key, size))  # read by every radix level
    sizes = weighted.where(F.col("__v").isNotNull()).groupBy(*key).agg(
        F.sum("__n").alias("n_sized"),
        F.sum(F.col("__v").cast("bigint") * F.col("__n")).alias("size_total"),
        F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias("size_mode"),
    )
    out = _null_safe_join(rows, sizes, key, "left")
    ranked = weighted_percentiles(weighted, key, probabilities, bits).withColumnRenamed("percentiles", "size_percentiles")
    return _null_safe_join(out, ranked, key, "left").withColumn("n_sized", F.coalesce("n_sized", F.lit(0)))


def heavy_keys(profile: DataFrame, within: Sequence[str], share: float) -> DataFrame:
    """Rows of ``key_profile`` whose ``n_rows`` make at least ``share`` of the rows of their ``within`` group."""
    totals = profile.groupBy(*within).agg(F.sum("n_rows").alias("__all"))
    return _null_safe_join(profile, totals, within).where(F.col("n_rows") >= F.col("__all") * F.lit(share)).drop("__all")
