"""Checks composed of joins and aggregates: known keys, upserts, coverage, agreement, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def known_keys(keys: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Distinct keys that the table has (``known``) and has not (``unknown``): kind, n."""
    mine = keys.select(F.col(key).alias("__k")).distinct()
    there = table.select(F.col(table_key).alias("__k")).distinct()
    known = mine.join(there, "__k", "left_semi").select(F.lit("known").alias("kind"))
    unknown = mine.join(there, "__k", "left_anti").select(F.lit("unknown").alias("kind"))
    return known.unionAll(unknown).groupBy("kind").agg(_n())


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The table with ``column`` from ``changes`` where these have the key: keys, column, action (kept, inserted or updated)."""
    new = changes.select(*keys, F.col(column).alias("__new"), F.lit(True).alias("__there"))
    out = table.join(new, list(keys), "left")
    action = F.when(F.col("__there").isNull(), "kept").when(F.col(column).isNull(), "inserted").otherwise("updated")
    return out.select(*keys, F.coalesce("__new", column).alias(column), action.alias("action"))


def two_level_share(scores: DataFrame, unit: Sequence[str], group: str, over: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean over ``over`` of the mean share of magnitude that each ``group`` has in a unit: by, group, mean_share, n."""
    cells = scores.groupBy(*unit, group).agg(F.sum(F.abs("score")).alias("__m"))
    totals = cells.groupBy(*unit).agg(F.sum("__m").alias("__all")).where("__all > 0")
    share = cells.join(totals, list(unit)).groupBy(*over, *by, group).agg(F.avg(F.col("__m") / F.col("__all")).alias("__s"))
    return share.groupBy(*by, group).agg(F.avg("__s").alias("mean_share"), _n("n_commits"))


def label_multiplicity(lines: DataFrame, bag: DataFrame, unit: Sequence[str], text: str, order: str) -> DataFrame:
    """Adds label: 1 for the first rows of a text in a unit, as many as the bag holds of it, else 0. bag: unit, text, one row per marked copy."""
    marked = bag.groupBy(*unit, text).agg(_n("__marked"))
    at = F.row_number().over(Window.partitionBy(*unit, text).orderBy(order)) - 1
    return lines.withColumn("__at", at).join(marked, [*unit, text], "left").withColumn("label", (F.col("__at") < F.coalesce("__marked", F.lit(0))).cast("int")).drop("__at", "__marked")


def file_ordinals(lines: DataFrame, unit: str, path: str, position: str, hunk: str) -> DataFrame:
    """Files of a unit numbered from 0 by their first line, with their hunks: unit, path, file_ordinal, n_hunks."""
    files = lines.where(F.col(position).isNotNull()).groupBy(unit, path).agg(F.min(position).alias("__first"), F.count_distinct(hunk).alias("n_hunks"))
    return files.select(unit, path, (F.row_number().over(Window.partitionBy(unit).orderBy("__first", path)) - 1).alias("file_ordinal"), "n_hunks")


def tallies(rows: DataFrame, key: str, counts: dict[str, Column], by: DataFrame) -> DataFrame:
    """``by`` with a count of rows per condition, 0 where there are none, and __there: whether the key has rows at all."""
    per = rows.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in counts.items())).withColumn("__there", F.lit(True))
    out = by.join(per, key, "left")
    return out.withColumns({**{n: F.coalesce(n, F.lit(0)) for n in counts}, "__there": F.coalesce("__there", F.lit(False))})


def count_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides by which has more rows: n, n_equal, n_more (of the first)."""
    tagged = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionAll(b.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    per = tagged.groupBy(key).agg(F.sum("__a").alias("x"), F.sum("__b").alias("y")).where("x > 0 AND y > 0")
    return per.agg(_n(), F.count_if(F.col("x") == F.col("y")).alias("n_equal"), F.count_if(F.col("x") > F.col("y")).alias("n_more"))


def mapping_classes(rows: DataFrame, key: str, positive: Column, mapped: Column) -> DataFrame:
    """Units by how many of their positive rows are mapped: NO_POSITIVE, COMPLETE, PARTIAL, NONE; class, n."""
    p = F.coalesce(positive, F.lit(False))
    per = rows.groupBy(key).agg(F.count_if(p).alias("__p"), F.count_if(p & mapped).alias("__m"))
    cls = F.when(F.col("__p") == 0, "NO_POSITIVE").when(F.col("__p") == F.col("__m"), "COMPLETE").when(F.col("__m") > 0, "PARTIAL").otherwise("NONE")
    return per.groupBy(cls.alias("class")).agg(_n())


def unit_profile(lines: DataFrame, key: str, positive: Column) -> DataFrame:
    """Lines, positive lines, files, hunks and the share of positives per unit, from counts per hunk."""
    per = lines.groupBy(key, "path", "hunk_ordinal").agg(_n("__n"), F.count_if(positive).alias("__p"))
    files = per.groupBy(key, "path").agg(F.sum("__n").alias("__n"), F.sum("__p").alias("__p"), _n("__h"))
    out = files.groupBy(key).agg(F.sum("__n").alias("n_lines"), F.sum("__p").alias("n_positive"), F.count("path").alias("n_files"), F.sum(F.when(F.col("path").isNotNull(), F.col("__h"))).alias("n_hunks"))
    return out.withColumn("density", F.col("n_positive") / F.col("n_lines"))


def incomplete_units(units: DataFrame, key: str, done: Column, expected: int, owners: DataFrame, by: str) -> DataFrame:
    """Units per owner, and those with fewer finished rows than expected: by, n_commits, n_incomplete."""
    per = units.groupBy(key).agg(F.count_if(done).alias("__done"))
    return per.join(owners.select(key, by), key).groupBy(by).agg(_n("n_commits"), F.count_if(F.col("__done") < expected).alias("n_incomplete"))


def largest_difference(rows: DataFrame, keys: Sequence[str], side: str, first: str, second: str, value: str, by: Sequence[str], tolerance: float) -> DataFrame:
    """Over keys that both sides have: n, the largest difference and how many lie within the tolerance, from one pass."""
    x, y = (F.max(F.when(F.col(side) == s, F.col(value))) for s in (first, second))
    met = rows.where(F.col(side).isin(first, second)).groupBy(*keys).agg(x.alias("__x"), y.alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    d = F.abs(F.col("__x") - F.col("__y"))
    return met.groupBy(*by).agg(_n(), F.max(d).alias("largest"), F.count_if(d <= tolerance).alias("n_within"))


def long_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """by, metric, n, mean of several columns, turned into rows."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("__v")) for m in metrics))
    return df.select(*by, F.inline(cells)).groupBy(*by, "metric").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"))
