"""Profiles and consistency checks of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """n, n_unique, n_null, n_duplicated keys and extra rows, from counts per key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known, n = F.col(key).isNotNull(), F.col("__n")
    return per.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.count_if(known).alias("n_unique"), F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("n_null"),
        F.count_if(known & (n > 1)).alias("n_duplicated"), F.coalesce(F.sum(F.when(known, n - 1)), F.lit(0)).alias("n_extra"),
    )


def frequencies(df: DataFrame, value: str, top: int) -> DataFrame:
    """The most frequent values, of ties the smallest; null is a value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(value)).limit(top)


def set_counts(df: DataFrame, item: str, where: dict[str, Column]) -> DataFrame:
    """For every combination of the named sets, the number of distinct items that are in exactly these."""
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in where.items()]
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(*flags).groupBy(*where).agg(F.count(F.lit(1)).alias("n_items"))


def set_equivalence(df: DataFrame, unit: Sequence[str], item: str, side: str, change: str) -> DataFrame:
    """Whether two sides have the same items of each kind of change: EXACT, ADDED, DELETED or MISMATCH.

    side is A or B, change added or deleted. Sides are compared by counts per item, so no
    set is ever collected; two empty sides are EXACT.
    """
    per = df.groupBy(*unit, change, item).agg(F.bool_or(F.col(side) == "A").alias("__a"), F.bool_or(F.col(side) == "B").alias("__b"))
    odd = F.col("__a") != F.col("__b")
    out = per.groupBy(*unit).agg(F.count_if(odd & (F.col(change) == "added")).alias("__x"), F.count_if(odd & (F.col(change) == "deleted")).alias("__y"))
    both = F.when((F.col("__x") == 0) & (F.col("__y") == 0), "EXACT").when(F.col("__x") == 0, "ADDED").when(F.col("__y") == 0, "DELETED")
    return out.select(*unit, both.otherwise("MISMATCH").alias("equivalence"))


def multiset_equal(a: DataFrame, b: DataFrame, unit: Sequence[str], item: str) -> DataFrame:
    """Per unit of either side: n_a, n_b and whether they hold the same items as often."""
    tagged = a.select(*unit, item, F.lit(1).alias("__d")).unionAll(b.select(*unit, item, F.lit(-1).alias("__d")))
    per = tagged.groupBy(*unit, item).agg(F.count_if(F.col("__d") == 1).alias("__a"), F.count_if(F.col("__d") == -1).alias("__b"))
    return per.groupBy(*unit).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"), F.bool_and(F.col("__a") == F.col("__b")).alias("equal"))


def collisions(df: DataFrame, key: str) -> DataFrame:
    """n mapped and unmapped rows, distinct keys, keys with several rows and the rows in these."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known, n = F.col(key).isNotNull(), F.col("__n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return per.agg(
        total(known).alias("n_mapped"), total(~known).alias("n_unmapped"), F.count_if(known).alias("n_keys"), F.count_if(known & (n > 1)).alias("n_colliding"),
        total(known & (n > 1)).alias("n_rows_colliding"),
    )


def chronology(df: DataFrame, group: Sequence[str], split: str, at: str, order: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """First and last time per group and split in one row, and whether each split ends before the next begins (null if unknown)."""
    ends = [f(F.when(F.col(split) == s, F.col(at))).alias(f"{s}_{n}") for s in order for n, f in (("first", F.min), ("last", F.max))]
    out = df.groupBy(*group).agg(*ends)
    return out.withColumns({f"{a}_before_{b}": F.col(f"{a}_last") < F.col(f"{b}_first") for a, b in zip(order, order[1:])})


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], group: Sequence[str] = ()) -> DataFrame:
    """Rows left after each of the nested conditions, in one pass."""
    so_far, cells = F.lit(True), []
    for name, condition in steps:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        cells.append(F.count_if(so_far).alias(name))
    return df.groupBy(*group).agg(*cells)


def alignment(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys in both, in one only, and those in both whose values differ."""
    x, y = a.select(key, F.col(value).alias("__x")).distinct(), b.select(key, F.col(value).alias("__y")).distinct()
    met = x.withColumn("__a", F.lit(True)).join(y.withColumn("__b", F.lit(True)), key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return met.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("__b").isNull()).alias("n_first_only"), F.count_if(F.col("__a").isNull()).alias("n_second_only"),
        F.count_if(both & ~F.col("__x").eqNullSafe(F.col("__y"))).alias("n_different"),
    )


def cross_rates(df: DataFrame, by: Sequence[str], flag: Column) -> DataFrame:
    f = F.coalesce(flag, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_true"), F.avg(f.cast("double")).alias("rate"))


def grouping_rows(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """One pass over several groupings; columns that a grouping leaves out are null, __set says which grouping."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    return out.agg(F.grouping_id(*every).alias("grouping"), *aggregates)


def neighbours(df: DataFrame, unit: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds previous and next value in order, and the nearest known value before and after."""
    w = Window.partitionBy(*unit).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({
        "previous": F.lag(value).over(w), "next": F.lead(value).over(w), "known_before": F.last(value, True).over(before), "known_after": F.first(value, True).over(after),
    })


def ordered_digest(df: DataFrame, group: Sequence[str], key: str, prefix: int) -> DataFrame:
    """group, digest: SHA-256 over the digests of the sorted keys of each leading ``prefix`` characters, in order."""
    part = F.substring(key, 1, prefix).alias("__b")
    held = df.groupBy(*group, part).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("__h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__h"))), lambda x: x["__h"]), "\n")
    return held.groupBy(*group).agg(F.sha2(whole, 256).alias("digest"))


def intersection(a: DataFrame, b: DataFrame, key: str, examples: int) -> DataFrame:
    """n_a, n_b, n_both distinct keys and the first SHA-256 names of common ones, with commas between."""
    tagged = a.select(key, F.lit(1).alias("__s")).unionAll(b.select(key, F.lit(2).alias("__s"))).where(F.col(key).isNotNull())
    per = tagged.groupBy(key).agg(F.bool_or(F.col("__s") == 1).alias("__a"), F.bool_or(F.col("__s") == 2).alias("__b"))
    counts = per.agg(F.count_if("__a").alias("n_a"), F.count_if("__b").alias("n_b"), F.count_if(F.col("__a") & F.col("__b")).alias("n_both"))
    first = per.where("__a AND __b").select(F.sha2(F.col(key), 256).alias("__h")).orderBy("__h").limit(examples)
    shown = first.agg(F.array_join(F.array_sort(F.collect_list("__h")), ",").alias("examples"))
    return counts.join(shown).withColumn("examples", F.when(F.col("n_both") > 0, F.col("examples")))  # one row each


def order_verdict(a: DataFrame, b: DataFrame, unit: Sequence[str], key: str, place: str) -> DataFrame:
    """Per unit of either list: SAME_ORDER, SAME_KEYS (in another order), ONE_SIDED (one holds the other) or MISMATCH."""
    unit = list(unit)
    met = a.select(*unit, key, F.col(place).alias("__x")).join(b.select(*unit, key, F.col(place).alias("__y")), [*unit, key], "full_outer")
    n, x, y = F.count(F.lit(1)), F.count("__x"), F.count("__y")
    same = F.bool_and(F.col("__x") == F.col("__y"))
    verdict = F.when((x == n) & (y == n), F.when(same, "SAME_ORDER").otherwise("SAME_KEYS")).when((x == n) | (y == n), "ONE_SIDED").otherwise("MISMATCH")
    return met.groupBy(*unit).agg(verdict.alias("verdict"))


#: What a column is for, by its name; the first pattern that fits counts.
ROLES = (("TIME", r"(_at|_date|^ts)$"), ("LABEL", r"^(is_|label|y$)|_label$"), ("ID", r"(_id|hash)$|^id$"), ("GROUP", r"^(project|split|source|lang)$"))


def column_roles(df: DataFrame) -> DataFrame:
    """column, role, n_null, n_distinct of every column, in one pass over the table; columns of no known name are OTHER."""

    def role(name: str) -> str:
        return next((r for r, pattern in ROLES if re.search(pattern, name)), "OTHER")

    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(role(c)).alias("role"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct")) for c in df.columns
    ]
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))
