"""Paired comparisons of methods over commits, and the statistics behind them.

Values are a long table (commit_id, method, seed, value); a missing value is a missing or
null row. The unit of inference is the commit: seeds are averaged within it first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparline.functions.ids import seed as seed_of
from sparline.functions.scores import better_direction, standardized_difference
from sparline.operators.cohorts import hash_text
from sparline.operators.numbering import numbered, running_before, values_at
from sparline.session import cut


def collapse_seeds(values: DataFrame, keys: Sequence[str], min_seeds: int = 2) -> DataFrame:
    """Mean over seeds per key, of keys with enough seeds: keys, value, n_seeds."""
    known = values.where(F.col("value").isNotNull())
    return known.groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_seeds")).where(F.col("n_seeds") >= min_seeds)


def two_level_mean(values: DataFrame, group: Sequence[str], min_seeds: int = 2) -> DataFrame:
    """Mean over commits of their means over seeds."""
    per = collapse_seeds(values, [*group, "commit_id"], min_seeds)
    return per.groupBy(*group).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_commits"))


def paired_differences(values: DataFrame, first: str, second: str, min_common: int = 2) -> DataFrame:
    """A row per commit known to either method: n_common seeds, their mean difference (null below ``min_common``), seeds."""
    known = values.where(F.col("value").isNotNull() & F.col("method").isin(first, second))
    a = F.max(F.when(F.col("method") == first, F.col("value"))).alias("__a")
    b = F.max(F.when(F.col("method") == second, F.col("value"))).alias("__b")
    per_seed = known.groupBy("commit_id", "seed").agg(a, b)
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    per = per_seed.groupBy("commit_id").agg(
        F.count_if(both).alias("n_common"), F.avg(F.when(both, F.col("__a") - F.col("__b"))).alias("diff"),
        F.sort_array(F.collect_list(F.when(both, F.col("seed")))).alias("seeds"),
    )
    return per.withColumn("diff", F.when(F.col("n_common") >= min_common, F.col("diff")))


def average_rank(df: DataFrame, by: Column, group: Sequence[str], name: str) -> DataFrame:
    """Adds ranks from 1 with ties at their mean."""
    df = df.withColumn("__by", by)
    rank = F.rank().over(Window.partitionBy(*group).orderBy("__by"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, "__by"))
    return df.withColumn(name, rank + (ties - 1) / 2).drop("__by")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


def _ranked_magnitudes(diffs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct magnitudes __m with their rows __t, those above and below zero, and their average rank __r.

    Rows are counted by magnitude first, and sums run over steps of distinct magnitudes.
    """
    d = F.col(value)
    per = diffs.where(d.isNotNull()).groupBy(*group, F.abs(d).alias("__m")).agg(
        F.count(F.lit(1)).alias("__t"), F.count_if(d > 0).alias("__up"), F.count_if(d < 0).alias("__down")
    )
    return running_before(per, group, "__m", "__t", "__before").withColumn("__r", F.col("__before") + (F.col("__t") + 1) / 2).drop("__before")


def signed_rank_report(diffs: DataFrame, group: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """``signed_rank`` and ``rank_biserial`` from the same ranks: without zeros every rank is less by their number."""
    group = list(group)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = _ranked_magnitudes(diffs, group, value).groupBy(*group).agg(
        total("__t").alias("n"), total(F.when(F.col("__m") == 0, F.col("__t"))).alias("n_zero"), F.sum(F.col("__r") * F.col("__up")).alias("r_plus"),
        F.sum(F.col("__r") * F.col("__down")).alias("r_minus"), F.coalesce(F.sum(F.when(F.col("__m") != 0, (F.pow("__t", F.lit(3)) - F.col("__t")) / 2)), F.lit(0.0)).alias("__ties"),
        F.sum("__up").alias("__ups"), F.sum("__down").alias("__downs"),
    )
    n, z = F.col("n").cast("double"), F.col("n_zero").cast("double")
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    variance = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("__ties")) / 24
    empty = F.col("n") == 0
    none = (F.col("n") == F.col("n_zero")) & ~empty
    statistic = F.least("r_plus", "r_minus")
    plus, minus = F.col("r_plus") - z * F.col("__ups"), F.col("r_minus") - z * F.col("__downs")
    out = out.withColumns({
        "statistic": F.when(none, 0.0).otherwise(statistic), "z": F.when(~none & (variance > 0), (statistic - mean) / F.sqrt(variance)),
        "state": F.when(empty, "EMPTY").when(none, "ALL_ZERO").otherwise("OK"), "rank_biserial": F.coalesce(F.try_divide(plus - minus, plus + minus), F.lit(0.0)),
    })
    return out.withColumn("p_value", F.when(none, 1.0).otherwise(normal_two_sided("z"))).drop("__ties", "__ups", "__downs")


def signed_rank(diffs: DataFrame, group: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """Wilcoxon's signed-rank test with Pratt's zeros and the normal approximation, per group.

    n, n_zero, r_plus, r_minus, statistic, z, p_value and state: OK, or ALL_ZERO with
    statistic 0 and p 1, or EMPTY with null results for no difference at all, ungrouped.
    Null differences are left out; a group without any is absent.
    """
    return signed_rank_report(diffs, group, value).drop("rank_biserial")


def rank_biserial(diffs: DataFrame, group: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """Matched-pairs effect size: zeros are dropped before ranking; 0 if all are zero."""
    return signed_rank_report(diffs, group, value).select(*group, "rank_biserial")


def difference_summary(diffs: DataFrame, group: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """n, mean, median and interquartile range (linear percentiles)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = diffs.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q.alias("__q"))
    return out.withColumns({"median": F.col("__q")[1], "iqr": F.col("__q")[2] - F.col("__q")[0]}).drop("__q")


def half_medians_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, population deviation and the range between the medians of the lower and upper half."""
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    n = F.col("__total")
    half = F.floor(n / 2)
    ends = {"m": (F.lit(0), n), "l": (F.lit(0), half), "h": (n - half, half)}  # first rank and size of the whole and both halves
    ranks = {f"__{k}{i}": a + F.floor((c - 1 + i) / 2) for k, (a, c) in ends.items() for i in (0, 1)}
    at = values_at(counts, group, "__v", "__c", ranks)
    v, c = F.col("__v"), F.col("__c")
    mean = F.sum(v * c) / F.sum(c)
    sums = counts.groupBy(*group).agg(F.sum(c).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * c) / F.sum(c) - mean * mean)).alias("sd"))
    out = sums.join(at, group) if group else sums.join(at)
    mid = lambda k: (F.col(f"__{k}0") + F.col(f"__{k}1")) / 2
    return out.select(*group, "n", "mean", mid("m").alias("median"), "sd", F.when(F.col("n") > 1, mid("h") - mid("l")).alias("iqr"))


def holm(df: DataFrame, family: Sequence[str], p: str = "p_value", order: str = "name") -> DataFrame:
    """Adds adjusted_p, step-down within each family over the non-null p; ties keep the order of ``order``."""
    w = Window.partitionBy(*family)
    rows = df.where(F.col(p).isNotNull())
    rank = F.row_number().over(w.orderBy(p, order))
    factor = F.count(F.lit(1)).over(w) - rank + 1
    step = rows.withColumns({"__step": F.least(F.lit(1.0), factor * F.col(p)), "__rank": rank})
    run = w.orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("adjusted_p", F.max("__step").over(run)).drop("__step", "__rank")


def seed_summary(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean and sample deviation over seeds, 0 for a single one."""
    v = values.where(F.col("value").isNotNull())
    return v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(F.stddev_samp("value")).alias("sd")
    )


def guarded_corr(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson's correlation as an aggregate; null for fewer pairs than ``least`` or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    ma, mb = F.avg(a), F.avg(b)
    va, vb = F.avg(a * a) - ma * ma, F.avg(b * b) - mb * mb
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (va > 0) & (vb > 0)
    return F.when((n >= least) & varies, (F.avg(a * b) - ma * mb) / F.sqrt(va * vb))


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Rank correlation per group with average ties: rho (null if undefined) and n."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = average_rank(rows, F.col(x), group, "__rx")
    rows = average_rank(rows, F.col(y), group, "__ry")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), guarded_corr(F.col("__rx"), F.col("__ry"), least).alias("rho"))


def ols_residual(df: DataFrame, group: Sequence[str], y: str, x: str) -> DataFrame:
    """Adds residual: what is left of y after a line in x, fitted per group; y minus its mean if x is constant."""
    w = Window.partitionBy(*group)
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    mx, my = F.avg(xd).over(w), F.avg(yd).over(w)
    rows = df.withColumns({"__dx": xd - mx, "__dy": yd - my})
    slope = F.coalesce(F.try_divide(F.sum(F.col("__dx") * F.col("__dy")).over(w), F.sum(F.col("__dx") * F.col("__dx")).over(w)), F.lit(0.0))
    return rows.withColumn("residual", F.col("__dy") - slope * F.col("__dx")).drop("__dx", "__dy")


def seed_pair_stability(df: DataFrame, unit: Sequence[str], value: str = "score", item: str = "region_id", least: int = 2) -> DataFrame:
    """Rank correlation of each pair of seeds over the items both have: unit, seed_a, seed_b, n, rho."""
    a = df.select(*unit, item, F.col("seed").alias("seed_a"), F.col(value).alias("__a"))
    b = df.select(*unit, item, F.col("seed").alias("seed_b"), F.col(value).alias("__b"))
    met = a.join(b, [*unit, item]).where("seed_a < seed_b")
    return spearman(met, [*unit, "seed_a", "seed_b"], "__a", "__b", least).where(F.col("n") >= least)


def cliffs_delta(df: DataFrame, label: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Dominance of the values with label 1 over those with 0, from rank sums instead of all pairs."""
    group = list(group)
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(one.alias("__p"), zero.alias("__q"))
    below = running_before(counts, group, "__v", "__q", "__below")
    n1, n0 = F.sum("__p"), F.sum("__q")
    u = F.sum(F.col("__p") * (F.col("__below") + F.col("__q") / 2))
    return below.groupBy(*group).agg(n1.alias("n_1"), n0.alias("n_0"), (2 * F.try_divide(u, n1.cast("double") * n0) - 1).alias("delta"))


def point_biserial(df: DataFrame, group: Sequence[str], value: str, label: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), guarded_corr(F.col(value), F.col(label)).alias("r"))


def bootstrap(df: DataFrame, value: str, cluster: str, repeats: int, salt: str, percentiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of the mean under resampling of clusters with replacement.

    Draw i of a repeat is the cluster whose number is a hash of the salt, the repeat and i,
    so the draws are the same everywhere. Clusters enter as sums and counts; a repeat costs
    a row per draw, spread over the repeats. Returns estimate, low, high, n_clusters.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    clusters = numbered(sums, cluster, "__i").withColumnRenamed("n", "__n")
    draws = clusters.select("__i", "__n").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draws = draws.select("repeat", (seed_of(F.lit(salt), F.col("repeat").cast("string"), F.col("__i").cast("string"), modulus=None) % F.col("__n")).alias("__i"))
    means = draws.join(clusters, "__i").groupBy("repeat").agg((F.sum("__s") / F.sum("__c")).alias("__m"))
    ends = means.agg(F.percentile("__m", F.array(*map(F.lit, percentiles))).alias("__q"))
    whole = sums.agg((F.sum("__s") / F.sum("__c")).alias("estimate"), F.count(F.lit(1)).alias("n_clusters"))
    return whole.crossJoin(ends).select("estimate", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "n_clusters")


def grouped_bootstrap(
    df: DataFrame, group: Sequence[str], value: str, cluster: str, repeats: int, salt: str, percentiles: tuple[float, float] = (0.025, 0.975), together: int = 500
) -> DataFrame:
    """As ``bootstrap`` for every group, with numpy's generator, for many repeats.

    A group's clusters enter as sums and counts, 24 bytes each, and go to one task per
    ``together`` repeats. Every repeat has its own generator, seeded by the salt, the group
    and the repeat, so the draws depend neither on partitions nor on ``together``. Returns
    the group, estimate, low, high, n_clusters, repeats; null values and clusters are left out.
    """
    group = list(group)
    known = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull())
    sums = known.groupBy(*group, cluster).agg(F.sum(F.col(value).cast("double")).alias("__s"), F.count(F.lit(1)).alias("__c"))
    parts = F.sequence(F.lit(0), F.lit((repeats - 1) // together))
    spread = sums.select(*group, F.xxhash64(cluster).alias("__h"), "__s", "__c", F.explode(parts).alias("__part"))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", "__s", "__c"])
        s, c, name = pdf["__s"].to_numpy(), pdf["__c"].to_numpy(), hash_text("|".join([salt, *map(str, key[:-1])]))
        means = []
        for repeat in range(int(key[-1]) * together, min(repeats, (int(key[-1]) + 1) * together)):
            at = np.random.default_rng([name, repeat]).integers(0, len(s), len(s))
            means.append(s[at].sum() / c[at].sum())
        return pd.DataFrame([(*key[:-1], m, s.sum() / c.sum(), len(s)) for m in means], columns=[*group, "__m", "estimate", "n_clusters"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", __m double, estimate double, n_clusters bigint"
    out = spread.groupBy(*group, "__part").applyInPandas(draw, schema).groupBy(*group).agg(
        F.percentile("__m", F.array(*map(F.lit, percentiles))).alias("__q"), F.count(F.lit(1)).alias("repeats"),
        F.max("estimate").alias("estimate"), F.max("n_clusters").alias("n_clusters"),
    )
    return out.select(*group, "estimate", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "n_clusters", "repeats")


def pairwise_report(values: DataFrame, pairs: Sequence[tuple[str, str]], metric_direction: str = "HIGHER_BETTER") -> DataFrame:
    """One row per pair of methods: universe, included commits, test, effect size, summary, direction, adjusted p.

    values has one row per commit, seed and method. All pairs are made in one pass over them.
    """
    known = values.where(F.col("value").isNotNull())
    wide = known.groupBy("commit_id", "seed").agg(F.map_from_entries(F.collect_list(F.struct("method", "value"))).alias("__m"))
    cells = [
        F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.try_element_at("__m", F.lit(a)).alias("a"), F.try_element_at("__m", F.lit(b)).alias("b")) for a, b in pairs
    ]
    rows = wide.select("commit_id", F.inline(F.array(*cells))).where("a IS NOT NULL OR b IS NOT NULL")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    per = rows.groupBy("method_a", "method_b", "commit_id").agg(F.count_if(both).alias("n_common"), F.avg(F.when(both, F.col("a") - F.col("b"))).alias("d"))
    diffs = cut(per.withColumn("diff", F.when(F.col("n_common") >= 2, F.round("d", 9))).drop("d"))
    by = ["method_a", "method_b"]
    size = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count("diff").alias("n_included"))
    out = size.join(signed_rank_report(diffs, by).drop("n"), by, "left")
    out = out.join(difference_summary(diffs, by).drop("n"), by, "left")
    out = out.withColumn("better", F.when(F.col("n_included") > 0, better_direction(F.col("mean"), metric_direction)))
    adjusted = holm(out.withColumn("__name", F.concat_ws("|", *by)), [], "p_value", "__name").select(*by, "adjusted_p")
    return out.join(adjusted, by, "left")


def expand_draw(draw: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of every drawn cluster, as often as it was drawn: the rows of a cluster stay together. draw: ``key``, one row per draw."""
    times = draw.groupBy(key).agg(F.count(F.lit(1)).alias("__times"))
    return rows.join(times, key).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__k", "__times")


def family_holm(reports: DataFrame, family: str, p: str = "p_value", order: str = "name", role: str = "PRIMARY") -> DataFrame:
    """``holm`` over the reports of one family and role (columns of these names)."""
    return holm(reports.where((F.col("family") == family) & (F.col("role") == role)), [], p, order)


def one_sample_report(values: DataFrame, group: Sequence[str] = (), value: str = "diff") -> DataFrame:
    """Signed-rank test against 0, its effect size and the summary of commit values, in one row per group."""
    group = list(group)
    tests, summary = signed_rank_report(values, group, value), difference_summary(values, group, value).drop("n")
    return tests.join(summary, group, "left") if group else tests.join(summary)  # without groups one row each


def contrast(values: DataFrame, pair: tuple[str, str], family: str, role: str, repeats: int, salt: str) -> DataFrame:
    """The report of a pair of methods with the bootstrap interval of its mean difference: ``pairwise_report`` and low, high, repeats."""
    report = pairwise_report(values, [pair]).withColumns({"family": F.lit(family), "role": F.lit(role)})
    diffs = paired_differences(values, *pair).where(F.col("diff").isNotNull()).withColumn("__one", F.lit(1))
    interval = grouped_bootstrap(diffs, ["__one"], "diff", "commit_id", repeats, salt).select("low", "high", "repeats")
    return report.join(interval)  # one row each


def difference_gate(df: DataFrame, value: str, mean: float, p95: float, largest: float) -> DataFrame:
    """mean, median, p90, p95 and max of a difference, and PASS if mean, p95 and max are all within their limits."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = df.where(F.col(value).isNotNull()).agg(F.avg(value).alias("mean"), q.alias("__q"), F.max(value).alias("max"))
    out = out.select("mean", F.col("__q")[0].alias("median"), F.col("__q")[2].alias("p95"), "max")
    within = (F.col("mean") <= mean) & (F.col("p95") <= p95) & (F.col("max") <= largest)
    return out.withColumn("gate", F.when(within, "PASS").otherwise("FAIL"))


def rank_agreement(df: DataFrame, unit: Sequence[str], item: str, side: str, value: str, first: str, second: str) -> DataFrame:
    """Spearman's rho of two sides per unit, of units in which both have the same items: unit, n, rho."""
    unit = list(unit)
    met = df.groupBy(*unit, item).agg(F.max(F.when(F.col(side) == first, F.col(value))).alias("__x"), F.max(F.when(F.col(side) == second, F.col(value))).alias("__y"))
    same = met.groupBy(*unit).agg(F.bool_and(F.col("__x").isNotNull() & F.col("__y").isNotNull()).alias("__same")).where("__same").drop("__same")
    return spearman(met.join(same, unit), unit, "__x", "__y")


def group_balance(df: DataFrame, flag: str, variables: Sequence[str], limit: float) -> DataFrame:
    """variable, mean_1, mean_0, sd_1, sd_0, smd and whether |smd| reaches ``limit``, for rows with and without ``flag``."""
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("__v")) for v in variables))
    rows = df.select(F.col(flag).alias("__f"), F.inline(cells)).where("__v IS NOT NULL AND __f IS NOT NULL")
    one, zero = F.when(F.col("__f"), F.col("__v")), F.when(~F.col("__f"), F.col("__v"))
    out = rows.groupBy("variable").agg(F.avg(one).alias("mean_1"), F.avg(zero).alias("mean_0"), F.stddev_pop(one).alias("sd_1"), F.stddev_pop(zero).alias("sd_0"))
    out = out.withColumn("smd", standardized_difference(F.col("mean_1"), F.col("mean_0"), F.col("sd_1"), F.col("sd_0")))
    return out.withColumn("unbalanced", F.abs("smd") >= limit)
