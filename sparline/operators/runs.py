"""Job grids, ledgers, missingness and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.session import cut

STATUSES = ("PENDING", "RUNNING", "DONE", "FAILED", "OOM", "NONCONVERGED", "SKIPPED")


def job_grid(commits: DataFrame, methods: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every commit with every method and seed; the small sides are literals, so nothing is joined."""
    rows = commits.select("commit_id", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    return rows.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; a partial aggregation, so a key with many rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def pending(grid: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs of the grid that no finished row of the ledger covers."""
    done = ledger.where(is_done(F.col("status"), F.col("code"))).select(*keys)
    return grid.join(done, list(keys), "left_anti")


def is_done(status: Column, code: Column) -> Column:
    return F.coalesce(status.isin("DONE", "NONCONVERGED") & code.isin("OK", "IG_NONCONVERGED", "TRUNCATED"), F.lit(False))


def is_valid(status: Column, code: Column, method: Column) -> Column:
    """Finished without fault; integrated gradients must have converged. Null is no."""
    bad = (method == "integrated_gradients") & (F.coalesce(code, F.lit("OTHER")) == "IG_NONCONVERGED")
    return F.coalesce((status == "DONE") & (code == "OK") & ~bad, F.lit(False))


def missingness(units: DataFrame, by: Sequence[str] = ("method", "seed")) -> DataFrame:
    """Rows per method, seed and code; a null code is OTHER."""
    return units.groupBy(*by, F.coalesce("code", F.lit("OTHER")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def method_results(units: DataFrame) -> DataFrame:
    s = F.col("status")
    return units.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "DONE").alias("n_done"), F.count_if(s.isin("FAILED", "OOM")).alias("n_failed"),
        F.count_if(s == "NONCONVERGED").alias("n_nonconverged"),
    )


def complete_cases(units: DataFrame, n_expected: int) -> DataFrame:
    """Commits of which all expected units are there and OK."""
    per = units.groupBy("commit_id").agg(F.count(F.lit(1)).alias("__n"), F.bool_and(F.coalesce(F.col("code") == "OK", F.lit(False))).alias("__ok"))
    return per.where((F.col("__n") == n_expected) & F.col("__ok")).select("commit_id")


def status_counts(ledger: DataFrame) -> DataFrame:
    """A row for every status, with 0 for those that don't occur."""
    cells = [F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("n")) for s in STATUSES]
    return ledger.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))


def passes(n_commits: Column, method: Column, regions: Column, steps: int = 50, retry_steps: int = 100, retried: float = 0.0) -> Column:
    """Forward and backward passes that a method takes: one, two, or one per region or step."""
    ig = n_commits * (2.0 * steps + retried * 2.0 * retry_steps)
    return (
        F.when(method.startswith("attention"), n_commits * 1.0).when(method.isin("gradient", "grad_x_input"), n_commits * 2.0)
        .when(method == "integrated_gradients", ig).when(method.startswith("occlusion"), n_commits * (1.0 + regions))
    )


def batches(n_items: Column, size: int) -> Column:
    return F.ceil(n_items / size)


def faithfulness_is_valid(faith_code: Column, aopc: Column, status: Column, code: Column, method: Column) -> Column:
    """A curve may be used if it was made without fault, has a value, and its attribution is valid. Null is no."""
    return F.coalesce((faith_code == "OK") & aopc.isNotNull() & is_valid(status, code, method), F.lit(False))


def compute_passes(n_commits: Column, regions: Column, method: Column, steps: int) -> tuple[Column, Column]:
    """Forward and backward passes of a method over all commits."""
    path = method == "integrated_gradients"
    forward = F.when(path, n_commits * steps).when(method.startswith("occlusion"), n_commits * (1 + regions)).otherwise(n_commits)
    backward = F.when(path, n_commits * steps).when(method.isin("gradient", "grad_x_input"), n_commits).otherwise(0.0)
    return forward, backward


def ordered_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``key`` (distinct) in order, with the number of its batch of ``size``: sorted by ranges, which are numbered by their counts."""
    rows = cut(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    out = rows.withColumn("__at", place).join(F.broadcast(counts.select("__p", before.alias("__base"))), "__p")
    return out.select(key, F.floor((F.col("__base") + F.col("__at")) / size).alias("batch"))
