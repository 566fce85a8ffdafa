"""A resumable run of jobs: grid, cache, execution, ledger, results, all as tables in one folder.

A run is three append-only tables (ledger, results, cache) and an identity. Every attempt
plans the units that no finished row of the ledger covers, takes from the cache what is
there under the same digest, executes the rest as one DataFrame and appends. Results are
written before the ledger, so a run that dies in between repeats units but loses none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparline.operators.runs import latest
from sparline.session import cut
from sparline.sources.records import exists

UNIT = ("commit_id", "seed", "method", "granularity")
#: Which states may follow which, and those that a resumed run takes up again.
FOLLOWS = {
    "PENDING": ("RUNNING", "SKIPPED"), "RUNNING": ("RUNNING", "DONE", "FAILED", "OOM", "NONCONVERGED", "SKIPPED"), "FAILED": ("RUNNING",), "OOM": ("RUNNING",),
    "DONE": (), "NONCONVERGED": (), "SKIPPED": (),
}
RETRYABLE = ("PENDING", "RUNNING", "FAILED", "OOM")
TERMINAL = ("DONE", "FAILED", "OOM", "NONCONVERGED", "SKIPPED")

Executor = Callable[[DataFrame], DataFrame]


def may_follow(before: Column, after: Column) -> Column:
    """Whether a unit in state ``before`` (null: not seen yet) may go to ``after``."""
    allowed = F.create_map(*(x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    return F.when(before.isNull(), after == "PENDING").otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, before), after), F.lit(False)))


def unit_id(keys: Sequence[str] = UNIT) -> Column:
    return F.concat_ws("|", *(F.col(k).cast("string") for k in keys))


def cache_key(identity: Mapping[str, object], keys: Sequence[str] = UNIT) -> Column:
    """SHA-256 over everything that the result of a unit depends on: the identity of the run and the unit."""
    return F.sha2(F.concat_ws("|", F.lit(json.dumps(identity, sort_keys=True, default=str)), unit_id(keys)), 256)


@dataclass
class Run:
    """``folder`` must be shared by all executors; ``identity`` says what the results depend on; ``cache`` may be shared by runs."""

    spark: SparkSession
    folder: str
    identity: Mapping[str, object]
    cache: str
    keys: Sequence[str] = UNIT

    def open(self) -> Run:
        """Write the identity, or check it: a run is only resumed under the identity that it began with."""
        path = f"{self.folder}/identity"
        mine = {k: json.dumps(v, default=str) for k, v in self.identity.items()}
        if not exists(self.spark, path):
            rows = sorted(mine.items())
            self.spark.createDataFrame(rows, "name string, value string").coalesce(1).write.parquet(path)
            return self
        there = {r["name"]: r["value"] for r in self.spark.read.parquet(path).collect()}  # a row per field of the identity
        odd = sorted(k for k in {*mine, *there} if mine.get(k) != there.get(k))
        if odd:
            raise RuntimeError("this run was begun under another identity: " + ", ".join(odd))
        return self

    def _table(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _key_schema(self, grid: DataFrame) -> str:
        kinds = dict(grid.dtypes)
        return ", ".join(f"{k} {kinds[k]}" for k in self.keys)

    def history(self, grid: DataFrame) -> DataFrame:
        """All rows of the ledger."""
        return self._table(f"{self.folder}/ledger", f"{self._key_schema(grid)}, status string, code string, attempt int")

    def ledger(self, grid: DataFrame) -> DataFrame:
        """The latest state of every unit: keys, status, code, attempt."""
        return latest(self.history(grid), list(self.keys), ["attempt"])

    def results(self, grid: DataFrame) -> DataFrame:
        """The latest result of every finished unit: keys, digest, payload."""
        rows = self._table(f"{self.folder}/results", f"{self._key_schema(grid)}, digest string, payload array<double>, attempt int")
        done = self.ledger(grid).where("status = 'DONE'").select(*self.keys)
        return latest(rows, list(self.keys), ["attempt"]).drop("attempt").join(done, list(self.keys), "left_semi")

    def plan(self, grid: DataFrame) -> DataFrame:
        """Units of the grid that are new or retryable, with their attempt (from 1) and digest."""
        state = self.ledger(grid).select(*self.keys, "status", F.col("attempt").alias("__last"))
        rows = grid.select(*self.keys).join(state, list(self.keys), "left")
        open_ = rows.where(F.col("status").isNull() | F.col("status").isin(*RETRYABLE))
        return open_.select(*self.keys, (F.coalesce("__last", F.lit(0)) + 1).alias("attempt"), cache_key(self.identity, self.keys).alias("digest"))

    def resume(self, grid: DataFrame, execute: Executor) -> dict[str, int]:
        """One attempt at everything open: numbers of units planned, cached and executed.

        ``execute`` takes keys, attempt and digest and gives keys, digest, status (one of
        ``TERMINAL``), code and payload (array<double>), a row per unit.
        """
        todo = cut(self.plan(grid))
        kept = self._table(self.cache, "digest string, payload array<double>, checksum string")
        sound = kept.where(F.col("checksum") == checksum(F.col("digest"), F.col("payload"))).groupBy("digest").agg(F.any_value("payload").alias("payload"))
        hits = todo.join(sound, "digest").withColumns({"status": F.lit("DONE"), "code": F.lit("OK")})
        fresh = execute(todo.join(sound, "digest", "left_anti")).join(todo.select("digest", "attempt"), "digest")
        known = F.col("status").isin(*TERMINAL)
        wrong = F.raise_error(F.concat(F.lit("no state to end in: "), F.coalesce("status", F.lit("null")))).cast("string")
        columns = [*self.keys, "attempt", "digest", "status", "code", "payload", "fresh"]
        out = hits.withColumn("fresh", F.lit(False)).select(*columns).unionByName(fresh.withColumns({"fresh": F.lit(True), "status": F.when(known, F.col("status")).otherwise(wrong)}).select(*columns))
        out = cut(out)
        good = out.where("status = 'DONE'")
        good.select(*self.keys, "digest", "payload", "attempt").write.mode("append").parquet(f"{self.folder}/results")
        new = good.where("fresh").select("digest", "payload", checksum(F.col("digest"), F.col("payload")).alias("checksum"))
        new.write.mode("append").parquet(self.cache)
        out.select(*self.keys, "status", "code", "attempt").write.mode("append").parquet(f"{self.folder}/ledger")
        n = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fresh")).alias("c")).first()
        return {"planned": n["n"], "cached": n["c"], "executed": n["n"] - n["c"]}


def checksum(digest: Column, payload: Column) -> Column:
    """What a cached row must carry to be used: a digest over its key and values."""
    return F.sha2(F.concat_ws("|", digest, F.array_join(F.transform(payload, lambda x: x.cast("string")), ",")), 256)
