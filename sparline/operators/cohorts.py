"""Cohorts: matching, coverage samples, stratified and hashed samples.

members: commit_id, project, tokens, split, is_positive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.ids import hash_order
from sparline.operators.numbering import running_before
from sparline.session import cut


def matched_negatives(positives: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """For the first n positives by id, one to one and in that order, the unused negative of the
    same project (or else of any) with the nearest token count, of ties the smallest id.

    Greedy matching without replacement is sequential in the positives: it runs as one
    grouped pass over n positives and, for each, only the candidates that can matter: by
    project and over all, the n nearest on either side of its token count, as at most n - 1
    are used up before. commit_id, matched_id, same_project, distance.
    """
    first = cut(positives.orderBy("commit_id").limit(n).select("commit_id", "project", F.col("tokens").cast("bigint").alias("tokens")))
    pool = pool.select(F.col("commit_id").alias("id"), "project", F.col("tokens").cast("bigint").alias("t"))
    lists = []
    for same in (True, False):
        keys = ["project"] if same else []
        mine = pool.join(F.broadcast(first.select("project").distinct()), "project", "left_semi") if same else pool  # n projects at most
        # Of equal counts only the n smallest ids can ever be taken, so a frequent count is no burden.
        kept = cut(mine.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "t").orderBy("id"))).where(F.col("__i") <= n))
        counts = kept.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("__c"))
        asked = first.select(*keys, F.col("tokens").alias("t"), F.lit(0).cast("bigint").alias("__c"))
        places = running_before(counts.unionAll(asked).groupBy(*keys, "t").agg(F.sum("__c").alias("__c")), keys, "t", "__c", "__before")
        total = counts.groupBy(*keys).agg(F.sum("__c").alias("__all"))
        ranked = kept.join(places, [*keys, "t"])
        ranked = ranked.join(F.broadcast(total), keys) if keys else ranked.join(F.broadcast(total))
        up, down = F.col("__before") + F.col("__i") - 1, F.col("__all") - F.col("__before") - F.col("__c") + F.col("__i") - 1
        at = first.withColumnRenamed("commit_id", "positive").withColumnRenamed("tokens", "t").join(places, [*keys, "t"])
        at = at.join(F.broadcast(total), keys) if keys else at.join(F.broadcast(total))
        for place, begin in ((up, F.col("__before")), (down, F.col("__all") - F.col("__before"))):
            asked = at.select("positive", *keys, F.explode(F.sequence(begin, begin + n - 1)).alias("__k"))
            found = asked.join(ranked.select(*keys, "id", "t", place.alias("__k")), [*keys, "__k"])
            lists.append(found.select("positive", "id", "t", F.lit(same).alias("same")))
    near = reduce(DataFrame.unionAll, lists).join(first.select(F.col("commit_id").alias("positive"), "tokens"), "positive")
    near = near.withColumn("distance", F.abs(F.col("t") - F.col("tokens")))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        rows = []
        for pos, cand in pdf.sort_values(["positive", "same", "distance", "id"], ascending=[True, False, True, True]).groupby("positive", sort=True):
            for i, same, d in zip(cand["id"], cand["same"], cand["distance"]):
                if i not in used:
                    used.add(i)
                    rows.append((pos, i, bool(same), int(d)))
                    break
        return pd.DataFrame(rows, columns=["commit_id", "matched_id", "same_project", "distance"])

    schema = "commit_id string, matched_id string, same_project boolean, distance bigint"
    return near.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(greedy, schema)


def rehearsal_cohort(members: DataFrame, n: int) -> DataFrame:
    """n members that cover projects and quartiles of size: first the smallest of every project
    in every quartile, by project and quartile, then the others by quartile and id. Adds quartile and place."""
    counts = members.groupBy("tokens").agg(F.count(F.lit(1)).alias("__c"))
    before = running_before(counts, [], "tokens", "__c", "__before").drop("__c")
    n_all = members.agg(F.count(F.lit(1)).alias("__n"))
    rows = members.join(before, "tokens").join(F.broadcast(n_all))  # one row
    rows = rows.withColumn("__k", F.col("__before") + F.row_number().over(Window.partitionBy("tokens").orderBy("commit_id")) - 1)
    q = F.greatest(F.lit(1), F.floor(F.col("__n") / 4))
    rows = rows.withColumn("quartile", F.least(F.lit(3), F.floor(F.col("__k") / q)).cast("int"))
    first = F.row_number().over(Window.partitionBy("project", "quartile").orderBy("__k")) == 1
    turn = F.when(F.col("__lead"), F.struct(F.lit(0).alias("a"), F.col("project").alias("b"), F.col("quartile").alias("c"), F.lit("").alias("d"))).otherwise(
        F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("quartile").alias("c"), F.col("commit_id").alias("d"))
    )
    few = rows.withColumn("__lead", first).withColumn("__turn", turn).orderBy("__turn").limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy("__turn")) - 1).drop("__k", "__n", "__lead", "__before", "__turn")


def hashed_sample(df: DataFrame, n: int, key: str, salt: str) -> DataFrame:
    """n rows in hash order, the same on every run; of ties the smallest key. A distributed top-n."""
    order = hash_order(F.col(key), F.lit(salt))
    return df.withColumn("__h", order).orderBy("__h", key).limit(n).drop("__h")


def hashed_sample_per_group(df: DataFrame, group: Sequence[str], n: Column, key: str, salt: str) -> DataFrame:
    """The first n rows of each group in hash order; n may be a column that is constant in a group."""
    w = Window.partitionBy(*group).orderBy(hash_order(F.col(key), F.lit(salt)), key)
    return df.withColumns({"place": F.row_number().over(w), "__n": n}).where(F.col("place") <= F.col("__n")).drop("__n")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: str, salt: str) -> DataFrame:
    """n rows with the strata in proportion: quotas rounded down, the rest to the largest remainders, then the first by stratum."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size"))
    exact = F.col("__size") * F.lit(float(n)) / F.sum("__size").over(Window.partitionBy())
    sizes = sizes.withColumns({"__exact": exact, "__base": F.floor(exact)})
    more = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__base"), 9)), *strata)) <= n - F.sum("__base").over(Window.partitionBy())
    quota = sizes.select(*strata, (F.col("__base") + more.cast("int")).alias("quota"))
    few = hashed_sample_per_group(df, strata, F.lit(n), key, salt)  # no stratum gets more, so what is sorted stays small
    return few.join(quota, list(strata)).where(F.col("place") <= F.col("quota"))


def covering_sample(df: DataFrame, label: str, project: str, n: int, key: str, salt: str) -> DataFrame:
    """n rows with the labels (boolean) in proportion, in hash order, changed to cover the projects: key, label, project.

    For every project without a row in the sample, by name, its row with the smallest key
    takes the place of the first sampled row (true labels first, in hash order) of the same
    label whose project has several rows, if there is one. Rows with a null label are left
    out; null is no project to be covered. Fewer than n rows are taken whole. The driver holds n rows and as
    many that may be swapped in of either label: each sampled row is replaced once at most.
    """
    known = df.where(F.col(label).isNotNull()).select(key, label, project)
    size = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    if pos + neg <= n:
        return known
    n_pos = max(1, min(round(n * pos / (pos + neg)), pos, n - 1)) if pos else 0
    n_pos = max(n_pos, n - neg)
    order = [hash_order(F.col(key), F.lit(salt)), F.col(key)]
    out = [tuple(r) for value, k in ((True, n_pos), (False, n - n_pos)) for r in known.where(F.col(label) == value).orderBy(*order).limit(k).collect()]
    have = Counter(r[2] for r in out)
    spark = df.sparkSession
    seen = F.broadcast(spark.createDataFrame([(p,) for p in have if p is not None], f"{project} string"))  # n projects at most
    missing = known.where(F.col(project).isNotNull()).join(seen, project, "left_anti").groupBy(project).agg(F.min_by(F.struct(key, label), key).alias("__r"))
    missing = missing.select("__r.*", project)
    swaps = [tuple(r) for value, k in ((True, n_pos), (False, n - n_pos)) for r in missing.where(F.col(label) == value).orderBy(project).limit(k).collect()]
    at = {True: 0, False: n_pos}
    for row in sorted(swaps, key=lambda r: r[2].encode()):
        i, end = at[row[1]], n_pos if row[1] else n
        while i < end and have[out[i][2]] < 2:  # counts only fall, so what was passed over stays
            i += 1
        if i < end:
            have[out[i][2]] -= 1
            have[row[2]] = 1
            out[i] = row
            i += 1
        at[row[1]] = i
    return spark.createDataFrame(out, known.schema)


#: Cells of a block of draws that are made at once.
BLOCK_CELLS = 1 << 20


def _draws(df: DataFrame, unit: Sequence[str], constants: Sequence[str], trials: int, salt: int, sizes: Callable[..., tuple[np.ndarray, np.ndarray]], close: float) -> DataFrame:
    """unit, region_ids, total_tokens of the best of ``trials`` seeded random orders of each unit's regions.

    ``sizes`` gives, for the running token sums of a block of orders and the unit's
    constants, how many regions each order takes and how far it is off; one that is off by
    ``close`` or less ends the search. A unit's regions come to one row, in order of
    region_id, so the draws don't depend on partitions.
    """
    unit = list(unit)
    fixed = [F.max(c).cast("bigint").alias(c) for c in constants]
    held = df.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("region_id", F.col("tokens").cast("bigint").alias("tokens")))).alias("__r"), *fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regions = b.column("__r")
            at = regions.offsets.to_numpy() - regions.offsets[0].as_py() if len(regions) else np.zeros(1, np.int64)
            flat = regions.flatten()
            names, all_tokens = flat.field("region_id"), flat.field("tokens").to_numpy()
            values = [b.column(c).to_numpy() for c in constants]
            chosen, totals = [], []
            for i, key in enumerate(zip(*(b.column(u).to_pylist() for u in unit))):
                tokens = all_tokens[at[i] : at[i + 1]]
                rng = np.random.default_rng([salt, *(abs(hash_text(str(k))) for k in key)])
                best, far, done = np.zeros(0, np.int64), np.inf, 0
                while done < trials and far > close:
                    size = max(1, min(32, trials - done, BLOCK_CELLS // len(tokens)))
                    order = rng.random((size, len(tokens))).argsort(axis=1)
                    k, off = sizes(tokens[order].cumsum(axis=1), *(v[i] for v in values))
                    first = int(np.argmax(off <= close)) if (off <= close).any() else int(off.argmin())
                    if off[first] < far:
                        best, far = order[first, : k[first]], off[first]
                    done += size
                chosen.append(names.take(pa.array(np.sort(best) + at[i])))
                totals.append(int(tokens[best].sum()))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, chosen)]), pa.int32()), pa.concat_arrays(chosen) if chosen else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(u) for u in unit), ids, pa.array(totals, pa.int64())], [*unit, "region_ids", "total_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{u} {kinds[u]}" for u in unit) + ", region_ids array<string>, total_tokens bigint"
    return held.mapInArrow(run, schema)


def token_matched_draws(df: DataFrame, unit: Sequence[str], target: str, trials: int, salt: int = 0) -> DataFrame:
    """Per unit the random set of regions (region_id, tokens) nearest in tokens to ``target`` (a column constant in the unit).

    The best of ``trials`` seeded prefixes that reach the target (or hold all there is); an
    exact hit ends the search. unit, region_ids, total_tokens.
    """

    def sizes(run: np.ndarray, goal: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum((run < goal).sum(axis=1), run.shape[1] - 1)
        return k + 1, np.abs(run[np.arange(len(run)), k] - goal)

    return _draws(df, unit, [target], trials, salt, sizes, 0)


def hash_text(text: str) -> int:
    import hashlib

    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def phased_sample(df: DataFrame, group: str, n_first: int, later: Column, n: int, key: str, salt: str) -> DataFrame:
    """n rows in three phases: one of each group, then any up to ``n_first``, then those for which ``later`` is false first.

    Every phase is in hash order. Each is a distributed top-n: of the rows after the
    leaders, only ``n`` of either kind of ``later`` can be taken. Adds place from 1.
    """
    w = Window.partitionBy(group).orderBy(hash_order(F.col(key), F.lit(salt)), key)
    rows = df.withColumns({"__h": hash_order(F.col(key), F.lit(salt)), "__lead": F.row_number().over(w) == 1, "__later": later})
    order = [F.desc("__lead"), "__h", key]
    kinds = [rows.where(F.col("__later") == k).orderBy(*order).limit(n_first + n) for k in (False, True)]
    few = kinds[0].unionAll(kinds[1])
    ranked = few.withColumn("__i", F.row_number().over(Window.orderBy(*order)))
    last = F.col("__i") > n_first
    turn = [last, F.when(last, F.col("__later")).otherwise(False), "__i"]
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*turn))).where(F.col("place") <= n).drop("__h", "__lead", "__later", "__i")


def random_regions(df: DataFrame, unit: Sequence[str], k: int, item: str, order: Sequence[str], salt: str) -> DataFrame:
    """k items of every unit without replacement, with their place (from 1) in the unit's own order."""
    few = hashed_sample_per_group(df, unit, F.lit(k), item, salt).drop("place")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))


def length_matched_draws(df: DataFrame, unit: Sequence[str], count: str, target: str, tolerance: float = 0.25, trials: int = 256, salt: int = 0) -> DataFrame:
    """Per unit a random set of ``count`` regions whose tokens are nearest to ``target`` (both columns constant in the unit).

    The best of ``trials`` seeded draws by relative distance; one within ``tolerance`` ends
    the search. unit, region_ids, total_tokens.
    """

    def sizes(run: np.ndarray, k: int, goal: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(int(k), run.shape[1])
        return np.full(len(run), k), np.abs(run[:, k - 1] - goal) / max(1, goal)

    return _draws(df, unit, [count, target], trials, salt, sizes, tolerance)


def bucket_examples(df: DataFrame, size: str, limits: dict[str, int], rest: str, n: int, key: str = "commit_id") -> DataFrame:
    """The first n keys of every size class; ``limits`` are the upper ends of the classes in order, ``rest`` the class beyond."""
    bucket = F.lit(rest)
    for name, most in reversed(list(limits.items())):
        bucket = F.when(F.col(size) <= most, name).otherwise(bucket)
    rows = df.withColumn("bucket", bucket)
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).where(F.col("__i") <= n).drop("__i")


def manifest(cohort: DataFrame, key: str = "commit_id") -> DataFrame:
    """n, n_projects and the SHA-256 of the sorted keys, one a line. For cohorts, whose keys one row can hold."""
    held = F.array_join(F.array_sort(F.collect_list(key)), "\n")
    return cohort.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("project").alias("n_projects"), F.sha2(held, 256).alias("manifest"))


def test_cohorts(commits: DataFrame, labels: DataFrame) -> DataFrame:
    """commit_id and its cohorts: localizable, rankable, complete, clean; and conflicting, which belongs to none.

    labels: commit_id, p, q, u: its positive, negative and other lines; commits without lines have none.
    """
    rows = commits.join(labels, "commit_id", "left")
    positive, p = F.col("is_positive"), F.col("p") > 0
    flags = {
        "localizable": positive & p, "rankable": positive & p & (F.col("q") > 0), "complete": positive & p & (F.col("u") == 0),
        "clean": ~positive & (F.coalesce("p", F.lit(0)) == 0), "conflicting": ~positive & p,
    }
    return rows.select("commit_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
