"""The N best items of every group, under partition lower bounds.

Pass 1 finds in every input partition the N-th best distinct item of each group that has
N there; the best of these over all partitions bounds the group from below, because N
distinct items at least as good exist. Pass 2 joins the bound, drops all rows under it
where they are read, reduces what is left of a partition to the N best distinct items of
each group (an item among the best of all is among the best wherever its best row is),
and ranks these after one shuffle on the group. So a group sends at most N rows per
chunk of an input partition, however many rows, items or repeats it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparline.session import cut

#: Rows of an input partition that pass 1 takes together.
CHUNK = 200_000
#: Bounds are joined by broadcast, about 30 MB: those of so many groups with the most rows. Other groups go without.
BROADCAST_BOUNDS = 100_000
#: Groups of which pass 1 counts fewer rows get no bound: they have little to drop, and their bounds are many.
LARGE = 1_000


def _codes(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    code = np.zeros(t.num_rows, np.int64)
    for c in columns:
        part = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        _, code = np.unique(code * (len(part.dictionary) + 1) + part.indices.to_numpy(), return_inverse=True)
    return code


def _best_items(code: np.ndarray, item: pa.ChunkedArray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group code and place (from 0) of the best row of every item, by group, ``keys`` (the first decides) and item."""
    words = item.combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    names = pc.rank(words.dictionary, sort_keys="ascending").to_numpy().astype(np.int64)
    rank = names[words.indices.to_numpy()]
    score = keys[:2]
    order = np.lexsort((*keys[2:][::-1], rank, *score[::-1], code))
    _, first = np.unique(code[order] * (len(names) + 1) + rank[order], return_index=True)
    kept = order[np.sort(first)]
    owner = code[kept]
    return kept, owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


def _bounds(t: pa.Table, group: Sequence[str], n: int) -> pa.Table:
    """The row of the n-th best distinct item of each group of t that has so many, with the number of its rows here."""
    code = _codes(t, group)
    size = np.bincount(code)
    large = np.flatnonzero(size[code] >= n)
    m = t.take(pa.array(large)).append_column("__rows", pa.array(size[code[large]], pa.int64()))
    if not len(large):
        return m
    kept, _, place = _best_items(code[large], m["__item"], m["__n1"].to_numpy(), m["__n2"].to_numpy())
    return m.take(pa.array(kept[place == n - 1]))


def _survivors(t: pa.Table, group: Sequence[str], n: int) -> pa.Table:
    """The best row of each of the n best distinct items of every group of t."""
    kept, _, place = _best_items(_codes(t, group), t["__item"], *(t[c].to_numpy() for c in ("__n1", "__n2")), _codes_in_order(t["__id"]))
    return t.take(pa.array(kept[place < n]))


def _codes_in_order(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the values, null first, as Spark orders them."""
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _by_chunk(reduce_: Callable[[pa.Table, Sequence[str], int], pa.Table], group: Sequence[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield from reduce_(pa.Table.from_batches(held), group, n).to_batches()
                held, rows = [], 0
        if rows:
            yield from reduce_(pa.Table.from_batches(held), group, n).to_batches()

    return run


def _same(group: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__b_{g}")) for g in group))


def _most_rows(bounds: DataFrame, most: int) -> DataFrame:
    """The bounds of the groups with the most rows, whole sizes of quarter powers of two, ``most`` bounds at most."""
    least, total = math.inf, 0
    for size, k in sorted(((r["__size"], r["count"]) for r in bounds.groupBy("__size").count().collect()), reverse=True):  # 252 sizes at most
        total += k
        if total > most:
            break
        least = size
    return bounds.where(F.col("__size") >= F.lit(float(least))).drop("__size")


def top_n(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    scores: Sequence[str],
    ident: str,
    n: int,
    broadcast_bounds: int = BROADCAST_BOUNDS,
) -> DataFrame:
    """For every group the n best items by the two ``scores`` descending, then ``item`` ascending (byte order).

    Returns the group columns, ``item``, both scores, ``ident`` and ``place`` (from 1).
    An item that stands in a group several times counts once: with its best scores and
    the smallest ``ident`` that has them. Rows whose first score is null or NaN, or whose
    item is null, are no candidates; a null or NaN second score is the lowest, a null ``ident`` the smallest. Null group
    keys are keys. Groups with fewer items give them all. Other columns are not read.
    """
    first, second = scores
    n1 = -F.col(first).cast("double")
    low = F.col(second).isNull() | F.isnan(second)
    n2 = F.when(low, F.lit(float("inf"))).otherwise(-F.col(second).cast("double"))
    rows = df.where(F.col(first).isNotNull() & ~F.isnan(first) & F.col(item).isNotNull()).select(
        *group, F.col(item).alias("__item"), n1.alias("__n1"), n2.alias("__n2"), F.col(ident).alias("__id")
    )

    narrow = rows.select(*group, "__item", "__n1", "__n2")
    bound = F.min(F.struct("__n1", "__n2", "__item")).alias("__bound")
    local = narrow.mapInArrow(_by_chunk(_bounds, list(group), n), StructType([*narrow.schema.fields, StructField("__rows", LongType())]))
    large = local.groupBy(*group).agg(bound, F.sum("__rows").alias("__rows")).where(F.col("__rows") >= LARGE)
    bounds = _most_rows(cut(large.select(*group, "__bound", F.floor(F.log2("__rows") * 4).alias("__size"))), broadcast_bounds)
    renamed = F.broadcast(bounds.withColumnsRenamed({g: f"__b_{g}" for g in group}))
    here = F.struct("__n1", "__n2", "__item")
    left = rows.join(renamed, _same(group), "left").where(F.col("__bound").isNull() | (here <= F.col("__bound")))
    left = left.select(*group, "__item", "__n1", "__n2", "__id")
    few = left.mapInArrow(_by_chunk(_survivors, list(group), n), left.schema)

    best = few.repartition(*group).groupBy(*group, "__item").agg(F.min(F.struct("__n1", "__n2", "__id")).alias("__best"))
    order = Window.partitionBy(*group).orderBy("__best.__n1", "__best.__n2", "__item")
    ranked = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    back = F.when(F.col("__best.__n2") != float("inf"), -F.col("__best.__n2"))
    return ranked.select(
        *group, F.col("__item").alias(item), (-F.col("__best.__n1")).alias(first), back.alias(second), F.col("__best.__id").alias(ident), "place"
    )
