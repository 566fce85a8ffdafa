"""Fixed-capacity containers filled with whole items, by exact-complement hashing.

All that matters of an item is its length, of which there are at most ``capacity`` kinds:
the counts per length come to the driver, are turned into container patterns with
multiplicities there, and go back as a table of rank intervals. The items themselves
stay where they are; each finds its container from its rank among items of its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.text import token_count
from sparline.session import cut

#: The largest capacity: the driver plans with bit sets of so many lengths, which it sums up anew for every pattern.
MOST = 1 << 14
#: Items of one length that one task ranks; a length with more is ranked in that many buckets.
RANK_ROWS = 100_000
#: Rank buckets that are broadcast, about 3 MB; beyond, their offsets are joined by shuffle.
BROADCAST_BUCKETS = 100_000


@dataclass
class Pattern:
    """``times`` containers, each with ``lengths[x]`` items of length x."""

    lengths: Counter
    times: int


class _Stock:
    """Counts of unplaced items by length, with bit sets that index single and pair sums."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.bits = sum(1 << x for x, k in counts.items() if k > 0)
        self._pairs: int | None = None

    def take(self, lengths: Counter, times: int) -> None:
        for x, m in lengths.items():
            self.counts[x] -= m * times
            if not self.counts[x]:
                self.bits &= ~(1 << x)
        self._pairs = None

    def enough(self, lengths: Counter) -> int:
        return min(self.counts.get(x, 0) // m for x, m in lengths.items())

    @property
    def pairs(self) -> int:
        if self._pairs is None:
            rest, total = self.bits, 0
            while rest:
                low = rest & -rest
                total |= self.bits * low
                rest ^= low
            self._pairs = total
        return self._pairs

    def _down(self, most: int) -> Iterator[int]:
        rest = self.bits & ((1 << (most + 1)) - 1)
        while rest:
            x = rest.bit_length() - 1
            yield x
            rest ^= 1 << x

    def largest(self, most: int) -> int:
        """The largest available length up to ``most``, 0 if there is none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0

    def complement(self, held: Counter, gap: int) -> Counter | None:
        """``held`` with one, two or three available lengths that fill ``gap`` exactly."""

        def usable(*more: int) -> Counter | None:
            c = held + Counter(more)
            return c if self.enough(c) else None

        if self.bits >> gap & 1 and (c := usable(gap)):
            return c
        if self.pairs >> gap & 1:
            for a in self._down(gap - 1):
                if 2 * a < gap:
                    break
                if self.bits >> (gap - a) & 1 and (c := usable(a, gap - a)):
                    return c
        for a in self._down(gap - 2):
            rest = gap - a
            if 3 * a < gap:
                break
            if self.pairs >> rest & 1:
                for b in self._down(min(rest - 1, a)):
                    if 2 * b < rest:
                        break
                    if self.bits >> (rest - b) & 1 and (c := usable(a, b, rest - b)):
                        return c
        return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every item of the counts, lengths 1 to capacity.

    A pattern begins with the longest item left. Its gap is filled by an exact complement
    of up to three items, found from the index of available lengths and sums; if there is
    none, the best fitting item goes in and the gap that remains is tried again, until it
    is filled or no item left fits. The pattern is used as often as the counts allow, which
    uses up at least one length as far as it goes, so there are not many more patterns
    than lengths, however many items there are.
    """
    stock = _Stock({x: k for x, k in counts.items() if x > 0 and k > 0})
    patterns: list[Pattern] = []
    while length := stock.largest(capacity):
        held, gap = Counter((length,)), capacity - length
        while gap:
            if found := stock.complement(held, gap):
                held, gap = found, 0
                break
            fit = gap
            while (fit := stock.largest(fit)) and not stock.enough(held + Counter((fit,))):
                fit -= 1
            if not fit:
                break
            held[fit] += 1
            gap -= fit
        times = stock.enough(held)
        stock.take(held, times)
        patterns.append(Pattern(held, times))
    return patterns


def _rank_intervals(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first container, items in a container), by length and rank."""
    used: Counter = Counter()
    rows, container = [], 0
    for p in patterns:
        for x, m in p.lengths.items():
            rows.append((x, used[x], container, m))
            used[x] += m * p.times
        container += p.times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _assigner(intervals: np.ndarray):
    starts = (intervals[:, 0] << 42) + intervals[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "__rank"))
            if len(starts):
                at = np.maximum(np.searchsorted(starts, (length << 42) + rank, side="right") - 1, 0)
                row = intervals[at]
                container = np.where(length > 0, row[:, 2] + (rank - row[:, 1]) // row[:, 3], 0)
            else:
                container = np.zeros(len(length), np.int64)
            kept = [b.column(c) for c in ("__id", "piece_no", "token_from", "n_tokens", "n_pieces")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(container)], ["__id", "piece_no", "token_from", "n_tokens", "n_pieces", "container_id"])

    return run


def pack(df: DataFrame, ident: str, text: str, capacity: int) -> DataFrame:
    """Assign every text to a container of ``capacity`` tokens.

    Returns ``ident``, ``piece_no`` (from 0), ``token_from``, ``n_tokens``, ``n_pieces`` and
    ``container_id`` (from 0, without gaps). Only a text of more than ``capacity`` tokens is
    divided, into full containers and a rest. Texts without a token, null ones too, take no
    room and are put into container 0. Repeated rows and null ids are items of their own; an
    empty table gives no rows. Other columns are not read.
    """
    if not 1 <= capacity <= MOST:
        raise ValueError(f"capacity must be from 1 to {MOST}")
    sized = cut(df.select(F.col(ident).alias("__id"), token_count(F.col(text)).alias("__n")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("__n") / capacity)).cast("int")
    pieces = sized.withColumn("n_pieces", n_pieces).select(
        "__id", "__n", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no")
    )
    token_from = F.col("piece_no").cast("bigint") * capacity
    items = pieces.select(
        "__id", "piece_no", token_from.alias("token_from"), F.least(F.lit(capacity), F.col("__n") - token_from).cast("int").alias("n_tokens"), "n_pieces"
    )

    counts = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # capacity + 1 rows at most
    intervals = _rank_intervals(plan_containers(counts, capacity))

    spark = df.sparkSession
    widths = [(x, max(1, -(-k // RANK_ROWS))) for x, k in counts.items()]
    by_length = F.broadcast(spark.createDataFrame(widths, "n_tokens int, __width int"))
    spread = F.pmod(F.xxhash64("__id", "piece_no"), F.col("__width")).cast("int")
    spread_items = items.join(by_length, "n_tokens").withColumn("__bucket", spread).drop("__width")
    offsets = spread_items.groupBy("n_tokens", "__bucket").count()
    before = Window.partitionBy("n_tokens").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("n_tokens", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    n_buckets = sum(w for _, w in widths)
    offsets = F.broadcast(offsets) if n_buckets <= BROADCAST_BUCKETS else offsets
    within = Window.partitionBy("n_tokens", "__bucket").orderBy("__id", "piece_no")
    ranked = spread_items.withColumn("__at", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "__bucket"])
    ranked = ranked.select("__id", "piece_no", "token_from", "n_tokens", "n_pieces", (F.col("__offset") + F.col("__at")).alias("__rank"))
    kind = dict(sized.dtypes)["__id"]
    schema = f"__id {kind}, piece_no int, token_from bigint, n_tokens int, n_pieces int, container_id bigint"
    return ranked.mapInArrow(_assigner(intervals), schema).withColumnRenamed("__id", ident)
