"""References to records that do not exist, or did not when they were made.

Parents and references are partitioned together by ranges of their keys' digests, which
are even whatever the keys look like. In each range the parents become sorted arrays
(key, start of validity, latest end so far) and the references stream past them in Arrow
batches, each probed by binary search. Keys with very many rows are split: their parents
are merged into disjoint intervals first, these are cut into slices, and each slice is
copied only as often as the references that fall into it need tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.session import cut

#: Rows of one key, on either side, that a single task may take.
HOT_ROWS = 200_000
#: Disjoint intervals of a hot key in a slice.
SLICE = 10_000
#: So many hot keys at most are broadcast, about 20 MB; beyond, they are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Hexadecimal digits of the digest that name a range.
RANGE_DIGITS = 4
#: Microseconds within which intervals of a hot key are merged first.
DAY = 86_400_000_000

FOREVER = np.iinfo(np.int64).max


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


class _Range:
    """Parents of one range of keys as sorted arrays."""

    def __init__(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.names, owner = np.unique(keys, return_inverse=True) if len(keys) else (keys, np.zeros(0, np.int64))
        self.times = np.unique(start)
        place = owner * (len(self.times) + 1) + np.searchsorted(self.times, start, side="right")
        order = np.lexsort((end, place))
        self.place, owner, end = place[order], owner[order], end[order]
        # The latest end so far within an owner: a running maximum over (owner, rank of the end) pairs.
        ends = np.unique(end)
        self.owner = owner
        if len(end):
            self.latest = ends[np.maximum.accumulate(owner * len(ends) + np.searchsorted(ends, end)) % len(ends)]
        else:
            self.latest = end

    def missing(self, keys: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """True where no parent of the key is valid at the time; an unknown time finds none."""
        if not len(self.names):
            return np.ones(len(keys), bool)
        owner = np.minimum(np.searchsorted(self.names, keys), len(self.names) - 1)
        place = owner * (len(self.times) + 1) + np.searchsorted(self.times, at, side="right")
        last = np.searchsorted(self.place, place, side="right") - 1
        ok = (self.names[owner] == keys) & known & (last >= 0)
        last = np.maximum(last, 0)
        return ~(ok & (self.owner[last] == owner) & (self.latest[last] > at))


def _digests(column: pa.Array) -> np.ndarray:
    """16 bytes each, as numpy has them: no object per key, and no key is wider than another."""
    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], dtype="S16", count=len(fixed), offset=16 * fixed.offset) if len(fixed) else np.zeros(0, "S16")


def _prober(payload: Sequence[str]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents: list[pa.RecordBatch] = []
        ready: _Range | None = None

        def build() -> _Range:
            if not parents:
                return _Range(np.zeros(0, "S16"), *(np.zeros(0, np.int64) for _ in range(2)))
            t = pa.Table.from_batches(parents).combine_chunks()
            end = t["__end"].fill_null(FOREVER).to_numpy()
            return _Range(np.concatenate([_digests(c) for c in t["__key"].chunks]), t["__at"].to_numpy(), end)

        for batch in batches:
            kinds = batch.column("__kind").to_numpy(zero_copy_only=False)
            cut_at = int(np.searchsorted(kinds, 1))
            if cut_at:
                parents.append(batch.slice(0, cut_at).select(["__key", "__at", "__end"]))
            if cut_at == len(kinds):
                continue
            if ready is None:
                ready, parents = build(), []
            refs = batch.slice(cut_at)
            at = refs.column("__at")
            gone = ready.missing(_digests(refs.column("__key")), at.fill_null(0).to_numpy(), at.is_valid().to_numpy(zero_copy_only=False))
            if gone.any():
                yield refs.filter(pa.array(gone)).select(list(payload))

    return probe


def _islands(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intervals (__at, __end) of each ``by`` merged where they overlap or touch."""
    before = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("__at") <= F.max("__end").over(before), 0).otherwise(1)
    named = rows.withColumn("__opens", opens)
    named = named.withColumn("__island", F.sum("__opens").over(Window.partitionBy(*by).orderBy("__at", "__end").rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*by, "__island").agg(F.min("__at").alias("__at"), F.max("__end").alias("__end")).drop("__island")


def merged_intervals(parents: DataFrame) -> DataFrame:
    """__key, __at, __end (no null): the times at which a key is valid as disjoint intervals.

    Intervals with one start are combined before the shuffle, then those of one day, then
    those of the key, which are few unless the key really goes and comes that often.
    """
    ends = F.max(F.coalesce("__end", F.lit(FOREVER))).alias("__end")
    starts = parents.groupBy("__key", "__at").agg(ends).where("__end > __at")
    days = _islands(starts.withColumn("__day", F.floor(F.col("__at") / DAY)), ["__key", "__day"]).drop("__day")
    return _islands(days, ["__key"])


def _split(refs: DataFrame, held: DataFrame, hot: DataFrame, few: bool, hot_rows: int, slice_: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__cell``: empty, or for hot keys the slice of time and the salt."""
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    intervals = cut(merged_intervals(held.join(small(hot), "__hash", "left_semi")))
    number = F.row_number().over(Window.partitionBy("__key").orderBy("__at")) - 1
    sliced = intervals.withColumn("__slice", F.floor(number / slice_).cast("int"))
    edges = sliced.groupBy("__key", "__slice").agg(F.min("__at").alias("__from")).groupBy("__key").agg(F.sort_array(F.collect_list("__from")).alias("__edges"))

    mine = refs.join(small(hot), "__hash", "left_semi").drop("__hash").join(small(edges), "__key", "left")
    at_slice = F.greatest(F.lit(0), F.size(F.filter(F.coalesce("__edges", F.array().cast("array<bigint>")), lambda e: e <= F.col("__at"))) - 1)
    mine = mine.withColumn("__slice", at_slice).drop("__edges")
    width = F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("__width")
    widths = cut(mine.groupBy("__key", "__slice").agg(width))
    payload = [c for c in mine.columns if c not in ("__key", "__at", "__slice")]
    cell = lambda salt: F.concat_ws(".", F.lit(""), "__slice", salt)
    mine = mine.join(small(widths), ["__key", "__slice"])
    mine = mine.withColumn("__cell", cell(F.pmod(F.xxhash64("__at", *payload), F.col("__width")))).drop("__slice", "__width")
    copies = sliced.join(small(widths), ["__key", "__slice"]).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__width") - 1)))
    copies = copies.withColumn("__cell", cell(F.col("__salt"))).select("__key", "__at", "__end", "__cell")

    rest = [x.join(small(hot), "__hash", "left_anti").drop("__hash").withColumn("__cell", F.lit("")) for x in (refs, held)]
    return rest[0].unionByName(mine), rest[1].unionByName(copies)


def orphans(
    references: DataFrame,
    parents: DataFrame,
    *,
    key: str,
    at: str,
    payload: Sequence[str],
    parent_key: str,
    valid_from: str,
    valid_to: str,
    hot_rows: int = HOT_ROWS,
    slice_: int = SLICE,
) -> DataFrame:
    """References (``payload`` columns) to a key of which no parent is valid at the reference's time.

    A parent is valid at t if ``valid_from`` <= t and ``valid_to`` is null or later than t;
    a null ``valid_from`` is never valid. A reference with a null key or a null time finds
    no parent and comes out: filter such rows before where they are no references. Keys are
    compared exactly, through their 128-bit digests, so bring both sides to one form first.
    Repeated rows count each, parents may repeat and overlap, either side may be empty. A
    key with more than ``hot_rows`` rows on either side goes in several tasks.
    """
    payload = list(payload)
    plain = [f"__p{i}" for i in range(len(payload))]
    refs = references.select(F.col(key).alias("__key"), _micros(F.col(at)).alias("__at"), *(F.col(c).alias(n) for c, n in zip(payload, plain)))
    held = parents.where(F.col(parent_key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(parent_key).alias("__key"), _micros(F.col(valid_from)).alias("__at"), _micros(F.col(valid_to)).alias("__end")
    )
    nowhere = refs.where(F.col("__key").isNull()).select(*plain)
    refs = refs.where(F.col("__key").isNotNull())

    # Counted by hashes, which are short; a key that shares its hash with a hot one is split as well, which does no harm.
    refs, held = (x.withColumn("__hash", F.xxhash64("__key")) for x in (refs, held))
    sizes = refs.select("__hash", F.lit(1).alias("__r")).unionAll(held.select("__hash", F.lit(0).alias("__r"))).groupBy("__hash")
    sizes = sizes.agg(F.sum("__r").alias("__refs"), F.count(F.lit(1)).alias("__both"))
    hot = cut(sizes.where((F.col("__refs") > hot_rows) | (F.col("__both") - F.col("__refs") > hot_rows)).select("__hash"))
    if n_hot := hot.count():
        refs, held = _split(refs, held, hot, n_hot <= BROADCAST_KEYS, hot_rows, slice_)
    else:
        refs, held = (x.drop("__hash").withColumn("__cell", F.lit("")) for x in (refs, held))

    digest = F.md5(F.concat("__key", F.lit("\x00"), "__cell"))  # no cell has a NUL, so the last one tells both apart
    columns = ["__kind", "__at", "__end", *plain]
    types = dict(refs.dtypes)
    old = held.select(digest.alias("__hex"), F.lit(0).cast("tinyint").alias("__kind"), "__at", "__end", *(F.lit(None).cast(types[n]).alias(n) for n in plain))
    new = refs.withColumns({"__hex": digest, "__kind": F.lit(1).cast("tinyint"), "__end": F.lit(None).cast("bigint")}).select("__hex", *columns)
    both = old.unionAll(new).select(F.unhex("__hex").alias("__key"), F.substring("__hex", 1, RANGE_DIGITS).alias("__range"), *columns)
    ranges = both.repartition("__range").sortWithinPartitions("__kind").drop("__range")
    schema = ", ".join(f"{n} {types[n]}" for n in plain)
    found = ranges.mapInArrow(_prober(plain), schema).unionAll(nowhere)
    return found.withColumnsRenamed(dict(zip(plain, payload)))


def orphan_counts(found: DataFrame, references: DataFrame, table: str, at: str) -> DataFrame:
    """Misses per table and month: ``table``, ``month`` (yyyy-MM, null for an unknown time), ``n_orphans``, ``n_references``.

    Months without a miss are rows too, with 0; counts are partial sums, so a month that
    holds most rows is no burden.
    """
    month = F.date_format(at, "yyyy-MM").alias("month")
    per = lambda df, bad: df.select(table, month, F.lit(bad).alias("__bad"), F.lit(1 - bad).alias("__all"))
    both = per(found, 1).unionAll(per(references, 0))
    return both.groupBy(table, "month").agg(
        F.sum("__bad").cast("bigint").alias("n_orphans"), F.sum("__all").cast("bigint").alias("n_references")
    )
