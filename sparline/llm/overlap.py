"""Records of the evaluation splits that stand, the same or almost, in the training split.

Near-same is a threshold on the Jaccard similarity of word sets. For sets a and b it
implies one on the cosine of their unit vectors, |a & b| / sqrt(|a| |b|) >= 2 t / (1 + t),
so pairs come from a cosine join: every vector posts only the terms, rarest first, before
which the rest of its norm can still reach the threshold; postings of the two sides meet
in the inverted list of a term, under bounds from the largest weight and the residual
norms; the dot products of the pairs that are left are exact, and so is the final test.
Records with the same set form a class and are joined once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparline.session import cut

#: Terms whose frequency is known when terms are put in order, about 8 MB; all others are rarer than these.
KNOWN_TERMS = 500_000
#: Fixed value: an odd number that tells the salted lists of a term apart.
SALT_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Postings of one side in an inverted list that a single task joins; longer lists are cut on that side.
LIST_ROWS = 2_000
#: Rows of one record that a single task gathers; a record with more is reduced in parts of so many first.
RECORD_ROWS = 1_000
#: Keys that are broadcast, about 20 MB; with more, the join goes by shuffle.
BROADCAST_KEYS = 300_000


def word_hashes(text: Column) -> Column:
    """Distinct words ``[a-z0-9_]+`` of the lower-cased text as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def term_sets(rows: DataFrame, record: str, terms: str) -> DataFrame:
    """One sorted array of distinct terms per record from many rows with arrays of terms.

    Records with very many rows are reduced in parts before their distinct terms come together.
    """
    size = F.count(F.lit(1))
    many = cut(rows.groupBy(record).agg(F.ceil(size / RECORD_ROWS).alias("__parts")).where("__parts > 1"))
    n_many = many.count()
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(terms)))).alias(terms)
    if not n_many:
        return rows.groupBy(record).agg(union)
    # The semi and anti joins sink below the projection that makes the terms, so each row is hashed once.
    names = _small(many.select(record), n_many)
    few = rows.join(names, record, "left_anti")
    hot = rows.join(names, record, "left_semi").join(_small(many, n_many), record)
    hot = hot.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")))  # the same on every run of a task
    parts = hot.groupBy(record, "__part").agg(union).select(record, F.explode(terms).alias("__t")).distinct()
    return few.groupBy(record).agg(union).unionAll(parts.groupBy(record).agg(F.array_sort(F.collect_list("__t")).alias(terms)))


@dataclass
class Terms:
    """Frequencies of the frequent terms and, of terms with long lists, the parts of either side; all sorted by term."""

    known: np.ndarray
    counts: np.ndarray
    long: np.ndarray
    train_parts: np.ndarray
    eval_parts: np.ndarray


def _look_up(names: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(names):
        return np.full(len(wanted), default, np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, values[at], default)


def _postings(b: pa.RecordBatch, terms: Terms, threshold: float) -> tuple[np.ndarray, ...]:
    """term, its frequency, class, set size and place of what the sets of a batch post, rarest terms first."""
    column = b.column("terms")
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy()
    owner = np.repeat(np.arange(len(size)), size)
    freq = _look_up(terms.known, terms.counts, flat, 0)
    order = np.lexsort((flat, freq, owner))
    flat, freq, n = flat[order], freq[order], size[owner]
    place = np.arange(len(flat)) - (np.cumsum(size) - size)[owner]
    posted = np.flatnonzero(np.sqrt((n - place) / n) >= threshold)
    return flat[posted], freq[posted], b.column("class_id").to_numpy()[owner[posted]], n[posted], place[posted]


def _long_lists(terms: Terms, threshold: float):
    """The terms of lists that may be long: one row per posting, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, freq, *_ = _postings(b, terms, threshold)
            term, n = np.unique(term[freq > LIST_ROWS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return run


def _poster(terms: Terms, threshold: float, train: bool):
    """Postings of one side. A long list is a grid of parts of both sides: a posting stands in its part, once for each part of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, _, class_id, n, place = _postings(b, terms, threshold)
            t_parts, e_parts = (_look_up(terms.long, x, term, 1) for x in (terms.train_parts, terms.eval_parts))
            own, copies = (t_parts, e_parts) if train else (e_parts, t_parts)
            part = (class_id.view(np.uint64) % own.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(term)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            cell = part[at] * e_parts[at] + other if train else other * e_parts[at] + part[at]
            list_ = term[at].view(np.uint64) ^ (cell.astype(np.uint64) * SALT_STEP)
            columns = [list_.view(np.int64), class_id[at], n[at].astype(np.int32), place[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["list", "class_id", "n", "place"])

    return run


def _sorted(table: pa.Table, name: str, *values: str) -> list[np.ndarray]:
    order = np.argsort(table[name].to_numpy())
    return [table[c].to_numpy()[order] for c in (name, *values)]


def cosine_candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (train_class, eval_class) of classes on the two sides that may reach the cosine ``threshold``.

    classes: class_id bigint, terms array<bigint> (distinct), has_train, has_eval. No pair
    that reaches the threshold is missing; pairs of a class with itself are left out.
    """
    occurrences = classes.select(F.explode("terms").alias("term")).groupBy("term").count()
    total = classes.agg(F.sum(F.size("terms"))).first()[0] or 0
    least = max(1, total // KNOWN_TERMS)  # so that at most KNOWN_TERMS terms are more frequent
    none = np.zeros(0, np.int64)
    terms = Terms(*_sorted(occurrences.where(F.col("count") > least).toArrow(), "term", "count"), none, none, none)
    sides = [classes.where(has).select("class_id", "terms") for has in ("has_train", "has_eval")]
    if len(terms.counts) and terms.counts.max() > LIST_ROWS:  # only known terms can have long lists
        held = [s.mapInArrow(_long_lists(terms, threshold), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")) for s in sides]
        t, e = (h.select("term", F.ceil(F.col("n") / LIST_ROWS).alias(p)) for h, p in zip(held, ("t", "e")))
        long = t.join(e, "term").where("t > 1 OR e > 1").toArrow()
        terms.long, terms.train_parts, terms.eval_parts = _sorted(long, "term", "t", "e")
    schema = "list bigint, class_id bigint, n int, place int"

    def side(train: bool, prefix: str) -> DataFrame:
        posted = sides[not train].mapInArrow(_poster(terms, threshold, train), schema)
        return posted.select("list", *(F.col(c).alias(f"{prefix}_{c}") for c in ("class_id", "n", "place")))

    lists = side(True, "t").join(side(False, "e"), "list")
    t, e = F.col("t_n").cast("double"), F.col("e_n").cast("double")
    weights = 1 / F.sqrt(t * e)  # of a shared term in both vectors
    # Largest weight of one vector times the sum of the other's: before any shared term, and for the rest after this one.
    largest = F.least(t, e) * weights
    t_rest, e_rest = t - F.col("t_place") - 1, e - F.col("e_place") - 1
    residual = weights + F.sqrt(t_rest / t) * F.sqrt(e_rest / e)
    remaining = weights * (1 + F.least(t_rest, e_rest))
    kept = lists.where(
        (F.col("t_class_id") != F.col("e_class_id")) & (largest >= threshold) & (residual >= threshold) & (remaining >= threshold)
    )
    return kept.select(F.col("t_class_id").alias("train_class"), F.col("e_class_id").alias("eval_class")).distinct()


def near_classes(classes: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (train_class, eval_class) whose term sets have at least this Jaccard similarity, equal classes included."""
    threshold = 2 * jaccard / (1 + jaccard) - 1e-9
    pairs = cut(cosine_candidates(classes, threshold))
    n_pairs = pairs.count()
    sets = classes.select("class_id", "terms")
    t, e = (sets.select(F.col("class_id").alias(c), F.col("terms").alias(n)) for c, n in (("train_class", "__t"), ("eval_class", "__e")))
    # The pairs pick the few sets that are needed before these are brought together.
    both = ["train_class", "eval_class"]
    met = t.join(_small(pairs, n_pairs), "train_class").join(e.join(_small(pairs, n_pairs), "eval_class"), both)
    common = F.size(F.array_intersect("__t", "__e"))
    dot = F.col("__c") / F.sqrt(F.size("__t").cast("double") * F.size("__e"))
    union = F.size("__t") + F.size("__e") - F.col("__c")
    met = met.withColumn("__c", common).where((dot >= threshold) & (F.col("__c") >= F.lit(jaccard - 1e-12) * union))
    same = classes.where("has_train AND has_eval").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"))
    return met.select("train_class", "eval_class").unionAll(same)


def split_overlap(members: DataFrame, rows: DataFrame, jaccard: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near-same records between splits: (records, classes, pairs of classes).

    members: record string, is_train, is_eval boolean, a row per record (other columns are kept); rows: record,
    terms array<bigint>, any number of rows per record. records: record, is_train, is_eval,
    class_id; classes: class_id, terms, has_train, has_eval; pairs: train_class, eval_class,
    those of a class with itself included. Records with no term at all are in no class.
    """
    sets = term_sets(rows.where(F.col("record").isNotNull()), "record", "terms")
    sets = sets.where(F.size("terms") > 0).withColumn("class_id", F.xxhash64("terms"))
    records = cut(sets.join(members.drop("class_id", "terms"), "record"))
    first = F.min("record").alias("record")
    heads = cut(records.groupBy("class_id").agg(first, F.bool_or("is_train").alias("has_train"), F.bool_or("is_eval").alias("has_eval")))
    classes = cut(records.select("class_id", "record", "terms").join(_small(heads, heads.count()), ["class_id", "record"]).drop("record"))
    return records.drop("terms"), classes, cut(near_classes(classes, jaccard))
