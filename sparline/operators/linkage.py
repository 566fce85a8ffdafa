"""Linking label rows to lines of diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.lines import signatures, text_variants
from sparline.session import cut


def null_safe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join in which null keys are equal and, of equal right keys, the last row by ``order`` wins."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    last = last.withColumnsRenamed(names)
    on = None
    for k, n in names.items():
        c = left[k].eqNullSafe(last[n])
        on = c if on is None else on & c
    return left.join(last, on, "left").select(*[left[c] for c in left.columns], *(F.col(f"__v.{v}").alias(v) for v in values))


def unique_fallback(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the right side's value, of keys that a single right row has."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(value).alias(name)).where("__n = 1").drop("__n")
    return left.join(one, list(keys), "left")


def match_by_count(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds n_matches, the match if it is the only one, and state: UNIQUE, MISSING or AMBIGUOUS."""
    per = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"), F.any_value(value).alias("__v"))
    out = left.join(per, list(keys), "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    n = F.col("n_matches")
    state = F.when(n == 1, "UNIQUE").when(n == 0, "MISSING").otherwise("AMBIGUOUS")
    return out.withColumns({"match": F.when(n == 1, F.col("__v")), "state": state}).drop("__v")


def variant_candidates(left: DataFrame, right: DataFrame, unit: Sequence[str], left_id: str, right_id: str, left_text: str, right_text: str, wide: bool = False) -> DataFrame:
    """Pairs of rows of a unit that share a normal form of their texts: an equi-join on the forms, not a nested loop."""
    forms = signatures if wide else text_variants
    a = left.select(*unit, left_id, F.explode(forms(F.col(left_text))).alias("__f"))
    b = right.select(*unit, right_id, F.explode(forms(F.col(right_text))).alias("__f"))
    return a.join(b, [*unit, "__f"]).select(*unit, left_id, right_id).distinct()


def gap_pairs(left: DataFrame, right: DataFrame, anchors: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Pairs the unmatched rows between anchors, where both sides have equally many of them.

    left, right: unit, place (order in its side); anchors: unit, left_place, right_place of
    rows that are matched already and in the same order on both sides. A gap is numbered by
    the anchors before it; rows before the first and after the last anchor form gaps too,
    and without an anchor there is one. unit, left_place, right_place.
    """

    def gaps(side: DataFrame, col: str) -> DataFrame:
        marks = anchors.select(*unit, F.col(col).alias("place"), F.lit(1).alias("__a"))
        free = side.select(*unit, "place").join(marks.select(*unit, "place"), [*unit, "place"], "left_anti").withColumn("__a", F.lit(0))
        w = Window.partitionBy(*unit).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        both = free.unionByName(marks).withColumn("__gap", F.sum("__a").over(w)).where("__a = 0")
        g = Window.partitionBy(*unit, "__gap")
        return both.select(*unit, "__gap", F.col("place").alias(col), F.row_number().over(g.orderBy("place")).alias("__k"), F.count(F.lit(1)).over(g).alias("__n"))

    return gaps(left, "left_place").join(gaps(right, "right_place"), [*unit, "__gap", "__k", "__n"]).select(*unit, "left_place", "right_place")


def merge_sources(df: DataFrame, key: str, claim: str, priority: str, order: str) -> DataFrame:
    """Of several rows per key the first by priority; a claim that is taken by an earlier row by (priority, order) becomes null, state AMBIGUOUS."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(priority, order)).alias("__r")).select(key, "__r.*")
    # Of each claim only the first row is looked for, so rows without one, however many, don't meet.
    owners = first.where(F.col(claim).isNotNull()).groupBy(claim).agg(F.min_by(key, F.struct(priority, order, key)).alias("__owner"))
    mine = F.col("__owner") == F.col(key)
    state = F.when(F.col(claim).isNull(), "UNRESOLVED").when(mine, "RESOLVED").otherwise("AMBIGUOUS")
    return first.join(owners, claim, "left").withColumn("state", state).withColumn(claim, F.when(mine, F.col(claim))).select(*first.columns, "state")


def resolve_paths(left: DataFrame, right: DataFrame, unit: Sequence[str], left_path: str, right_path: str) -> DataFrame:
    """Adds resolved, a path of the unit on the right side, and how: EXACT, NORMALIZED, SUFFIX or MISSING.

    Suffixes are exploded at their slashes and joined by equality, so there is no nested
    loop; of several suffix matches the smallest path wins.
    """
    clean = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")

    def tails(c: Column) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    # Distinct paths are few against the lines that they come from, and are read several times.
    a = cut(left.select(*unit, F.col(left_path).alias("__l")).where(F.col("__l").isNotNull()).distinct().withColumn("__c", clean("__l")))
    b = cut(right.select(*unit, F.col(right_path).alias("__r")).where(F.col("__r").isNotNull()).distinct().withColumn("__d", clean("__r")))
    whole = a.join(b.withColumnRenamed("__d", "__c"), [*unit, "__c"])
    long = a.join(b.withColumn("__c", F.explode(tails(F.col("__d")))), [*unit, "__c"]).select(*unit, "__l", "__r")
    short = a.withColumn("__c", F.explode(tails(F.col("__c")))).join(b.withColumnRenamed("__d", "__c"), [*unit, "__c"]).select(*unit, "__l", "__r")
    grade = F.when(F.col("__l") == F.col("__r"), 0).otherwise(1)
    found = whole.select(*unit, "__l", "__r", grade.alias("__g")).unionAll(long.unionAll(short).withColumn("__g", F.lit(2)))
    best = found.groupBy(*unit, "__l").agg(F.min(F.struct("__g", "__r")).alias("__b"))
    kind = F.when(F.col("__b.__g") == 0, "EXACT").when(F.col("__b.__g") == 1, "NORMALIZED").when(F.col("__b.__g") == 2, "SUFFIX").otherwise("MISSING")
    out = left.join(best.withColumnRenamed("__l", left_path), [*unit, left_path], "left")
    return out.withColumns({"resolved": F.col("__b.__r"), "resolution": kind}).drop("__b")


def label_status(in_universe: Column, label: Column) -> Column:
    """RQ1_POSITIVE, RQ1_NEGATIVE or NOT_IN_RQ1_UNIVERSE; a missing label is never a negative one."""
    known = F.coalesce(in_universe, F.lit(False))
    return F.when(known & (label == 1), "RQ1_POSITIVE").when(known & (label == 0), "RQ1_NEGATIVE").otherwise("NOT_IN_RQ1_UNIVERSE")


def conflict_class(filtered: Column, unfiltered: Column, child: Column, parent: Column) -> Column:
    """Where the text of a label row is to be found: in the diff, in one of the two file versions, in both or nowhere."""
    return (
        F.when(~filtered & unfiltered, "LINE_PRESENT_BUT_FILTERED").when(filtered, "PRESENT_IN_DIFF").when(child & ~parent, "LINE_PRESENT_IN_CHILD_ONLY")
        .when(parent & ~child, "LINE_PRESENT_IN_PARENT_ONLY").when(child & parent, "LINE_PRESENT_BOTH_BLOBS_NOT_IN_DIFF").otherwise("NO_RAW_GIT_TEXT_MATCH")
    )


def final_class(taxonomy: Column, ambiguous: Column, recovered: Column) -> Column:
    """The state in which a row stays: recovered, ambiguous, a conflict of the data set, or unresolved."""
    return (
        F.when(recovered, "RECOVERED").when(ambiguous, "AMBIGUOUS").when(taxonomy.isin("PRESENT_IN_DIFF", "LINE_PRESENT_BUT_FILTERED"), "UNRESOLVED").otherwise("DATASET_CONFLICT")
    )


def chained(left: DataFrame, first: DataFrame, second: DataFrame, key: str, link: str, value: str) -> DataFrame:
    """Adds ``value`` of ``second``, reached through ``link``: the only one of a key in ``first``, and the only value of that link in ``second``."""
    one = first.groupBy(key).agg(F.count_distinct(link).alias("__n"), F.min(link).alias(link)).where("__n = 1").drop("__n")
    two = second.groupBy(link).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")
    return left.join(one, key, "left").join(two, link, "left")


def scoped_candidates(rows: DataFrame, lines: DataFrame, used: DataFrame, unit: Sequence[str], scope: str, text: str, ident: str) -> DataFrame:
    """Adds n_free: unused lines of the same text in the row's ``scope`` (a file) or, if that has none of the unit's lines, in the whole unit."""
    free = lines.join(used.select(ident).distinct(), ident, "left_anti")
    known = lines.select(*unit, scope).distinct().withColumn("__known", F.lit(True))
    inside = free.groupBy(*unit, scope, text).agg(F.count(F.lit(1)).alias("__in"))
    anywhere = free.groupBy(*unit, text).agg(F.count(F.lit(1)).alias("__any"))
    out = rows.join(known, [*unit, scope], "left").join(inside, [*unit, scope, text], "left").join(anywhere, [*unit, text], "left")
    n = F.when(F.col("__known"), F.coalesce("__in", F.lit(0))).otherwise(F.coalesce("__any", F.lit(0)))
    return out.withColumn("n_free", n).drop("__known", "__in", "__any")


def residual_gaps(left: DataFrame, right: DataFrame, anchors: DataFrame, residual: DataFrame, claimed: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``gap_pairs`` of which only rows in ``residual`` (unit, left_place) and lines not in ``claimed`` (unit, right_place) are kept."""
    pairs = gap_pairs(left, right, anchors, unit)
    return pairs.join(residual, [*unit, "left_place"], "left_semi").join(claimed, [*unit, "right_place"], "left_anti")
