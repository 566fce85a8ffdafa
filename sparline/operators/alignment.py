"""One-to-one assignment of label rows to lines of a diff by their texts.

Two texts may be the same if they share a normal form. All forms of a text have the same
letters and digits, so rows and lines meet only within (unit, letters and digits): the
greedy passes run per such cell, and only the rows they leave open are looked at by unit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.lines import text_variants
from sparline.session import cut, shuffle_width


def letters(text: Column) -> Column:
    """What all normal forms of a text have in common."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


class _Cell:
    """Classes of rows with equal forms and the free lines that each may take."""

    def __init__(self, rows: Sequence[tuple[str, ...]], lines: Sequence[tuple[str, ...]]):
        names = {forms: i for i, forms in enumerate(dict.fromkeys(rows))}
        self.of = [names[forms] for forms in rows]
        by_form: dict[str, list[int]] = {}
        for g, forms in enumerate(lines):
            for f in forms:
                by_form.setdefault(f, []).append(g)
        self.free = [{g for f in forms for g in by_form.get(f, ())} for forms in names]
        self.takers: list[list[int]] = [[] for _ in lines]
        for c, free in enumerate(self.free):
            for g in free:
                self.takers[g].append(c)
        sharing: dict[str, list[int]] = {}
        for forms, c in names.items():
            for f in forms:
                sharing.setdefault(f, []).append(c)
        self.near = [sorted({d for f in forms for d in sharing[f]}) for forms in names]

    def take(self, g: int) -> None:
        for c in self.takers[g]:
            self.free[c].discard(g)


def settle(rows: Sequence[tuple[str, ...]], lines: Sequence[tuple[str, ...]], prefix: bool) -> list[tuple[int, str]]:
    """(line or -1, state) of every row of a cell, in order.

    First pass: a row with one free line takes it, one without any is MISSING. Second pass:
    the open rows that share a form with a row, if free lines are as many (ORDERED) or, with
    ``prefix``, more (PREFIX), take them in order. Without ``prefix`` only lines of the row's own
    forms count, and a row that is not settled in its turn stays AMBIGUOUS.
    """
    cell = _Cell(rows, lines)
    out: list[tuple[int, str] | None] = [None] * len(rows)
    open_: list[dict[int, None]] = [{} for _ in cell.free]
    for i, c in enumerate(cell.of):
        if len(cell.free[c]) == 1:
            g = next(iter(cell.free[c]))
            cell.take(g)
            out[i] = (g, "UNIQUE")
        elif not cell.free[c]:
            out[i] = (-1, "MISSING")
        else:
            open_[c][i] = None
    tried: dict[int, int] = {}
    changes = 0
    for i, c in enumerate(cell.of):
        if (out[i] is not None and not prefix) or tried.get(c) == changes:
            continue
        group = sorted(j for d in cell.near[c] for j in open_[d])
        free = sorted(set().union(*(cell.free[d] for d in cell.near[c])) if prefix else cell.free[c])
        if group and (len(group) == len(free) or (prefix and len(group) < len(free))):
            state = "ORDERED" if len(group) == len(free) else "PREFIX"
            for j, g in zip(group, free):
                cell.take(g)
                out[j] = (g, state)
                open_[cell.of[j]].pop(j)
            changes += 1
        elif not prefix:
            out[i] = (-1, "AMBIGUOUS")
            open_[c].pop(i, None)
            changes += 1
        else:
            tried[c] = changes
    return [x or (-1, "AMBIGUOUS") for x in out]


Found = list[tuple[int, int | None, str]]

#: Rows to assign that a task takes at a time.
BUCKET_ROWS = 20_000


def _split(pdf: pd.DataFrame, keys: Sequence[str]) -> dict[tuple, list]:
    """Rows of a bucket by their keys, in order of place."""
    out: dict[tuple, list] = {}
    rest = [c for c in pdf.columns if c not in keys]
    rows = pdf.sort_values("place")
    for key, row in zip(zip(*(rows[k] for k in keys)), rows[rest].itertuples(index=False)):
        out.setdefault(key, []).append(row)
    return out


def _in_buckets(a: DataFrame, b: DataFrame, unit: Sequence[str], keys: Sequence[str], solve: Callable[[list, list], Found]) -> DataFrame:
    """``solve`` for the rows and lines of every key. Keys are many and small, so a task takes a bucket of them at a time."""
    buckets = max(shuffle_width(a.sparkSession), a.count() // BUCKET_ROWS + 1)
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket")
    n = len(unit)

    def run(_: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        lines = _split(y, keys)
        rows = [(*key[:n], *found) for key, mine in _split(x, keys).items() for found in solve(mine, lines.get(key, []))]
        columns = list(zip(*rows)) if rows else [()] * (n + 3)
        out = {u: pd.Series(columns[i], dtype=object) for i, u in enumerate(unit)}
        out["place"] = np.array(columns[n], np.int64)
        out["right_place"] = pd.array(columns[n + 1], dtype="Int64")
        out["state"] = pd.Series(columns[n + 2], dtype=object)
        return pd.DataFrame(out)

    kinds = dict(a.dtypes)
    schema = ", ".join(f"{u} {kinds[u]}" for u in unit) + ", place bigint, right_place bigint, state string"
    sides = [df.withColumn("__bucket", at).groupBy("__bucket") for df in (a, b)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, schema)


def _settler(prefix: bool) -> Callable[[list, list], Found]:
    def solve(rows: list, lines: list) -> Found:
        found = settle([tuple(r.forms) for r in rows], [tuple(x.forms) for x in lines], prefix)
        return [(r.place, lines[g].place if g >= 0 else None, s) for r, (g, s) in zip(rows, found)]

    return solve


def _in_windows(rows: list, lines: list) -> Found:
    by_form: dict[str, list[int]] = {}
    for x in lines:
        for f in x.forms:
            by_form.setdefault(f, []).append(x.place)
    used: set[int] = set()
    out: Found = []
    last = (-1, -1)  # row and line of the last assignment here
    for r in rows:
        low = max(last, (r.low_row, r.low))[1]
        inside: set[int] = set()
        for f in r.forms:
            places = by_form.get(f, [])
            for p in places[bisect_right(places, low) :]:
                if r.high >= 0 and p >= r.high or len(inside) > 1:
                    break
                if p not in used:
                    inside.add(p)
        if len(inside) == 1:
            g = inside.pop()
            used.add(g)
            last = (r.place, g)
            out.append((r.place, g, "WINDOW"))
    return out


def align(left: DataFrame, right: DataFrame, unit: Sequence[str], prefix: bool = True, forms: Callable[[Column], Column] = text_variants) -> DataFrame:
    """Rows of ``left`` with the line of ``right`` that each is: unit, place, right_place, state.

    left, right: unit, place (distinct in its unit), text; rows with a null text are MISSING.
    After ``settle`` a row that is still open takes the only free line that shares a form and
    stands between the lines of the nearest assigned rows before and after it (WINDOW), in
    order; others are AMBIGUOUS. States: UNIQUE, ORDERED, PREFIX, WINDOW, AMBIGUOUS, MISSING.
    """
    unit = list(unit)
    # Forms are made after the lines that no row can be have been left out, so they are never shuffled for nothing.
    plain = lambda x: x.select(*unit, F.col("place").cast("bigint").alias("place"), letters(F.col("text")).alias("cell_"), "text")
    formed = lambda x: x.withColumn("forms", F.array_sort(forms(F.col("text")))).drop("text")
    a = plain(left)
    cell = [*unit, "cell_"]
    some = a.where(F.col("cell_").isNotNull())
    b = cut(plain(right).join(some.select(*cell).distinct(), cell, "left_semi"))
    named = formed(some)
    settled = _in_buckets(named, formed(b), unit, cell, _settler(prefix))
    settled = settled.unionByName(a.where(F.col("cell_").isNull()).select(*unit, "place", F.lit(None).cast("bigint").alias("right_place"), F.lit("MISSING").alias("state")))

    settled = cut(settled)
    at = F.when(F.col("right_place").isNotNull(), F.struct("place", "right_place"))
    w = Window.partitionBy(*unit).orderBy("place")
    ends = settled.withColumns({
        "__low": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__high": F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    none = F.lit(-1).cast("bigint")
    open_ = ends.where("state = 'AMBIGUOUS'").join(named, [*unit, "place"])
    open_ = open_.select(
        *cell, "place", "forms", F.coalesce("__low.place", none).alias("low_row"), F.coalesce("__low.right_place", none).alias("low"), F.coalesce("__high.right_place", none).alias("high")
    )
    taken = settled.where(F.col("right_place").isNotNull()).select(*unit, F.col("right_place").alias("place"))
    lines = formed(b.join(open_.select(*cell).distinct(), cell, "left_semi").join(taken, [*unit, "place"], "left_anti"))
    more = _in_buckets(open_.drop("cell_"), lines.drop("cell_"), unit, unit, _in_windows).select(*unit, "place", F.col("right_place").alias("__found"))
    out = settled.join(more, [*unit, "place"], "left")
    found = F.col("__found").isNotNull()
    return out.select(*unit, "place", F.coalesce("right_place", "__found").alias("right_place"), F.when(found, "WINDOW").otherwise(F.col("state")).alias("state"))


def _first_free(rows: list, lines: list) -> Found:
    """Rows in order take the only free line of the lowest rank that has any."""
    by_form: dict[tuple[int, str], dict[int, None]] = {}
    for x in lines:
        for f in x.forms:
            by_form.setdefault((x.rank, f), {})[x.place] = None
    ranks = sorted({x.rank for x in lines})
    of = {x.place: x for x in lines}
    out: Found = []
    for r in rows:
        answer: tuple[int | None, str] = (None, "MISSING")
        for rank in ranks:
            free: set[int] = set()
            for f in r.forms:
                free.update(islice(by_form.get((rank, f), ()), 2))
            if free:
                answer = (free.pop(), "UNIQUE") if len(free) == 1 else (None, "AMBIGUOUS")
                break
        if answer[0] is not None:
            for f in of[answer[0]].forms:
                by_form[(of[answer[0]].rank, f)].pop(answer[0])
        out.append((r.place, *answer))
    return out


def consume_once(left: DataFrame, right: DataFrame, unit: Sequence[str], rank: Column | None = None, forms: Callable[[Column], Column] = text_variants) -> DataFrame:
    """Rows in order, each taking the only free line that shares a form with it: unit, place, right_place, state.

    With ``rank`` (an integer column of ``right``) lines of a lower rank are preferred: those
    of the next one are looked at only if none of this is free. A row with several free
    lines is AMBIGUOUS and takes none, one without any is MISSING.
    """
    unit = list(unit)
    plain = lambda x: x.select(*unit, F.col("place").cast("bigint").alias("place"), letters(F.col("text")).alias("cell_"), "text", "rank")
    formed = lambda x: x.withColumn("forms", F.array_sort(forms(F.col("text")))).drop("text")
    a = plain(left.withColumn("rank", F.lit(0)))
    cell = [*unit, "cell_"]
    some = a.where(F.col("cell_").isNotNull())
    named = formed(some)
    b = formed(plain(right.withColumn("rank", F.lit(0) if rank is None else rank)).join(some.select(*cell).distinct(), cell, "left_semi"))
    found = _in_buckets(named, b, unit, cell, _first_free)
    return found.unionByName(a.where(F.col("cell_").isNull()).select(*unit, "place", F.lit(None).cast("bigint").alias("right_place"), F.lit("MISSING").alias("state")))
