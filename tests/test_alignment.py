from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparline.functions.lines import text_variants
from sparline.operators.alignment import align, consume_once, settle


def side(spark, rows):
    return spark.createDataFrame([(u, i, t, "clash") for u, i, t in rows], "commit_id string, place bigint, text string, state string")


def run(spark, left, right, **more):
    return {(r["commit_id"], r["place"]): (r["right_place"], r["state"]) for r in align(side(spark, left), side(spark, right), ["commit_id"], **more).collect()}


def test_passes(spark):
    left = [("c", i, t) for i, t in enumerate(["foo ( x )", "dup", "dup", "bar", "lost", "tie", None])]
    right = [("c", i, t) for i, t in enumerate(["foo(x)", "dup", "dup", "tie", "bar", "tie", None])]
    got = run(spark, left, right)
    assert [got["c", i] for i in range(7)] == [(0, "UNIQUE"), (1, "ORDERED"), (2, "ORDERED"), (4, "UNIQUE"), (None, "MISSING"), (3, "PREFIX"), (None, "MISSING")]
    got = run(spark, left, right, prefix=False)
    assert got["c", 5] == (5, "WINDOW")


def test_a_row_may_take_the_last_free_line(spark):
    # The second row shares both lines at first, but one is taken before its turn.
    got = run(spark, [("c", 0, "f(x)"), ("c", 1, "f ( x )")], [("c", 0, "f(x)"), ("d", 0, "f(x)")])
    assert got == {("c", 0): (0, "UNIQUE"), ("c", 1): (None, "MISSING")}
    assert run(spark, [], [("c", 0, "x")]) == {} and run(spark, [("c", 0, "x")], []) == {("c", 0): (None, "MISSING")}


def brute(rows, lines, prefix):
    """Pass by pass over all pairs of one unit."""
    meets = lambda a, b: bool(set(a) & set(b))
    got, used = {}, set()
    for i, r in enumerate(rows):
        free = [g for g, x in enumerate(lines) if g not in used and meets(r, x)]
        if len(free) < 2:
            got[i] = (free[0], "UNIQUE") if free else (None, "MISSING")
            used |= set(free)
    order = [i for i in range(len(rows)) if i not in got]
    for i in order:
        if i in got and not prefix:
            continue
        group = [j for j in order if j not in got and meets(rows[i], rows[j])]
        free = [g for g, x in enumerate(lines) if g not in used and any(meets(rows[j], x) for j in (group if prefix else [i]))]
        if group and (len(free) == len(group) or (prefix and len(free) > len(group))):
            for j, g in zip(group, free):
                got[j] = (g, "ORDERED" if len(free) == len(group) else "PREFIX")
                used.add(g)
        elif not prefix:
            got[i] = (None, "AMBIGUOUS")
    for i in order:
        if i in got and got[i][1] != "AMBIGUOUS":
            continue
        before = [got[j][0] for j in range(i) if j in got and got[j][0] is not None]
        after = [got[j][0] for j in range(i + 1, len(rows)) if j in got and got[j][0] is not None]
        low, high = (before[-1] if before else -1), (after[0] if after else len(lines))
        free = [g for g in range(low + 1, high) if g not in used and meets(rows[i], lines[g])]
        got[i] = (free[0], "WINDOW") if len(free) == 1 else (None, "AMBIGUOUS")
        used |= set(free) if len(free) == 1 else set()
    return got


@pytest.mark.parametrize("prefix", [True, False])
def test_against_brute_force(spark, prefix):
    rng = random.Random(9)
    pool = ["f(x)", "f ( x )", "_f(x)", "}", "} ", "a_b", "a b", 'x = "y";', 'x = " y ";', "return 1;", "return  1 ;", "g()", "g( )"]
    left, right = [], []
    for u in range(40):
        left += [(f"c{u}", i, rng.choice(pool)) for i in range(rng.randrange(12))]
        right += [(f"c{u}", i, rng.choice(pool)) for i in range(rng.randrange(14))]
    forms = {r["text"]: tuple(r["f"]) for r in side(spark, left + right).select("text", text_variants(F.col("text")).alias("f")).distinct().collect()}
    got = run(spark, left, right, prefix=prefix)
    for u in {x[0] for x in left}:
        want = brute([forms[t] for v, _, t in left if v == u], [forms[t] for v, _, t in right if v == u], prefix)
        assert {i: got[u, i] for i in want} == want


def test_many_equal_rows_are_settled_in_one_go():
    n = 20_000
    found = settle([("}",)] * n, [("}",)] * (n - 1), True)
    assert {s for _, s in found} == {"AMBIGUOUS"}
    assert settle([("}",)] * n, [("}",)] * n, True)[-1] == (n - 1, "ORDERED")


def test_lines_are_consumed_once_and_lower_ranks_first(spark):
    left = [("c", i, t) for i, t in enumerate(["f(x)", "f ( x )", "g", "g", "h", None])]
    right = [("c", i, t) for i, t in enumerate(["f(x)", "g", "g", "h", "h"])]
    got = {r["place"]: (r["right_place"], r["state"]) for r in consume_once(side(spark, left), side(spark, right), ["commit_id"]).collect()}
    assert got == {0: (0, "UNIQUE"), 1: (None, "MISSING"), 2: (None, "AMBIGUOUS"), 3: (None, "AMBIGUOUS"), 4: (None, "AMBIGUOUS"), 5: (None, "MISSING")}
    ranked = {r["place"]: (r["right_place"], r["state"]) for r in consume_once(side(spark, left), side(spark, right), ["commit_id"], rank=F.when(F.col("place") < 2, 0).otherwise(1)).collect()}
    assert ranked[2] == (1, "UNIQUE") and ranked[3] == (2, "UNIQUE") and ranked[4] == (None, "AMBIGUOUS")
