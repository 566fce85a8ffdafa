from __future__ import annotations

import itertools
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparline.functions.text import TOKEN_PATTERN
from sparline.llm.pieces import IMBALANCE, KINDS, PENALTY, choose_cuts, commit_pieces

SCHEMA = "commit_id string, canonical_path string, file_ordinal int, hunk_ordinal int, lines array<struct<raw_text:string,stable_line_id:string>>, extracted_at timestamp, token_from int, text string"
T0 = datetime(2024, 1, 1)


def tokens(text):
    return re.findall(TOKEN_PATTERN, text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 2)), min_size=1, max_size=9))
def test_cuts_are_optimal(steps):
    ends, kinds = np.cumsum([n for n, _ in steps]), np.array([k for _, k in steps])
    first, room = 12, 10

    def cost(cuts):
        total, at, out = int(ends[-1]), 0, 0.0
        even = total / max(1, -(-max(0, total - first) // room) + 1)
        for i, c in enumerate(cuts):
            size = ends[c] - at
            if size > (first if i == 0 else room):
                return np.inf
            out += IMBALANCE * ((size - even) / even) ** 2 + (PENALTY[KINDS[kinds[c]]] if c < len(ends) - 1 else 0)
            at = ends[c]
        return out

    last = len(ends) - 1
    best = min(cost([*c, last]) for k in range(last + 1) for c in itertools.combinations(range(last), k))
    assert cost(choose_cuts(ends, kinds, first, room)) == pytest.approx(best)


def rows(spark, hunks):
    return spark.createDataFrame([(c, p, f, h, [(x, None) for x in ls] if ls is not None else None, t, 1, "clash") for c, p, f, h, ls, t in hunks], SCHEMA)


def check(pieces, text, limit, overlap):
    whole = tokens(text)
    at = 0
    for i, r in enumerate(pieces):
        assert r["piece_no"] == i and r["n_tokens"] == r["token_to"] - r["token_from"] <= limit
        shared = min(overlap, at)
        assert r["overlap_tokens"] == shared and r["token_from"] == at - shared
        assert tokens(r["text"]) == whole[r["token_from"] : r["token_to"]]
        at = r["token_to"]
    assert at == len(whole)


@pytest.mark.parametrize("stretch", [4096, 2, 1])
def test_pieces_cover_overlap_and_stay_within_the_limit(spark, stretch):
    hunks, text = [], []
    for f in range(3):
        for h in range(4):
            ls = [f"int v{f}_{h}_{k} = call({k}, x);" for k in range(1 + (f + h) % 5)]
            if (f, h) == (1, 2):
                ls += ["tok " * 95, "", None]
            hunks.append(("ABC ", f"p{f}", f, h, ls, T0))
            text += [x or "" for x in ls]
    hunks += [("abc", "p0", 0, 0, hunks[0][4], T0 + timedelta(1)), ("small", "p", 0, 0, ["a b c"], T0), (None, "p", 0, 0, ["x " * 99], T0), ("nolines", "p", 0, 0, None, T0)]
    got = commit_pieces(rows(spark, hunks), 40, 6, stretch).orderBy("piece_no").collect()
    assert {r["commit_id"] for r in got} == {"abc"}
    check(got, "\n".join(text), 40, 6)
    if stretch == 4096:
        inside = [r for r in got[:-1] if r["cut_at"] == "inside"]
        assert inside and all(set(tokens(r["text"])[-1:]) == {"tok"} for r in inside)


def test_cuts_of_a_commit_of_many_pieces_are_optimal_over_the_commit(spark):
    lengths = [[1 + (7 * h + k * k) % 11 for k in range(1 + h % 4)] for h in range(230)]
    hunks = [("c", f"p{h // 3:03d}", h // 3, h % 3, ["w " * n for n in ns], T0) for h, ns in enumerate(lengths)]
    got = commit_pieces(rows(spark, hunks), 40, 6).orderBy("piece_no").collect()
    assert len(got) > 64
    check(got, "\n".join(x for h in hunks for x in h[4]), 40, 6)
    ends = np.cumsum([n for ns in lengths for n in ns])
    kinds = np.array([2 if k + 1 < len(ns) else 0 if h % 3 == 2 or h == 229 else 1 for h, ns in enumerate(lengths) for k in range(len(ns))])
    total = int(ends[-1])
    even = total / (-(-(total - 40) // 34) + 1)
    best = {0: 0.0}
    for e, kind in zip(ends, kinds):  # the plain recursion over all earlier boundaries
        best[int(e)] = min((c + IMBALANCE * ((e - b - even) / even) ** 2 for b, c in best.items() if e - b <= (40 if b == 0 else 34)), default=np.inf)
        best[int(e)] += 0 if e == total else PENALTY[KINDS[kind]]
    at, cost = 0, 0.0
    for r in got:
        cost += IMBALANCE * ((r["token_to"] - at - even) / even) ** 2 + (PENALTY[r["cut_at"]] if r["token_to"] < total else 0)
        at = r["token_to"]
    assert cost == pytest.approx(best[total])


def test_lines_without_tokens_stay_with_the_token_before_them(spark):
    got = commit_pieces(rows(spark, [("c", "p", 0, 0, ["a " * 9, "", " ", "b " * 9, "\t"], T0)]), 10, 1).orderBy("piece_no").collect()
    assert [r["text"] for r in got] == ["a " * 9 + "\n\n ", "a \n\n \n" + "b " * 9 + "\n\t"]


def test_offsets_do_not_depend_on_their_groups(spark, monkeypatch):
    from sparline.llm import pieces

    hunks = [("c", f"p{f}", f, h, ["w " * (1 + h % 3)] * 2, T0) for f in range(7) for h in range(9)]
    run = lambda: sorted(map(tuple, commit_pieces(rows(spark, hunks), 30, 5).collect()))
    a = run()
    monkeypatch.setattr(pieces, "ORDINALS", 2)
    monkeypatch.setattr(pieces, "BROADCAST_COMMITS", 0)
    assert run() == a


def test_boundaries_between_files_win(spark):
    hunks = [("c", f"p{f}", f, 0, ["w " * 5] * 6, T0) for f in range(4)]
    got = commit_pieces(rows(spark, hunks), 34, 4).orderBy("piece_no").collect()
    assert [r["cut_at"] for r in got] == ["file"] * 4
    check(got, "\n".join(["w " * 5] * 24), 34, 4)


def test_one_very_long_line_and_an_empty_table(spark):
    got = commit_pieces(rows(spark, [("c", None, None, None, ["x " * 50_000], None)]), 2048, 128).orderBy("piece_no").collect()
    check(got, "x " * 50_000, 2048, 128)
    assert commit_pieces(rows(spark, []), 40, 6).count() == 0
