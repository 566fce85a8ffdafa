"""Oversized commits cut into pieces at natural boundaries, with overlap.

The lines of a commit stand in the order of their files, hunks and places. A cut between
files is the best, then between hunks, then between lines; a line is cut only if it is
longer than a piece. Dynamic programming over the boundaries finds the cuts with the
least sum of penalties and size imbalance. It sees lengths only; the texts stay where
they are until each hunk knows the pieces that it lies in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.text import TOKEN_PATTERN, commit_key, token_count
from sparline.session import cut, shuffle_width

#: The cost of a cut by where it stands.
PENALTY = {"file": 0.0, "hunk": 1.0, "line": 3.0, "inside": 100.0}
#: The weight of a piece's squared relative distance from the even size.
IMBALANCE = 4.0
#: One task cuts so many pieces, eight million tokens of a commit: beyond, a commit is cut in stretches, each optimal in itself.
STRETCH_PIECES = 4096
#: Ordinals of hunks or files whose sizes one task sums up.
ORDINALS = 10_000
#: So many oversized commits at most are broadcast, about 10 MB; beyond, they are joined by shuffle.
BROADCAST_COMMITS = 100_000

_TOKEN = re.compile(TOKEN_PATTERN)
KINDS = tuple(PENALTY)


def choose_cuts(ends: np.ndarray, kinds: np.ndarray, first_room: int, room: int) -> list[int]:
    """Indices of the boundaries that end a piece, the last boundary included.

    ends: token positions of the boundaries, ascending; kinds: their index in ``KINDS``.
    The first piece may hold first_room tokens, the others ``room``. Between two
    boundaries must not lie more than ``room``. Of equal costs the earlier cut wins.
    """
    total = int(ends[-1])
    even = total / max(1, -(-max(0, total - first_room) // room) + 1)
    penalty = np.array([PENALTY[k] for k in KINDS])[kinds]
    penalty[-1] = 0.0
    start = np.concatenate([[0], ends])
    lows = np.searchsorted(start, start - room).tolist()
    at = start * (np.sqrt(IMBALANCE) / even)  # so that a piece costs its length here, less that of an even one, squared
    one = float(np.sqrt(IMBALANCE))
    cost = np.full(len(start), np.inf)
    cost[0] = 0.0
    came = [0] * len(start)
    whole_to = int(np.searchsorted(start, first_room, side="right"))
    for j in range(1, len(start)):
        low, here = lows[j], at[j] - one
        best, value = -1, np.inf
        if low < j:
            c = here - at[low:j]
            c *= c
            c += cost[low:j]
            best = int(c.argmin())
            value = c[best]
        if j < whole_to and here * here <= value:
            value, best = here * here, -low
        came[j] = low + best
        cost[j] = value + penalty[j - 1]
    cuts, j = [], len(start) - 1
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


def boundaries(lengths: np.ndarray, line_kinds: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Token positions where a cut may stand and their kinds: line ends and, in a line longer than ``room``, every token."""
    to = np.cumsum(lengths)
    full = lengths > 0
    if not full.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A line without tokens stays with the line before it and may pass on the better kind.
    group = np.cumsum(full) - 1
    behind = np.full(int(group[-1]) + 1, len(KINDS))
    np.minimum.at(behind, group[group >= 0], line_kinds[group >= 0])
    ends, kinds = to[full], behind
    long = np.flatnonzero(lengths[full] > room)
    if len(long):
        inside = np.concatenate([np.arange(ends[i] - lengths[full][i] + 1, ends[i]) for i in long])
        kinds = np.concatenate([kinds, np.full(len(inside), KINDS.index("inside"))])
        ends = np.concatenate([ends, inside])
        order = np.argsort(ends, kind="stable")
        ends, kinds = ends[order], kinds[order]
    return ends.astype(np.int64), kinds


def _slice(lines: Sequence[str], counts: np.ndarray, begin: int, end: int) -> str:
    """The text of the tokens from ``begin`` to ``end``, lines joined by line feeds; lines without tokens follow the token before them."""
    to = np.cumsum(counts)
    if begin <= 0 and end >= to[-1]:
        return "\n".join(lines)
    end = min(end, int(to[-1]))
    a = 0 if begin <= 0 else int(np.searchsorted(to, begin, side="right"))
    b = int(np.searchsorted(to, end, side="left"))
    last = b
    while last + 1 < len(lines) and to[last + 1] == end:
        last += 1
    out = list(lines[a : last + 1])
    if to[b] > end:
        spans = [m.span() for m in _TOKEN.finditer(lines[b])]
        out[b - a] = lines[b][: spans[end - int(to[b] - counts[b]) - 1][1]]
    first = begin - int(to[a] - counts[a])
    if first > 0:
        spans = [m.span() for m in _TOKEN.finditer(lines[a])]
        out[0] = out[0][spans[first][0] :]
    return "\n".join(out)


def _cutter(max_tokens: int, overlap: int):
    room = max_tokens - overlap

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__from")
        origin = int(pdf["__from"].iloc[0])
        lengths = np.concatenate(pdf["__counts"].to_numpy()).astype(np.int64)
        last = np.cumsum(pdf["__counts"].map(len).to_numpy()) - 1
        kinds = np.full(len(lengths), KINDS.index("line"))
        kinds[last] = np.where(pdf["__ends_file"], KINDS.index("file"), KINDS.index("hunk"))
        ends, at_kinds = boundaries(lengths, kinds, room)
        cuts = choose_cuts(ends, at_kinds, max_tokens if origin == 0 else room, room)
        to = origin + ends[cuts]
        begin = np.concatenate([[origin], to[:-1]])
        return pd.DataFrame({
            "commit_id": key[0], "__part": key[1], "__k": np.arange(len(cuts)), "token_from": begin - np.minimum(overlap, begin), "token_to": to,
            "overlap_tokens": np.minimum(overlap, begin).astype(np.int32), "cut_at": [KINDS[k] for k in at_kinds[cuts]],
        })

    return run


_PIECE = ["piece_no", "token_from", "token_to", "overlap_tokens", "cut_at"]


def _slicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of hunks, cut into what each of their pieces has of them."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("commit_id", *_PIECE, "__at", "__text")}
        columns = (b.column(c).to_pylist() for c in ("commit_id", "__from", "__texts", "__counts", "__pieces"))
        for commit, at, texts, counts, pieces in zip(*columns):
            sizes = np.array(counts, np.int64)
            for p in pieces:
                begin = max(p["token_from"] - at, 0)
                for c in _PIECE:
                    out[c].append(p[c])
                out["commit_id"].append(commit)
                out["__at"].append(at + begin)
                out["__text"].append(_slice(texts, sizes, begin, p["token_to"] - at))
        kinds = {"piece_no": pa.int64(), "overlap_tokens": pa.int32(), "token_from": pa.int64(), "token_to": pa.int64(), "__at": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], list(out))


def _before(df: DataFrame, by: Sequence[str], order: Sequence[str], ordinal: str, size: str) -> DataFrame:
    """Adds ``__before``, the sum of ``size`` over what stands before a row: summed per ``ORDINALS`` ordinals first."""
    group = df.withColumn("__group", F.floor(F.col(ordinal) / ORDINALS))
    sums = group.groupBy(*by, "__group").agg(F.sum(size).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__group", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by, "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = group.withColumn("__in", F.coalesce(F.sum(size).over(within), F.lit(0))).join(sums, [*by, "__group"])
    return placed.withColumn("__before", F.col("__base") + F.col("__in")).drop("__group", "__in", "__base")


def commit_pieces(hunks: DataFrame, max_tokens: int, overlap: int, stretch_pieces: int = STRETCH_PIECES) -> DataFrame:
    """Pieces of every commit of more than ``max_tokens`` tokens.

    hunks has commit_id, canonical_path, file_ordinal, hunk_ordinal, lines and extracted_at.
    A hunk (commit, path, ordinal) that was delivered several times counts once, as
    delivered first. Returns commit_id, piece_no (from 0), token_from and token_to (the
    token range in the commit, overlap included), n_tokens, overlap_tokens (tokens shared
    with the piece before), cut_at (what the piece's end divides: file, hunk, line or
    inside, a line) and text. Every piece but the first begins exactly ``overlap`` tokens
    before the end of its predecessor (with all there is, if that is less).

    Null ids, lines and texts have no tokens; commits within the limit give no rows, as
    does an empty table; hunks without a token are in no piece. A commit may be as large as
    it likes: one of more than ``stretch_pieces`` pieces is cut in stretches of so many,
    which begin with a hunk, each optimal in itself.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap must be less than the size of a piece")
    named = hunks.where(F.col("commit_id").isNotNull()).select(
        commit_key(F.col("commit_id")).alias("commit_id"), F.coalesce("canonical_path", F.lit("")).alias("__path"),
        F.coalesce("file_ordinal", F.lit(0)).alias("file_ordinal"), F.coalesce("hunk_ordinal", F.lit(0)).alias("hunk_ordinal"),
        "extracted_at", F.transform("lines", lambda x: F.coalesce(x["raw_text"], F.lit(""))).alias("__texts"),
    )
    hunk = ["commit_id", "__path", "hunk_ordinal"]
    size = token_count(F.array_join("__texts", "\n"))
    sizes = named.groupBy(*hunk).agg(F.min_by(size, F.struct("extracted_at", size)).alias("__n"))
    large = cut(sizes.groupBy("commit_id").agg(F.sum("__n").alias("__total")).where(F.col("__total") > max_tokens).select("commit_id"))

    rows = named.join(F.broadcast(large) if large.count() <= BROADCAST_COMMITS else large, "commit_id")
    first = Window.partitionBy(*hunk).orderBy("extracted_at", size, F.xxhash64("__texts"))
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "extracted_at")
    rows = rows.withColumn("__counts", F.transform("__texts", token_count)).withColumn("__n", F.aggregate("__counts", F.lit(0), lambda a, b: a + b))
    rows = cut(rows.where("__n > 0"))

    # Token offsets: of files within the commit, then of hunks within the file. No text takes part.
    narrow = rows.select(*hunk, "file_ordinal", "__counts", "__n")
    file = ["commit_id", "__path"]
    files = narrow.groupBy(*file).agg(F.min("file_ordinal").alias("__file"), F.sum("__n").alias("__size"))
    files = _before(files, ["commit_id"], ["__file", "__path"], "__file", "__size").withColumnRenamed("__before", "__file_from")
    placed = _before(narrow, file, ["hunk_ordinal"], "hunk_ordinal", "__n").join(files, file)
    placed = cut(placed.select(
        *hunk, "__counts", "__n", (F.col("__file_from") + F.col("__before")).alias("__from"), (F.col("__before") + F.col("__n") == F.col("__size")).alias("__ends_file")
    ))

    part = F.floor(F.col("__from") / (stretch_pieces * max_tokens)).alias("__part")
    schema = "commit_id string, __part bigint, __k bigint, token_from bigint, token_to bigint, overlap_tokens int, cut_at string"
    # Much work on little data: a set number of tasks, which the adaptive planner leaves alone.
    work = placed.select("commit_id", part, "__from", "__counts", "__ends_file").repartition(shuffle_width(hunks.sparkSession), "commit_id", "__part")
    cuts = cut(work.groupBy("commit_id", "__part").applyInPandas(_cutter(max_tokens, overlap), schema))
    earlier = Window.partitionBy("commit_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cuts.groupBy("commit_id", "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select("commit_id", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    pieces = cuts.join(parts, ["commit_id", "__part"]).withColumn("piece_no", F.col("__base") + F.col("__k")).select("commit_id", *_PIECE)

    # Hunks and pieces meet in cells of max_tokens tokens, once: in the first cell that both have.
    cells = lambda a, b: F.sequence(F.floor(a / max_tokens), F.floor((b - 1) / max_tokens))
    at_hunk = placed.select(*hunk, "__from", (F.col("__from") + F.col("__n")).alias("__to")).withColumn("__cell", F.explode(cells(F.col("__from"), F.col("__to"))))
    at_piece = pieces.withColumn("__cell", F.explode(cells(F.col("token_from"), F.col("token_to"))))
    met = at_hunk.join(at_piece, ["commit_id", "__cell"]).where((F.col("__from") < F.col("token_to")) & (F.col("token_from") < F.col("__to")))
    met = met.where(F.col("__cell") == F.floor(F.greatest("__from", "token_from") / max_tokens))
    of_hunk = met.groupBy(*hunk, "__from").agg(F.collect_list(F.struct(*_PIECE)).alias("__pieces"))

    fragment = "commit_id string, piece_no bigint, token_from bigint, token_to bigint, overlap_tokens int, cut_at string, __at bigint, __text string"
    texts = rows.select(*hunk, "__texts", "__counts").join(of_hunk, hunk).select("commit_id", "__from", "__texts", "__counts", "__pieces")
    fragments = texts.mapInArrow(_slicer, fragment).groupBy("commit_id", *_PIECE).agg(F.array_sort(F.collect_list(F.struct("__at", "__text"))).alias("__all"))
    text = F.array_join(F.transform("__all", lambda x: x["__text"]), "\n").alias("text")
    n_tokens = (F.col("token_to") - F.col("token_from")).cast("int").alias("n_tokens")
    return fragments.select("commit_id", "piece_no", "token_from", "token_to", n_tokens, "overlap_tokens", "cut_at", text)
