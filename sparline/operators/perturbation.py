"""Removing, blanking and ablating parts of nested commit records, and what that does to a score.

A record is a message and ``files`` as ``structure.nested_records`` makes them: an array of
(file_ordinal, path, hunks), hunks of (hunk_ordinal, lines), lines with line_id and raw_text.
All changes are column expressions on the nested arrays; nothing is exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("MESSAGE", "FILE_PATH", "FILE", "HUNK", "LINE")


def _lines(files: Column, change: Callable[[Column], Column]) -> Column:
    """``files`` with ``change`` applied to the lines of every hunk."""
    hunk = lambda h: h.withField("lines", change(h["lines"]))
    return F.transform(files, lambda f: f.withField("hunks", F.transform(f["hunks"], hunk)))


def cleaned(files: Column) -> Column:
    """Without hunks that have no lines and files that have no hunks."""
    kept = F.transform(files, lambda f: f.withField("hunks", F.filter(f["hunks"], lambda h: F.size(h["lines"]) > 0)))
    return F.filter(kept, lambda f: F.size(f["hunks"]) > 0)


def without_lines(files: Column, ids: Column) -> Column:
    """Lines with a listed id removed, with the hunks and files that this empties. Lines without an id stay."""
    return cleaned(_lines(files, lambda ls: F.filter(ls, lambda x: x["line_id"].isNull() | ~F.array_contains(ids, x["line_id"]))))


def blanked(files: Column, ids: Column | None = None) -> Column:
    """Texts of the lines with a listed id, or of all lines, empty; the structure stays."""
    hit = lambda x: F.lit(True) if ids is None else F.coalesce(F.array_contains(ids, x["line_id"]), F.lit(False))
    return _lines(files, lambda ls: F.transform(ls, lambda x: x.withField("raw_text", F.when(hit(x), F.lit("")).otherwise(x["raw_text"]))))


def without_region(message: Column, files: Column, unit: Column, ids: Column) -> tuple[Column, Column]:
    """(message, files) without a region: ``unit`` is one of ``UNITS``, ``ids`` an array of what it names.

    MESSAGE empties the message; FILE_PATH the paths listed (all if none is); FILE drops the
    files of these paths; HUNK the hunks named ``path#ordinal``; LINE the lines with these
    ids. Empty hunks and files go as well. Units of tokens need a token map: an error.
    """
    text = F.when(unit == "MESSAGE", F.lit("")).otherwise(message)
    bare = F.transform(files, lambda f: f.withField("path", F.when((F.size(ids) == 0) | F.array_contains(ids, f["path"]), F.lit("")).otherwise(f["path"])))
    no_file = F.filter(files, lambda f: ~F.array_contains(ids, f["path"]))
    name = lambda f, h: F.concat(f["path"], F.lit("#"), h["hunk_ordinal"].cast("string"))
    no_hunk = F.transform(files, lambda f: f.withField("hunks", F.filter(f["hunks"], lambda h: ~F.array_contains(ids, name(f, h)))))
    out = F.when(unit == "FILE_PATH", bare).when(unit == "FILE", no_file).when(unit == "HUNK", cleaned(no_hunk)).when(unit == "LINE", without_lines(files, ids))
    known = unit.isin(*UNITS)
    failed = F.raise_error(F.concat(F.lit("no such unit: "), F.coalesce(unit, F.lit("null"))))
    return F.when(known, text).otherwise(failed.cast("string")), cleaned(out.when(unit == "MESSAGE", files))


def ablated(message: Column, files: Column, category: str) -> tuple[Column, Column, Column]:
    """(message, files, whether the markup is to be blanked) without COMMIT_MESSAGE, FILE_PATH or STRUCTURAL_MARKUP."""
    if category == "COMMIT_MESSAGE":
        return F.lit(""), files, F.lit(False)
    if category == "FILE_PATH":
        return message, F.transform(files, lambda f: f.withField("path", F.lit(""))), F.lit(False)
    if category == "STRUCTURAL_MARKUP":
        return message, files, F.lit(True)
    raise ValueError(category)


def additive_score(message: Column, files: Column, effects: Column, message_effect: Column) -> Column:
    """The sum of the effects (a map by line id) of the lines that are there, and of the message if there is one."""
    ids = F.flatten(F.flatten(F.transform(files, lambda f: F.transform(f["hunks"], lambda h: F.transform(h["lines"], lambda x: x["line_id"])))))
    total = F.aggregate(ids, F.lit(0.0), lambda s, i: s + F.coalesce(F.try_element_at(effects, F.coalesce(i, F.lit(""))), F.lit(0.0)))
    return total + F.when(message != "", message_effect).otherwise(0.0)


Scorer = Callable[[Column, Column], Column]


def occlude(records: DataFrame, regions: Column, score: Scorer, keep: Sequence[str] = ("commit_id",)) -> DataFrame:
    """For every region of every record: s_full, s_without and delta = s_full - s_without.

    records: ``keep``, message, files; regions: an array of (unit, ids). ``score`` is an
    expression of message and files, which may call an Arrow UDF; the whole record is
    scored once, each region after it was really removed.
    """
    rows = records.withColumn("s_full", score(F.col("message"), F.col("files"))).select("*", F.explode(regions).alias("__region"))
    message, files = without_region(F.col("message"), F.col("files"), F.col("__region.unit"), F.col("__region.ids"))
    rows = rows.select(*keep, F.col("__region.unit").alias("unit"), F.col("__region.ids").alias("ids"), "s_full", message.alias("message"), files.alias("files"))
    rows = rows.withColumn("s_without", score(F.col("message"), F.col("files")))
    return rows.select(*keep, "unit", "ids", "s_full", "s_without", (F.col("s_full") - F.col("s_without")).alias("delta"))


def region(unit: str, *ids: Column) -> Column:
    """(unit, ids) as ``occlude`` takes them: of a line, a hunk, a file or the message."""
    return F.struct(F.lit(unit).alias("unit"), (F.array(*ids) if ids else F.array().cast("array<string>")).alias("ids"))


def parts_of(files: Column) -> Column:
    """The regions of a record: its message, files and hunks."""
    each_file = F.transform(files, lambda f: region("FILE", f["path"]))
    hunk = lambda f: F.transform(f["hunks"], lambda h: region("HUNK", F.concat(f["path"], F.lit("#"), h["hunk_ordinal"].cast("string"))))
    return reduce(lambda a, b: F.concat(a, b), [F.array(region("MESSAGE")), each_file, F.flatten(F.transform(files, hunk))])


def occlude_sums(hunks: DataFrame, messages: DataFrame) -> DataFrame:
    """``occlude`` by ``parts_of`` for sums of effects: commit_id, unit, id, s_full, s_without and delta.

    hunks: commit_id, path, hunk_ordinal, effect (the sum over its lines); messages:
    commit_id, effect. What is left without a region is what stands before it and what
    stands after it: sums run from both ends score every rest in one pass over the hunks,
    where ``occlude`` goes through all lines of a commit for each of its regions.
    """
    name = F.concat("path", F.lit("#"), F.col("hunk_ordinal").cast("string"))
    cells = [F.struct(F.lit(u).alias("unit"), i.alias("id")) for u, i in (("MESSAGE", F.lit("")), ("FILE", F.col("path")), ("HUNK", name))]
    parts = hunks.select("commit_id", "effect", F.inline(F.array(*cells))).groupBy("commit_id", "unit", "id").agg(F.sum("effect").alias("effect"))
    rows = parts.join(messages.select("commit_id", F.col("effect").alias("__message")), "commit_id", "left").withColumn("__message", F.coalesce("__message", F.lit(0.0)))
    part = Window.partitionBy("commit_id", "unit")
    run = lambda order: F.coalesce(F.sum("effect").over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lines = F.sum("effect").over(part)  # the one part of MESSAGE is all lines: what is left without it
    rest = F.when(F.col("unit") == "MESSAGE", lines).otherwise(run(F.asc("id")) + run(F.desc("id")) + F.col("__message"))
    own = F.when(F.col("unit") == "MESSAGE", F.col("__message")).otherwise(F.col("effect"))
    rows = rows.select("commit_id", "unit", "id", (lines + F.col("__message")).alias("s_full"), rest.alias("s_without"), own.alias("__own"))
    exact = F.abs("s_full") < 1e6  # beyond, or if it is no number, a difference of doubles doesn't hold nine digits; of sums it is the region's own
    return rows.withColumn("delta", F.when(exact, F.col("s_full") - F.col("s_without")).otherwise(F.col("__own"))).drop("__own")


def score_batches(df: DataFrame, ident: str, inputs: Sequence[str], scorer: Callable[[pa.RecordBatch], Sequence[tuple[float, float]]]) -> DataFrame:
    """ident, logit_0, logit_1 from a scorer that takes whole Arrow batches: the place for a model, loaded once per task by the caller's closure."""
    kind = dict(df.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(scorer(b.select(list(inputs))))
            yield pa.RecordBatch.from_arrays([b.column(ident), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())], [ident, "logit_0", "logit_1"])

    return df.select(ident, *(c for c in inputs if c != ident)).mapInArrow(run, f"{ident} {kind}, logit_0 double, logit_1 double")
