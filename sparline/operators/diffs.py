"""Unified diffs as rows, and the identities of their lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.lines import is_code_file, is_comment_or_blank, normalize_line

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse_diff(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Lines of the hunks of unified diffs inside texts.

    ident, ordinal (line of the text, from 0), path, hunk (from 0 within the text),
    change_type (added, deleted, context), old_lineno, new_lineno, raw_text. File and hunk
    headers carry forward by windows over the lines of one text, which one row held before.
    A text without a hunk gives no rows. Text after the last hunk that begins with a blank,
    + or - is read as its lines only as far as the header's lengths go.
    """
    lines = df.select(ident, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x85]")).alias("ordinal", "__l"))
    line = F.col("__l")
    w = Window.partitionBy(ident).orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    new_path = F.regexp_extract("__l", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    old_path = F.regexp_extract("__l", r"^--- (?:a/)?([^\t]+)", 1)
    header = line.rlike(_HUNK)
    is_new = line.startswith("+++ ") & F.lag("__l").over(w).startswith("--- ")
    is_old = line.startswith("--- ") & F.lead("__l").over(w).startswith("+++ ")
    rows = lines.withColumns({
        "__new": F.when(is_new, new_path), "__old": F.when(is_old, old_path), "__h": header, "__file": is_new | is_old,
        **{f"__{n}": F.when(header, F.coalesce(F.nullif(F.regexp_extract("__l", _HUNK, i), F.lit("")).cast("int"), F.lit(1))) for n, i in (("os", 1), ("on", 2), ("ns", 3), ("nn", 4))},
    })
    rows = rows.withColumns({
        "hunk": F.sum(F.col("__h").cast("int")).over(upto) - 1, "__p": F.last("__new", True).over(upto), "__q": F.last("__old", True).over(upto),
        **{f"__c{n}": F.last(f"__{n}", True).over(upto) for n in ("os", "on", "ns", "nn")},
    }).where("hunk >= 0")
    inside = Window.partitionBy(ident, "hunk").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    body = ~F.col("__h") & ~F.col("__file")
    plus, minus, same = body & line.startswith("+"), body & line.startswith("-"), body & line.startswith(" ")
    count = lambda c: F.sum(c.cast("int")).over(inside)
    rows = rows.withColumns({"__o": count(minus | same), "__n": count(plus | same), "__other": count(body & ~plus & ~minus & ~same), "__plus": plus, "__minus": minus, "__same": same})
    fits = (F.col("__o") <= F.col("__con")) & (F.col("__n") <= F.col("__cnn")) & (F.col("__other") == 0)
    rows = rows.where((F.col("__plus") | F.col("__minus") | F.col("__same")) & fits)
    return rows.select(
        ident, "ordinal", F.when(F.col("__p") == "/dev/null", F.col("__q")).otherwise(F.col("__p")).alias("path"), "hunk",
        F.when(F.col("__plus"), "added").when(F.col("__minus"), "deleted").otherwise("context").alias("change_type"),
        F.when(~F.col("__plus"), F.col("__cos") + F.col("__o") - 1).alias("old_lineno"), F.when(~F.col("__minus"), F.col("__cns") + F.col("__n") - 1).alias("new_lineno"),
        F.substring("__l", 2, 1 << 30).alias("raw_text"),
    )


def hunk_headers(df: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, hunk, old_start, old_length, new_start, new_length of every hunk header."""
    found = F.regexp_extract_all(F.regexp_replace(F.col(text), r"\r", ""), F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), 0)
    rows = df.select(ident, F.posexplode(found).alias("hunk", "__h"))
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract("__h", _HUNK, i), F.lit("")).cast("int"), F.lit(1))
    return rows.select(ident, "hunk", *(part(i).alias(n) for i, n in enumerate(("old_start", "old_length", "new_start", "new_length"), 1)))


def occurrences(df: DataFrame, unit: Sequence[str], order: str = "ordinal") -> DataFrame:
    """Adds norm_text, occurrence_index (of a normal form in a unit and kind of change) and ordered_position, both from 0."""
    rows = df.withColumn("norm_text", normalize_line(F.col("raw_text")))
    each = Window.partitionBy(*unit, "change_type", "norm_text").orderBy(order)
    return rows.withColumns({"occurrence_index": F.row_number().over(each) - 1, "ordered_position": F.row_number().over(Window.partitionBy(*unit).orderBy(order)) - 1})


def code_lines(df: DataFrame, unit: Sequence[str], order: str = "ordinal") -> DataFrame:
    """Changed lines of code files without comments and blanks, counted after the filter."""
    kept = df.where(is_code_file(F.col("path")) & ~is_comment_or_blank(F.col("raw_text")) & (normalize_line(F.col("raw_text")) != "") & (F.col("change_type") != "context"))
    return occurrences(kept, unit, order)


def added_code(diffs: DataFrame, ident: str, text: str, suffix: str = ".java") -> DataFrame:
    """The added lines of code files in the diffs of a text column, as ``parse_diff`` gives them."""
    return parse_diff(diffs, ident, text).where((F.col("change_type") == "added") & F.col("path").endswith(suffix))
