"""Scalar functions over lines of code: normal forms, predicates, signatures.

All take and give string columns; null gives null. ``(?U)`` makes Java's classes Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def space_punctuation(text: Column) -> Column:
    """Blanks around every character that is neither a word character nor white space."""
    return collapse(F.regexp_replace(text, r"(?U)([^\w\s])", r" $1 "))


def normalize_line(text: Column) -> Column:
    """Spaced punctuation, no single underscore before an identifier, tight double-quoted literals."""
    spaced = space_punctuation(text)
    bare = F.regexp_replace(spaced, r"(?<![^ ])_(?=\p{L})", "")
    return F.regexp_replace(bare, r'"\s+([^"]*?)\s+"', r'"$1"')


def split_underscores(text: Column) -> Column:
    return space_punctuation(F.replace(text, F.lit("_"), F.lit(" ")))


def mask_literals(code: Column) -> Column:
    """Brackets and separators as blanks, quoted strings as ``<STR>``, digits as ``<NUM>``; quotes match greedily."""
    out = F.replace(F.translate(code, "(){}[].:;,", " " * 10), F.lit(" _ "), F.lit("_"))
    for quoted in ("``.*``", "'.*'", '".*"'):
        out = F.regexp_replace(out, quoted, "<STR>")
    return collapse(F.regexp_replace(out, r"(?U)\d+", "<NUM>"))


def text_variants(text: Column) -> Column:
    """Distinct normal forms under which two lines may be the same."""
    n, p = normalize_line(text), space_punctuation(text)
    return F.array_distinct(F.array(text, p, split_underscores(text), collapse(text), n, space_punctuation(n), normalize_line(p)))


def signatures(text: Column) -> Column:
    """The wider set of forms, with literals masked."""
    n, p, c = normalize_line(text), space_punctuation(text), collapse(text)
    return F.array_distinct(F.array(text, c, p, split_underscores(text), n, mask_literals(text), mask_literals(p), mask_literals(c), space_punctuation(n)))


def masked_equal(raw: Column, changed: Column) -> Column:
    return (mask_literals(raw) == changed) | (mask_literals(space_punctuation(raw)) == changed)


def is_code_file(path: Column, suffix: str = ".java") -> Column:
    return F.coalesce((path != "") & path.endswith(suffix), F.lit(False))


def is_comment_or_blank(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return (t == "") | t.startswith("//") | t.startswith("/*") | t.startswith("*") | t.endswith("*/")


def markers_in(text: Column, markers: list[str]) -> Column:
    """The markers that occur in the text."""
    return F.filter(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(text, m))


def path_class(a: Column, b: Column) -> Column:
    """EXACT, NORMALIZED (same without ./ and with / for \\), SUFFIX (one ends in the other at a slash), else null."""
    clean = lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    x, y = clean(a), clean(b)
    suffix = F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))
    return F.when(a == b, "EXACT").when(x == y, "NORMALIZED").when(suffix, "SUFFIX")


def parent_hashes(text: Column) -> Column:
    """Hashes from a list with commas, or else white space, between; null and ``nan`` are none."""
    t = F.trim(text)
    parts = F.when(F.contains(t, F.lit(",")), F.split(t, ",")).otherwise(F.split(t, r"\s+"))
    named = F.filter(F.transform(parts, F.trim), lambda p: p != "")
    return F.when(t.isNull() | (F.lower(t) == "nan"), F.array().cast("array<string>")).otherwise(named)


def enhanced_variants(text: Column) -> Column:
    """The forms of ``text_variants`` and those of a normalized line, each once."""
    n, p = normalize_line(text), space_punctuation(text)
    return F.array_distinct(F.concat(text_variants(text), F.array(n, space_punctuation(n), normalize_line(p))))


def line_variants(text: Column) -> Column:
    """The four plain forms: as it is, spaced, spaced with underscores as blanks, collapsed."""
    return F.array_distinct(F.array(text, space_punctuation(text), split_underscores(text), collapse(text)))


def added_texts(blocks: Column) -> Column:
    """The texts of the kind ``added`` from an array that alternates kinds and texts."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(blocks) - 1, F.lit(2)), lambda i: F.struct(F.element_at(blocks, i).alias("k"), F.element_at(blocks, i + 1).alias("t")))
    return F.when(F.size(blocks) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.filter(pairs, lambda p: p["k"] == "added"), lambda p: p["t"]))


def file_category(path: Column) -> Column:
    """The category of a file; no rule is known, so all are UNKNOWN."""
    return F.when(path.isNotNull(), "UNKNOWN").otherwise("UNKNOWN")
