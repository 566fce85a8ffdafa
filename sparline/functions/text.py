"""Keys in their one form, and the size of a text in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what one token is, wherever a size is given in tokens.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"

#: Fixed value: white space around keys.
WHITE_SPACE = " \t\n\x0b\f\r"


def trimmed(key: Column) -> Column:
    """``key`` without outer white space of any kind."""
    return F.btrim(key, F.lit(WHITE_SPACE))


def commit_key(key: Column) -> Column:
    """Commit ids are compared without outer white space and in lower case."""
    return F.lower(trimmed(key))


def project_key(project: Column) -> Column:
    """Lower case, no outer white space, ``-`` for ``_``; null, empty and ``?`` are no project."""
    name = F.replace(F.lower(trimmed(project)), F.lit("_"), F.lit("-"))
    return F.when(~name.isin("", "?"), name)


def source_key(source: Column) -> Column:
    """Lower case, no outer white space, ``_`` for ``-`` and for blanks inside; empty is none."""
    name = F.regexp_replace(F.lower(trimmed(source)), r"[-\s]", "_")
    return F.when(name != "", name)


def split_key(split: Column) -> Column:
    """``train``, ``valid`` or ``test`` for their spellings and abbreviations, else null."""
    name = F.lower(trimmed(split))
    return (
        F.when(name.isin("train", "training", "tr", "trn"), "train")
        .when(name.isin("valid", "validation", "val", "dev"), "valid")
        .when(name.isin("test", "testing", "tst", "te"), "test")
    )


def token_count(text: Column) -> Column:
    """Number of matches of ``TOKEN_PATTERN`` in ``text``; null has none.

    A run of word characters shrinks to one character and white space vanishes, so the
    length that is left is the count: no list of matches is built for a long text.
    """
    shrunk = F.translate(F.regexp_replace(text, r"[A-Za-z0-9_]+", "a"), " \t\r\n", "")
    return F.coalesce(F.length(shrunk), F.lit(0))
