"""Identities, digests and the seeds derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_MODULUS = 2147483647


def _na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))


def stable_line_id(commit: Column, path: Column, change: Column, old: Column, new: Column, occurrence: Column, position: Column) -> Column:
    """``commit|path|change|old..|new..|occ..|ord..``, NA for a missing line number."""
    parts = [commit, path, change, F.concat(F.lit("old"), _na(old)), F.concat(F.lit("new"), _na(new))]
    return F.concat_ws("|", *parts, F.concat(F.lit("occ"), occurrence.cast("string")), F.concat(F.lit("ord"), position.cast("string")))


def hunk_line_id(commit: Column, path: Column, hunk: Column, change: Column, old: Column, new: Column, occurrence: Column) -> Column:
    """The older form, with the hunk and without the position."""
    return F.concat_ws("|", commit, path, hunk.cast("string"), change, _na(old), _na(new), occurrence.cast("string"))


def hunk_id(commit: Column, path: Column, variant: str, ordinal: Column) -> Column:
    return F.concat_ws("|", commit, path, F.lit(variant), F.concat(F.lit("h"), ordinal.cast("string")))


def blob_sha1(data: Column) -> Column:
    """The name a content-addressed store of blobs gives to ``data`` (binary)."""
    head = F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.char(F.lit(0)))
    return F.sha1(F.concat(head.cast("binary"), data))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def seed(*parts: Column, modulus: int | None = SEED_MODULUS) -> Column:
    """The first 8 hex digits of the digest of the parts as a number, below ``modulus`` if given."""
    number = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")
    return number if modulus is None else number % modulus


def hash_order(key: Column, *salt: Column) -> Column:
    """A sort key that puts rows in a random but reproducible order."""
    return digest(*salt, key)


def pseudo_scores(digest_hex: Column, n: int = 5) -> Column:
    """n values in [-0.5, 0.5] from the leading bytes of a digest."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substr(digest_hex, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)


def json_digest(fields: Sequence[tuple[str, Column]]) -> Column:
    """SHA-256 of a compact JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields, key=lambda x: x[0])))), 256)
