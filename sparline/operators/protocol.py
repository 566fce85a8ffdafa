"""Canonical configurations, their hashes, rule checks, and fingerprints of schemas."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Significant digits that a number keeps in canonical form.
DIGITS = 12


def canonical(value: object) -> object:
    """The value with its keys sorted at every level, numbers at 12 significant digits, sets as sorted lists."""
    if isinstance(value, Mapping):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a configuration holds no infinite or undefined numbers")
        return float(f"{value:.{DIGITS}g}")
    return value


def config_hash(config: Mapping) -> str:
    """SHA-256 of the canonical form as compact JSON: the same whatever the order of keys or the last digits of numbers."""
    return hashlib.sha256(json.dumps(canonical(config), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def at_path(config: Mapping, path: str) -> object:
    """The value under ``a.b.c``, None if any step is missing."""
    here: object = config
    for step in path.split("."):
        here = here.get(step) if isinstance(here, Mapping) else None
    return here


def faults(config: Mapping, rules: Mapping[str, Callable[[object], bool]]) -> list[str]:
    """The paths whose values are missing or break their rule, in order."""
    out = []
    for path, rule in rules.items():
        value = at_path(config, path)
        try:
            good = value is not None and rule(value)
        except (TypeError, ValueError):
            good = False
        if not good:
            out.append(path)
    return out


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the names and types of the columns in order."""
    return hashlib.sha256(json.dumps([list(x) for x in df.dtypes], separators=(",", ":")).encode()).hexdigest()


def compare_schemas(a: DataFrame, b: DataFrame) -> str:
    return "IDENTICAL_SCHEMA" if fingerprint(a) == fingerprint(b) else "SCHEMA_DRIFT"


def missing_fields(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """field, n, n_missing for every required field, from one pass; a column that isn't there is missing in all rows."""
    n = F.count(F.lit(1))
    cells = [F.struct(F.lit(c).alias("field"), n.alias("n"), (n - (F.count(c) if c in df.columns else F.lit(0))).alias("n_missing")) for c in required]
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))
