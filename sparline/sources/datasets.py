"""Building data sets and reading what other tools left: manifests, caches, predictions, nested labels, archives.

Files on the driver's side are few and small (a config, a zip, a manifest); tables go
through Spark's readers and writers.
"""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparline.sources.records import crc_hex, exists, json_lines, last_wins, write_splits


def label_map(spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], ident: str, order: str) -> DataFrame:
    """Label rows of a JSONL file by their keys: rows without an ``ident`` are left out, of several the last by ``order`` counts."""
    rows = json_lines(spark, path, schema)
    return last_wins(rows.where(F.coalesce(F.col(ident), F.lit("")) != ""), list(keys), order)


def open_test_records(records: DataFrame) -> DataFrame:
    """The test split without a gate, for callers that keep one themselves."""
    return records.where(F.lower("split") == "test")


def with_units(grid: DataFrame, units: DataFrame, curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every job of the grid with its unit and its curve, null where there is none: one scan of either table instead of a read per job."""
    return grid.join(units, list(keys), "left").join(curves, list(keys), "left")


def read_predictions(spark: SparkSession, folder: str, threshold: float | None = None) -> DataFrame:
    """commit_id, label (int), p, seed from CSV files in folders ``seed=N``; with a threshold also the predicted label."""
    rows = spark.read.option("header", True).schema("commit_id string, gold_label string, p_buggy double, predicted_label int").csv(folder)
    out = rows.select("commit_id", F.col("gold_label").cast("double").cast("int").alias("label"), F.col("p_buggy").alias("p"), F.col("seed").cast("int").alias("seed"))
    return out if threshold is None else out.withColumn("predicted", (F.col("p") >= threshold).cast("int"))


def write_predictions(scores: DataFrame, folder: str) -> None:
    """commit_id, gold_label, p_buggy, predicted_label as CSV, a folder per seed."""
    scores.select("commit_id", "gold_label", "p_buggy", "predicted_label", "seed").write.mode("errorifexists").partitionBy("seed").option("header", True).csv(folder)


def nested_labels(spark: SparkSession, path: str) -> DataFrame:
    """project, commit_id, path, ordinal, text, label from JSON of projects, commits and files.

    A commit holds ``added`` (file to texts) and ``added_buggy_level`` (file to
    ``added_buggy``, a bag of texts): of equal texts the first as many as the bag has are 1.
    """
    level = "map<string, struct<added_buggy: array<string>>>"
    schema = f"map<string, map<string, struct<added: map<string, array<string>>, added_buggy_level: {level}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    commits = raw.select(F.explode("j").alias("project", "c")).select("project", F.explode("c").alias("commit_id", "p"))
    files = commits.select("project", "commit_id", F.explode("p.added").alias("path", "texts"), F.col("p.added_buggy_level").alias("bags"))
    bag = F.coalesce(F.try_element_at("bags", "path")["added_buggy"], F.array().cast("array<string>"))
    lines = files.select("project", "commit_id", "path", bag.alias("bag"), F.posexplode("texts").alias("ordinal", "text"), "texts")
    earlier = F.size(F.filter(F.slice("texts", F.lit(1), F.col("ordinal")), lambda t: t == F.col("text")))
    marked = F.size(F.filter("bag", lambda t: t == F.col("text")))
    return lines.select("project", "commit_id", "path", "ordinal", "text", (earlier < marked).cast("double").alias("label"))


def build(records: DataFrame, path: str, checks: Sequence[tuple[str, Column]], form: str = "parquet", ident: str = "commit_id") -> dict[str, object]:
    """Write records by split after they passed their checks, and give a manifest.

    checks: names with aggregates that must be true over all records, tested in one pass.
    The manifest has rows and a digest per split that depends on the records, not on files.
    """
    if checks:
        row = records.agg(*(c.alias(n) for n, c in checks)).first()
        bad = [n for n, _ in checks if not row[n]]
        if bad:
            raise ValueError("the records fail: " + ", ".join(bad))
    write_splits(records, path, form)
    content = F.xxhash64(*sorted(records.columns))
    per = records.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("n_ids"), F.bit_xor(content).alias("content"))
    return {r["split"]: {"n": r["n"], "n_ids": r["n_ids"], "content": f"{r['content'] & (2**64 - 1):016x}"} for r in per.collect()}  # a row per split


def load_or_build(spark: SparkSession, path: str, make: Callable[[], DataFrame], expected: int) -> DataFrame:
    """The table at ``path`` if it has as many rows as expected, else an error; made and written if it isn't there."""
    if not exists(spark, path):
        make().write.parquet(path)
    out = spark.read.parquet(path)
    n = out.count()
    if n != expected:
        raise ValueError(f"{path} has {n} rows instead of {expected}")
    return out


def inventory_lines(members: DataFrame) -> DataFrame:
    """One CSV line per member of an archive: name (quoted, quotes doubled), size, compressed, CRC in 8 hex digits."""
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    return members.select("archive", "name", F.concat_ws(",", quoted, F.col("size").cast("string"), F.col("compressed").cast("string"), crc_hex(F.col("crc"))).alias("line"))


def inventory(members: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums per archive, the largest members, and members and bytes per extension."""
    files = members.where(~F.col("is_dir"))
    sums = members.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_dir")).alias("n_files"), F.sum("size").alias("size"), F.sum("compressed").alias("compressed"))
    extension = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)).alias("extension")
    return sums, files.orderBy(F.desc("size"), "name").limit(top), files.groupBy(extension).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def safe_destination(root: str | Path, name: str) -> Path:
    """Where a member of an archive may be put under ``root``; absolute names, drives and ways out are refused."""
    plain = name.replace("\\", "/")
    if not plain or plain.startswith("/") or (len(plain) > 1 and plain[1] == ":") or ".." in plain.split("/"):
        raise ValueError(f"unsafe name: {name!r}")
    base = Path(root).resolve()
    out = (base / posixpath.normpath(plain)).resolve()
    if base != out and base not in out.parents:
        raise ValueError(f"unsafe name: {name!r}")
    return out


def digests(data: bytes) -> dict[str, object]:
    """size, sha256, sha512 and the name as a blob of some bytes."""
    blob = hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    return {"size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "sha512": hashlib.sha512(data).hexdigest(), "blob_sha1": blob}


def extract(archive: str | Path, root: str | Path, names: Sequence[str]) -> list[dict[str, object]]:
    """Copy named members to ``root``: a row with name and digests for each. A file with other content is not overwritten."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for name in names:
            to, data = safe_destination(root, name), z.read(name)
            if to.exists() and to.read_bytes() != data:
                raise FileExistsError(f"{to} has other content")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(data)
            out.append({"name": name, **digests(data)})
    return out


def manifest_lines(rows: Sequence[dict[str, object]]) -> list[str]:
    """Rows as CSV lines with a header; commas in values become semicolons."""
    fields = list(rows[0]) if rows else []
    return [",".join(fields), *(",".join(str(r[f]).replace(",", ";") for f in fields) for r in rows)]


def verify(path: str | Path, size: int | None = None, sha256: str | None = None, blob_sha1: str | None = None) -> dict[str, object]:
    """The digests of a file and whether each expected one is met."""
    d = digests(Path(path).read_bytes())
    wanted = {"size": size, "sha256": sha256, "blob_sha1": blob_sha1}
    checks = {k: d[k] == v for k, v in wanted.items() if v is not None}
    return {**d, "checks": checks, "ok": all(checks.values())}
