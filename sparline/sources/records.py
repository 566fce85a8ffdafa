"""Sources and sinks: JSON lines, split-guarded scans, CSV summaries, archives, static checks of pickles."""

from __future__ import annotations

import io
import pickletools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSONL file or folder, blank lines skipped; a path that isn't there is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def split_records(records: DataFrame, split: str, *, test_gate: bool = False) -> DataFrame:
    """Records of one split. The test split needs the gate; the filter prunes the partition column of the same name."""
    if split.lower() == "test" and not test_gate:
        raise PermissionError("the test split is closed: pass test_gate=True to read it")
    return records.where(F.lower("split") == split.lower())


def refuse_other_splits(records: DataFrame, allowed: str) -> DataFrame:
    """The records, failing at run time on the first one of another split."""
    bad = F.raise_error(F.concat(F.lit("unexpected split "), F.coalesce("split", F.lit("null"))))
    return records.withColumn("split", F.when(F.lower("split") == allowed, F.col("split")).otherwise(bad.cast("string")))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from arrays of equal length, one per position; unequal lengths are an error."""
    sizes = [F.size(c) for c in columns]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = df.withColumn("__same", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("arrays of unequal length")).cast("boolean")))
    return checked.where("__same").select(F.inline(F.arrays_zip(*columns)))


def write_splits(records: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder per split, so that a scan of one split reads no other."""
    records.write.mode("errorifexists").partitionBy("split").format(form).save(path)


def predictions(scores: DataFrame, threshold: float) -> DataFrame:
    """commit_id, gold_label, p_buggy, predicted_label as they go to CSV."""
    return scores.select("commit_id", F.col("y").cast("int").alias("gold_label"), F.col("score").alias("p_buggy"), (F.col("score") >= threshold).cast("int").alias("predicted_label"))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A small summary as a single CSV file with a header; meant for results, not for tables."""
    df.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def crc_hex(crc: Column) -> Column:
    return F.lpad(F.lower(F.hex(crc)), 8, "0")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The directory of every zip archive that matches ``path``: archive, name, is_dir, size, compressed, method, crc."""

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(source, m.filename, m.is_dir(), m.file_size, m.compress_size, m.compress_type, m.CRC) for m in z.infolist()]
            yield pd.DataFrame(rows, columns=["archive", "name", "is_dir", "size", "compressed", "method", "crc"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(listing, "archive string, name string, is_dir boolean, size bigint, compressed bigint, method int, crc bigint")


def path_faults(members: DataFrame) -> DataFrame:
    """Per member what is unsafe about its name: absolute, drive, traversal, duplicate, case collision."""
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    per = members.groupBy("archive", F.lower("name").alias("__l")).agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("name").alias("__d"))
    rows = members.withColumn("__l", F.lower("name")).join(per, ["archive", "__l"])
    flags = [
        ("absolute", name.startswith("/")), ("drive", name.rlike(r"^[A-Za-z]:")), ("traversal", name.rlike(r"(^|/)\.\.(/|$)")),
        ("duplicate", F.col("__n") > F.col("__d")), ("case_collision", F.col("__d") > 1),
    ]
    return rows.select("archive", "name", F.array_compact(F.array(*(F.when(c, n) for n, c in flags))).alias("faults"))


def archive_summary(members: DataFrame) -> DataFrame:
    files = F.count_if(~F.col("is_dir"))
    return members.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), files.alias("n_files"), F.sum("size").alias("size"), F.sum("compressed").alias("compressed"))


#: Pickle opcodes that can run code when they are loaded.
RISKY_OPCODES = frozenset({"GLOBAL", "STACK_GLOBAL", "REDUCE", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX", "BUILD", "EXT1", "EXT2", "EXT4"})


def pickle_opcodes(data: bytes) -> dict[str, int]:
    """Opcodes of a pickle and how often they occur, without loading it."""
    out: dict[str, int] = {}
    for op, _, _ in pickletools.genops(data):
        out[op.name] = out.get(op.name, 0) + 1
    return out


def pickle_audit(spark: SparkSession, path: str) -> DataFrame:
    """path, opcode, n and whether the opcode may run code, for every pickle that matches ``path``."""

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, op, n, op in RISKY_OPCODES) for p, c in zip(pdf["path"], pdf["content"]) for op, n in pickle_opcodes(c).items()]
            yield pd.DataFrame(rows, columns=["path", "opcode", "n", "risky"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(audit, "path string, opcode string, n bigint, risky boolean")
