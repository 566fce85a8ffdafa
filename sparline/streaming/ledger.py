"""Job events as a stream: counts per window under a watermark, and the latest state per unit."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparline.operators.runs import latest
from sparline.session import ensure_checkpoint_dir
from sparline.sources.records import exists


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that match ``path``, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum per window and type; rows later than the watermark are dropped by the engine."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    per = timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_states(events: DataFrame, unit: str = "user_id") -> DataFrame:
    """The last event of every unit so far, by time and then id; one bounded state per unit."""
    last = F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id"))
    return events.groupBy(unit).agg(last.alias("__r")).select(unit, "__r.*")


def drain(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation over everything the source has, and return the last row of each key.

    Update mode: a batch gives the rows that it changed, and what lies behind the watermark
    leaves the state. Batches are written under their numbers, so that one that is repeated
    after a failure replaces itself. State and sink lie under the shared checkpoint folder.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    if not exists(spark, f"{base}/out"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", LongType())])).parquet(f"{base}/out")
    return latest(rows, list(keys), ["epoch"]).select(*stream.columns)


def hourly_counts(spark: SparkSession, directory: str) -> DataFrame:
    return drain(windowed_counts(event_stream(spark, f"{directory}/event[s].parquet")), ["start", "event_type"])
