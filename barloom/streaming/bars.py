"""Bars from a stream of events: tumbling windows with a watermark, and the latest bars of each symbol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream. The pattern matches its one name: a plain path would have to be a folder, and a table may be a file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Left-closed bars of each event type; in update mode, events later than ``late`` behind the newest are left out and closed windows leave the state."""
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
    return bars.agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def run_once(stream: DataFrame, keys: list[str], folder: str | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over what there is now; the last state of each key.

    Each batch writes the rows that it changed as Parquet under the shared folder (``spark.checkpoint.dir``, else the warehouse), where the
    stream's checkpoint lies too: nothing is gathered in the driver, a batch that is run again replaces its own rows, and a
    second run with the same ``folder`` goes on where the first stopped.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/barloom/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")
    return rows.withColumn("__last", last).filter("__last = 1").drop("__last", "batch")
