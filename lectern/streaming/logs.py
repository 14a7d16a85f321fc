"""Streaming over logs: counts of readers as lines arrive (an addition; the batch catalog needs none of it)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table (a file or a folder of part files) as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and key; state older than the watermark is dropped in append and update mode, so it stays bounded there."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events once per keys within the watermark: repeated deliveries are dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there now and returns its result: the newest row of each key.

    Update mode hands on changed rows only and drops state behind the watermark. Every
    batch is a folder of its own in the shared folder, so a repeated batch replaces itself
    and nothing is gathered in the driver.
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{where}/rows")
    rest = [c for c in stream.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, *[f"x.{c}" for c in rest])
