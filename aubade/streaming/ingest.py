"""Streaming counterparts of the batch ingest: settled rows, idempotent upserts, windows, sessions, per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aubade.operators.parse import latest
from aubade.session import ensure_checkpoint_dir


def read_folder(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each event once; re-deliveries within the watermark are dropped (A4, A5)."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def settled(rows: DataFrame, start: str, seconds: str, now: str, wait_s: int = 3600) -> DataFrame:
    """Rows whose end lies at least the waiting time back."""
    return rows.where(F.col(start) + F.make_dt_interval(secs=F.col(seconds) + F.lit(wait_s)) < F.lit(now).cast("timestamp"))


def windowed(rows: DataFrame, at: str, key: str, length: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window and key; sliding windows where ``slide`` is given."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by session and key."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n")


def running_totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, total`` so far after each batch, by state of two numbers a key."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf.v.sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [str(group[0])], "n": [n], "total": [total]})

    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"))
    return plain.groupBy("key").applyInPandasWithState(step, "key string, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def upsert_folder(rows: DataFrame, key: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the last version of each key in a Parquet folder, one new generation a batch; a repeated batch changes nothing.

    Rows without an order value count as the oldest. Of generations only the last two stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [r for r in _generations(spark, target) if r < number]
        known = spark.read.parquet(f"{target}/gen={max(before)}") if before else None
        rows_ = batch if known is None else batch.unionByName(known, allowMissingColumns=True)
        latest(rows_, key, order).write.mode("overwrite").parquet(f"{target}/gen={number}")
        for old in before[:-1]:
            _drop(spark, f"{target}/gen={old}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generations(spark: SparkSession, target: str) -> list[int]:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(path) if x.getPath().getName().startswith("gen=") and files.exists(fs.Path(x.getPath(), "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_to_folder(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed and give what it wrote to a folder; complete results are written by their last batch."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    writer = rows.writeStream.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(f"{path}/rows")
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def run_to_table(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what has landed and give its result table; for results of bounded size."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
