"""Queries that run as streams over what has landed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.session import ensure_checkpoint_dir
from aubade.streaming import ingest


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if os.path.isfile(path) else "*.parquet").parquet(sf_dir if os.path.isfile(path) else path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, counted as a stream, in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/days-{uuid.uuid4().hex}"
    return ingest.run_to_folder(ingest.windowed(_events(spark, sf_dir), "ts", "event_type"), folder, "complete")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_days": stream_days}
ORACLES: dict[str, str] = {"stream_days": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS started, event_type, count(*) AS n FROM events GROUP BY ALL"}
