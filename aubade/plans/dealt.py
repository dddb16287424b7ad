"""Queries of the archive's general data-processing problems."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import instants, nested, packed
from aubade.session import ensure_checkpoint_dir
from aubade.sources.tables import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instants of all readable episode starts and clock texts."""
    return instants.found_instants(load(spark, sf_dir, "episodes"), load(spark, sf_dir, "tracks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child links of all nested objects."""
    return nested.found_links(load(spark, sf_dir, "episodes"), load(spark, sf_dir, "segment_events"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per name packed in a performers or composer_line text."""
    return packed.found_items(load(spark, sf_dir, "tracks"))


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables written by tag and read again by their schemas: rows, parents and rows with a payload of each."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/nested-{uuid.uuid4().hex}"
    nested.write_tables(nested.archive_links(load(spark, sf_dir, "episodes"), load(spark, sf_dir, "segment_events")), folder)
    counted = lambda tag: nested.read_table(spark, folder, tag).agg(F.lit(tag).alias("link"), F.count("*").alias("n"), F.countDistinct("parent_key").alias("parents"), F.count(PAYLOAD[tag]).alias("told"))
    return reduce(DataFrame.unionByName, map(counted, nested.PAYLOAD_SCHEMAS))


#: The payload column counted in each table.
PAYLOAD = {"event": "segment", "credit": "role", "row_credit": "role", "version": "duration", "category": "key", "ancestor": "type"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p3_tables": p3_tables, "p7_found": p7_found}
ORACLES: dict[str, str] = {}
