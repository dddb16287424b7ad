"""Parquet table sources. Loaders tolerate absent optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the base tables with their Spark types.
SCHEMAS = {
    "episodes": "pid string, title string, subtitle string, broadcast_date string, duration_seconds bigint, parent_pid string, previous_pid string, next_pid string, raw_json string, fetched_at string, segments_raw_json string, segments_fetched_at string",
    "tracks": "id bigint, episode_pid string, position bigint, time_str string, composer string, composer_line string, contributors_json string, title string, performers string",
    "segment_events": "id bigint, event_pid string, episode_pid string, position bigint, version_offset bigint, track_title string, composer_name string, composer_pid string, composer_mbid string, duration_seconds bigint, recording_pid string, record_id string, record_label string, contributions_json string",
    "works": "slug string, composer_slug string, composer_key string, work_key string, work_display string, composer_display string, catalogue string, airings bigint, n_recordings bigint, n_text_only bigint, first_aired string, last_aired string, facets_json string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a data folder; optional columns that the file lacks come out as typed nulls."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return conform(df, table) if table in SCHEMAS else df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast known columns to the declared types and add the missing ones as nulls; extra columns stay."""
    have = dict(df.dtypes)
    changes = {}
    for part in SCHEMAS[table].split(", "):
        name, kind = part.split(" ")
        if name not in have:
            changes[name] = F.lit(None).cast(kind)
        elif have[name] != kind:
            changes[name] = F.col(name).cast(kind)
    return df.withColumns(changes) if changes else df
