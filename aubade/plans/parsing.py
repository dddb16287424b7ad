"""Queries of parsers and title keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.functions.titlekey import shown_title, title_key
from aubade.operators import instants, parse
from aubade.plans.common import air, segments
from aubade.sources.tables import load


def parse_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of every text that holds a playlist."""
    return parse.parsed_tracks(load(spark, sf_dir, "documents"), "doc_id", "text")


def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block playlists by built-in functions."""
    return parse.block_tracks(load(spark, sf_dir, "documents"), "doc_id", "text")


def parse_from_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks rebuilt from segments."""
    return parse.tracks_from_segments(segments(spark, sf_dir), instants.start_instants(load(spark, sf_dir, "episodes")))


def parse_dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of every document by the parser that the date it was fetched calls for."""
    docs = load(spark, sf_dir, "documents")
    return parse.dispatched(docs, "doc_id", "text", F.to_date("fetched_at"), ("1", "2"), "2020-01-01")


def parse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Music rows derived again from the nights' segment texts."""
    return parse.music_segments(load(spark, sf_dir, "episodes")).drop("contributions_json")


def parse_segments_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the stored segments differ from those derived again from the texts (A10)."""
    columns = ["track_title", "composer_name", "version_offset", "recording_pid"]
    best = lambda df: df.where("event_pid is not null").groupBy("event_pid").agg(F.min(F.struct(*columns)).alias("r")).select("event_pid", "r.*")
    return parse.rederived(best(load(spark, sf_dir, "segment_events")), best(parse.music_segments(load(spark, sf_dir, "episodes"))), ["event_pid"], columns)


def parse_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life spans of every distinct composer line, open and approximate ones too."""
    born, died = parse.life_span(F.col("composer_line"))
    return load(spark, sf_dir, "tracks").where("composer_line is not null").select("composer_line").distinct().select("composer_line", born.alias("born"), died.alias("died"))


def shown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title to show for every distinct title."""
    return load(spark, sf_dir, "tracks").where("title is not null").select("title").distinct().withColumn("shown", shown_title("title"))


def parse_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fetched version of each document title."""
    rows = load(spark, sf_dir, "documents").where("title is not null").select("title", "doc_id", "fetched_at")
    return parse.latest(rows.withColumn("at", F.struct("fetched_at", "doc_id")), "title", "at").select("title", "doc_id")


def parse_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tracks by number differ from those rebuilt from segments."""
    old = load(spark, sf_dir, "tracks").groupBy("episode_pid", "position").agg(F.min_by("title", "id").alias("title"))
    new = segments(spark, sf_dir).where("position is not null").groupBy("episode_pid", (F.col("position") - 1).alias("position")).agg(F.min_by("track_title", "id").alias("title"))
    return parse.rederived(old, new, ["episode_pid", "position"], ["title"])


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work keys of every distinct composer and title: computed once a pair, not once an airing."""
    pairs = air(spark, sf_dir).where("title is not null").select("ck", "title").distinct()
    return pairs.withColumn("work_key", title_key("title", "ck"))


_NAMED = (parse_tracks, parse_dispatched, parse_segments, parse_segments_rederived, parse_spans, shown_titles, parse_blocks, parse_from_segments, parse_latest, parse_rederived, title_keys)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}
ORACLES: dict[str, str] = {
    "parse_spans": rf"""SELECT DISTINCT composer_line, try_cast(regexp_extract(composer_line, '{parse.SPAN}', 1) AS INTEGER) AS born, try_cast(regexp_extract(composer_line, '{parse.SPAN}', 2) AS INTEGER) AS died FROM tracks WHERE composer_line IS NOT NULL""",
    "parse_segments": """WITH j AS (SELECT pid, CAST(segments_raw_json AS JSON) AS d FROM episodes WHERE json_valid(segments_raw_json)),
e AS (SELECT pid AS episode_pid, unnest(CASE json_type(d, '$.segment_events') WHEN 'ARRAY' THEN from_json(json_extract(d, '$.segment_events'), '["JSON"]') END) AS e FROM j)
SELECT json_extract_string(e, '$.pid') AS event_pid, episode_pid, try_cast(json_extract_string(e, '$.position') AS BIGINT) AS position, try_cast(json_extract_string(e, '$.version_offset') AS BIGINT) AS version_offset, json_extract_string(e, '$.segment.track_title') AS track_title,
 coalesce(json_extract_string(e, '$.segment.primary_contributor.name'), json_extract_string(e, '$.segment.artist')) AS composer_name, json_extract_string(e, '$.segment.primary_contributor.pid') AS composer_pid, json_extract_string(e, '$.segment.primary_contributor.musicbrainz_gid') AS composer_mbid,
 try_cast(json_extract_string(e, '$.segment.duration') AS BIGINT) AS duration_seconds, json_extract_string(e, '$.segment.pid') AS recording_pid, json_extract_string(e, '$.segment.record_id') AS record_id, json_extract_string(e, '$.segment.record_label') AS record_label
FROM e WHERE json_extract_string(e, '$.segment.type') = 'music'""",
    "parse_latest": "SELECT title, doc_id FROM (SELECT title, doc_id, row_number() OVER (PARTITION BY title ORDER BY fetched_at DESC NULLS LAST, doc_id DESC) AS r FROM documents WHERE title IS NOT NULL) WHERE r = 1",
    "parse_blocks": r"""WITH marked AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, regexp_replace(concat(chr(10), text, chr(10)), '\n(\d{1,2}:\d{2} [AP]M)\n', chr(10) || chr(1) || '\1' || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_key, string_split(t, chr(10) || chr(1)) AS blocks FROM marked),
rows AS (SELECT doc_key, i - 1 AS place, list_filter(list_transform(string_split(blocks[i], chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM (SELECT doc_key, blocks, unnest(range(2, len(blocks) + 1)) AS i FROM cut))
SELECT doc_key, place, l[1] AS time_str, l[2] AS composer_line, l[3] AS title, array_to_string(l[4:], ' | ') AS performers FROM rows WHERE len(l) >= 3""",
    "parse_rederived": """WITH o AS (SELECT episode_pid, position, list(title ORDER BY id)[1] AS title FROM tracks GROUP BY ALL),
s AS (SELECT s.* FROM segment_events s JOIN episodes e ON s.episode_pid = e.pid WHERE s.id = (SELECT min(x.id) FROM segment_events x WHERE x.event_pid = s.event_pid)),
n AS (SELECT episode_pid, position - 1 AS position, list(track_title ORDER BY id)[1] AS title FROM s WHERE position IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN o.episode_pid IS NULL THEN 'added' WHEN n.episode_pid IS NULL THEN 'removed' WHEN o.title IS NOT DISTINCT FROM n.title THEN 'same' ELSE 'changed' END AS status, count(*) AS rows
FROM o FULL JOIN n ON o.episode_pid = n.episode_pid AND o.position = n.position GROUP BY 1""",
}
