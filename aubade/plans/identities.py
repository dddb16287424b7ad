"""Queries over the identity layer and its axes, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import identity as N
from aubade.operators import matching as M
from aubade.operators import ranking as R
from aubade.operators import temporal as T
from aubade.plans.common import AIR, SEG, air, nights, segments, sql_canonical, sql_fold
from aubade.plans.matching import match_aligned
from aubade.session import pinned


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All airings behind the whole identity layer: trusted recordings' names, then full keys. There are no alias tables to apply here."""
    segs = segments(spark, sf_dir)
    links = M.projection(match_aligned(spark, sf_dir), segs)
    return pinned(N.identified(N.projected(air(spark, sf_dir), links, N.recording_names(segs))))


def id_airings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every airing."""
    return identified(spark, sf_dir).select("id", "ck", "wk")


def id_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by airings with the title to show."""
    return N.displays(R.rank_works(identified(spark, sf_dir))).select("ck", "wk", "airings", "first_aired", "last_aired", "first_id", "display")


def id_composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred composers with the most works, numbered by works, airings and name."""
    return R.ordered(R.rank_composers(identified(spark, sf_dir)), "works", 100).select("rank", "ck", "airings", "works", "display")


def id_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of works aired up to three times, numbered by count and name."""
    return R.ordered(R.with_band(R.rank_works(identified(spark, sf_dir)), None, 3), "band").select("rank", "ck", "wk", "airings", "display")


def id_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the corpus."""
    return R.summary(identified(spark, sf_dir))


def id_summary_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chief composers and works."""
    return R.summary_tops(identified(spark, sf_dir))


def id_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year breakdown."""
    return R.years(identified(spark, sf_dir))


def id_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of composers by year."""
    return T.with_lift(T.year_counts(identified(spark, sf_dir)))


def id_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the projection reaches."""
    return N.status(M.projection(match_aligned(spark, sf_dir), segments(spark, sf_dir)), air(spark, sf_dir))


def id_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean name of each recording."""
    return N.recording_names(segments(spark, sf_dir))


def rank_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensembles by airings and works."""
    return R.rank_ensembles(air(spark, sf_dir)).select("nk", "airings", "works", "first_id")


def rank_directors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductors and directors by the parts of performers texts."""
    return R.rank_ensembles(air(spark, sf_dir), "conductor").select("nk", "airings", "works", "first_id")


def filter_ensemble_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks with ensembles of whom a spelling holds 'radio choir'."""
    return R.ensemble_identity(air(spark, sf_dir), "radio choir").select("id")


def filter_work_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All airings of the works that are aired most."""
    rows = air(spark, sf_dir)
    chief = R.rank_works(rows).orderBy(F.col("airings").desc(), "first_id").limit(1).first()
    return R.work_identity(rows, chief["ck"], chief["wk"]).select("id", "ck", "wk") if chief else rows.limit(0).select("id", "ck", "wk")


def filter_composer_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose composer's name holds 'ulrich' as written."""
    return R.composer_contains(segments(spark, sf_dir), "ulrich").select("id", "composer_name")


def summary_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chief composers and works by native keys."""
    return R.summary_tops(air(spark, sf_dir))


def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of works, numbered."""
    return R.ordered(R.rank_works(air(spark, sf_dir))).select("rank", "ck", "wk", "airings")


_NAMED = (id_airings, id_works, id_composers, id_report, id_summary, id_summary_tops, id_years, id_lift, id_status, id_recordings, rank_ensembles, rank_directors, filter_ensemble_identity, filter_work_identity, filter_composer_plain, summary_tops, rank_report)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

_CITIES = ", ".join("'" + c.lower() + "'" for c in R.CITIES.replace("ö", "o").replace("ü", "u").replace("ó", "o").split("|"))
_PARTS = rf"""raw AS (SELECT id, ck, wk, string_split(regexp_replace(performers, '[. ]+$', ''), ',') AS l FROM air WHERE performers <> ''),
one AS (SELECT id, ck, wk, unnest(list_filter(list_transform(l, lambda p: trim(p)), lambda p: p <> '')) AS part, generate_subscripts(list_filter(list_transform(l, lambda p: trim(p)), lambda p: p <> ''), 1) AS i FROM raw),
told AS (SELECT *, i > 1 AND strpos(part, '(') = 0 AND strpos(lag(part) OVER (PARTITION BY id ORDER BY i), '(') = 0 AND {sql_fold('lower(part)')} IN ({_CITIES}) AS city FROM one),
grp AS (SELECT *, sum(CASE WHEN city THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g FROM told),
parts AS (SELECT id, ck, wk, string_agg(part, ', ' ORDER BY i) AS part FROM grp GROUP BY id, ck, wk, g)"""
_NAMES = {
    "ensemble": rf"names AS (SELECT *, part AS name FROM parts WHERE NOT regexp_matches(part, '^(.*?)\s*\(([^)]+)\)\s*\.?\s*$'))",
    "conductor": rf"names AS (SELECT *, trim(regexp_extract(part, '^(.*?)\s*\(([^)]+)\)\s*\.?\s*$', 1)) AS name FROM parts WHERE regexp_matches(lower(regexp_extract(part, '^(.*?)\s*\(([^)]+)\)\s*\.?\s*$', 2)), 'conductor|director'))",
}
_KEYED = f"keyed AS (SELECT *, {sql_canonical('name')} AS nk FROM names)"
_RANKED = "SELECT nk, count(*) AS airings, count(DISTINCT concat(ck, '|', wk)) AS works, min(id) AS first_id FROM keyed WHERE nk <> '' GROUP BY nk"
ORACLES: dict[str, str] = {
    "rank_ensembles": f"WITH {AIR}, {_PARTS}, {_NAMES['ensemble']}, {_KEYED} {_RANKED}",
    "rank_directors": f"WITH {AIR}, {_PARTS}, {_NAMES['conductor']}, {_KEYED} {_RANKED}",
    "filter_ensemble_identity": f"WITH {AIR}, {_PARTS}, {_NAMES['ensemble']}, {_KEYED} SELECT id FROM air WHERE id IN (SELECT id FROM keyed WHERE nk IN (SELECT nk FROM keyed WHERE nk <> '' AND {sql_fold('lower(name)')} LIKE '%radio choir%'))",
    "filter_work_identity": f"""WITH {AIR}, w AS (SELECT ck, wk, count(*) AS airings, min(id) AS first_id FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL), c AS (SELECT ck, wk FROM w ORDER BY airings DESC, first_id LIMIT 1)
SELECT id, ck, wk FROM air JOIN c USING (ck, wk)""",
    "filter_composer_plain": f"WITH {SEG} SELECT id, composer_name FROM seg WHERE {sql_fold('lower(composer_name)')} LIKE '%ulrich%'",
    "summary_tops": f"""WITH {AIR}, w AS (SELECT ck, wk, count(*) AS n, min(id) AS first_id FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL), c AS (SELECT ck, CAST(sum(n) AS BIGINT) AS airings, count(*) AS works, min(first_id) AS first_id FROM w GROUP BY ck),
r AS (SELECT 'works' AS list, ck, wk, n, first_id FROM w UNION ALL SELECT 'composers', ck, '', airings, first_id FROM c UNION ALL SELECT 'composers_by_works', ck, '', works, first_id FROM c)
SELECT list, place, ck, wk, n FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, first_id) AS place FROM r) WHERE place <= 10""",
    "rank_report": f"WITH {AIR}, w AS (SELECT ck, wk, count(*) AS airings, min(id) AS first_id FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL) SELECT row_number() OVER (ORDER BY airings DESC, first_id) AS rank, ck, wk, airings FROM w",
    "id_recordings": """WITH b AS (SELECT s.* FROM segment_events s JOIN episodes e ON s.episode_pid = e.pid WHERE s.id = (SELECT min(x.id) FROM segment_events x WHERE x.event_pid = s.event_pid) AND recording_pid IS NOT NULL AND track_title <> ''),
r AS (SELECT recording_pid, coalesce(composer_name, '') AS composer, track_title AS title, row_number() OVER (PARTITION BY recording_pid ORDER BY coalesce(composer_name, ''), track_title) AS k FROM b) SELECT recording_pid, composer, array_to_string(list_filter(string_split_regex(title, '[\\s\\p{Z}]+'), lambda w: w <> ''), ' ') AS title FROM r WHERE k = 1""",
}
