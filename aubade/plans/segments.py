"""Queries over structured segments, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.functions import stations as B
from aubade.functions.text import surname
from aubade.operators import segments as S
from aubade.plans.common import SEG, SEG_WORK, segments, sql_key, sql_surname


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = segments(spark, sf_dir)
    return S.role_rows(rows), rows


def seg_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by role."""
    return _roles(spark, sf_dir)[0].groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("nk").alias("names"))


def seg_name_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one id."""
    return S.name_maps(_roles(spark, sf_dir)[0])


def seg_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and names by identity."""
    return S.identified(_roles(spark, sf_dir)[0]).groupBy("identity").agg(F.count("*").alias("n"), F.countDistinct("nk").alias("names"))


def seg_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings."""
    return S.recordings(segments(spark, sf_dir))


def seg_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority label by recording."""
    return S.majority_labels(segments(spark, sf_dir))


def seg_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors by airings."""
    return S.rank_contributors(*_roles(spark, sf_dir))


def seg_conductors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductors by airings."""
    return S.rank_contributors(*_roles(spark, sf_dir), ("conductor",))


def seg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by id and by name."""
    return S.coverage(_roles(spark, sf_dir)[0])


def seg_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of recordings."""
    return S.works(segments(spark, sf_dir))


def seg_alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings under several works."""
    return S.alias_candidates(segments(spark, sf_dir))


def seg_broadcasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcasters with shares."""
    return S.broadcasters(segments(spark, sf_dir), private=True)


def seg_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries."""
    return S.countries(segments(spark, sf_dir), private=True)


def seg_duration_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of five to ten minutes."""
    return S.duration_band(segments(spark, sf_dir), 300, 600).select("id", "duration_seconds")


def seg_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted median lengths of works."""
    return S.median_lengths(segments(spark, sf_dir))


def seg_length_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by class of length."""
    return S.length_classes(S.median_lengths(segments(spark, sf_dir)))


def seg_mbid_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composer ids under several names."""
    return S.mbid_aliases(segments(spark, sf_dir))


def seg_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames under several composer ids."""
    return S.ambiguous_names(segments(spark, sf_dir), surname(F.col("composer_name")))


def seg_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composer identities after backfill."""
    return S.backfilled(segments(spark, sf_dir)).groupBy("cid").agg(F.count("*").alias("n"))


def seg_national_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights of one country, at a low share for these data."""
    return S.national_nights(segments(spark, sf_dir), 3, 0.3, private=True)


def seg_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers each country stands out by."""
    return S.night_signature(segments(spark, sf_dir), private=True)


def seg_collaborators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent partners."""
    return S.collaborators(_roles(spark, sf_dir)[0])


def seg_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant kinds of identities."""
    return S.kinds(_roles(spark, sf_dir)[0])


def seg_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House performances of the chief works."""
    return S.house_performances(segments(spark, sf_dir))


_NAMED = (seg_roles, seg_name_maps, seg_identities, seg_recordings, seg_labels, seg_contributors, seg_conductors, seg_coverage, seg_works, seg_alias_candidates, seg_broadcasters, seg_countries, seg_duration_band, seg_medians, seg_length_classes, seg_mbid_aliases, seg_ambiguous, seg_backfill, seg_national_nights, seg_signature, seg_collaborators, seg_kinds, seg_house)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

_ROLES = f"""raw AS (SELECT id, recording_pid, episode_pid, CASE WHEN trim(contributions_json) LIKE '{{%' THEN concat('[', contributions_json, ']') ELSE contributions_json END AS j FROM seg WHERE contributions_json IS NOT NULL),
cells AS (SELECT id, recording_pid, episode_pid, unnest(from_json(j, '["JSON"]')) AS c FROM raw WHERE json_valid(j)),
named AS (SELECT id, recording_pid, episode_pid, json_extract_string(c, '$.name') AS name, lower(json_extract_string(c, '$.role')) AS role, json_extract_string(c, '$.musicbrainz_gid') AS mbid FROM cells),
roles AS (SELECT *, {sql_key('name')} AS nk FROM named WHERE name IS NOT NULL),
maps AS (SELECT nk, min(mbid) AS only_mbid FROM roles WHERE mbid IS NOT NULL AND nk <> '' GROUP BY nk HAVING min(mbid) = max(mbid)),
ident AS (SELECT roles.*, coalesce(mbid, only_mbid, concat('name:', nk)) AS identity FROM roles LEFT JOIN maps USING (nk) WHERE nk <> '')"""
_TIDY = "coalesce(map([" + ", ".join(f"'{c}'" for c in B.VARIANTS) + "], [" + ", ".join(f"'{c}'" for c in B.VARIANTS.values()) + "])[upper(trim(record_label))], upper(trim(record_label)))"
_BRC = f"CASE WHEN coalesce(trim(record_label), '') = '' THEN 'UNATTRIBUTED' WHEN {_TIDY} IN ({', '.join(repr(c) for c in B.CODES)}) OR regexp_matches({_TIDY}, '{B.PRIVATE}') THEN {_TIDY} ELSE 'OTHER' END"
_LAND = "coalesce(map([" + ", ".join(f"'{c}'" for c in B.CODES) + "], [" + ", ".join(f"'{n}'" for _, _, n in B.CODES.values()) + f"])[{_BRC}], CASE WHEN {_BRC} IN ('OTHER', 'UNATTRIBUTED') THEN {_BRC} ELSE substr({_BRC}, 1, 2) END)"
_RANK = """u AS (SELECT DISTINCT recording_pid, identity FROM ident WHERE recording_pid IS NOT NULL {and_role}), c AS (SELECT recording_pid, count(*) AS n FROM seg WHERE recording_pid IS NOT NULL GROUP BY 1)
SELECT identity, CAST(sum(n) AS BIGINT) AS airings, count(*) AS recordings FROM u JOIN c USING (recording_pid) GROUP BY identity"""
_MED = """sizes AS (SELECT ck, wk, duration_seconds, count(*) AS n FROM segw WHERE ck <> '' AND wk <> '' AND duration_seconds >= 10 GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY ck, wk ORDER BY duration_seconds) AS cum, sum(n) OVER (PARTITION BY ck, wk) AS total FROM sizes),
med AS (SELECT ck, wk, min(duration_seconds) AS median_s FROM cum WHERE 2 * cum >= total GROUP BY ck, wk)"""

ORACLES: dict[str, str] = {
    "seg_roles": f"WITH {SEG}, {_ROLES} SELECT role, count(*) AS n, count(DISTINCT nk) AS names FROM roles GROUP BY role",
    "seg_name_maps": f"WITH {SEG}, {_ROLES} SELECT nk, only_mbid FROM maps",
    "seg_identities": f"WITH {SEG}, {_ROLES} SELECT identity, count(*) AS n, count(DISTINCT nk) AS names FROM ident GROUP BY identity",
    "seg_recordings": f"""WITH {SEG} SELECT recording_pid, count(*) AS airings, min(bdate) AS first_aired, max(bdate) AS last_aired, list(track_title ORDER BY id)[1] AS title, list(composer_name ORDER BY id)[1] AS composer, list(duration_seconds ORDER BY id)[1] AS duration FROM seg GROUP BY recording_pid""",
    "seg_labels": f"""WITH {SEG}, c AS (SELECT recording_pid, record_label, count(*) AS n FROM seg WHERE recording_pid IS NOT NULL AND record_label <> '' GROUP BY ALL)
SELECT recording_pid, record_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY recording_pid ORDER BY n DESC, record_label) AS r FROM c) WHERE r = 1""",
    "seg_contributors": f"WITH {SEG}, {_ROLES}, {_RANK.format(and_role='')}",
    "seg_conductors": f"WITH {SEG}, {_ROLES}, {_RANK.format(and_role=chr(65) + 'ND role = ' + chr(39) + 'conductor' + chr(39))}",
    "seg_coverage": f"WITH {SEG}, {_ROLES} SELECT count(*) FILTER (identity NOT LIKE 'name:%') AS by_id, count(*) FILTER (identity LIKE 'name:%') AS by_name FROM ident",
    "seg_works": f"""WITH {SEG}, {SEG_WORK} SELECT ck, wk, count(*) AS airings, count(DISTINCT recording_pid) AS recordings, coalesce(max(duration_seconds) >= 2 * min(duration_seconds), false) AS excerpt FROM segw WHERE ck <> '' AND wk <> '' GROUP BY ck, wk""",
    "seg_alias_candidates": f"""WITH {SEG}, {SEG_WORK} SELECT recording_pid, count(DISTINCT concat(ck, '|', wk)) AS works FROM segw WHERE recording_pid IS NOT NULL AND ck <> '' AND wk <> '' GROUP BY 1 HAVING count(DISTINCT concat(ck, '|', wk)) > 1""",
    "seg_broadcasters": f"""WITH {SEG}, b AS (SELECT {_BRC} AS brc, count(*) AS airings, count(DISTINCT recording_pid) AS recordings FROM seg GROUP BY 1)
SELECT brc, CAST(CASE brc WHEN 'UNATTRIBUTED' THEN 2 WHEN 'OTHER' THEN 1 ELSE 0 END AS INTEGER) AS tier, airings, recordings, CASE WHEN brc <> 'UNATTRIBUTED' THEN round(100 * airings / (SELECT sum(airings) FROM b WHERE brc <> 'UNATTRIBUTED'), 4) END AS share FROM b""",
    "seg_countries": f"""WITH {SEG}, b AS (SELECT *, {_LAND} AS country FROM seg) SELECT country, count(*) AS airings, count(DISTINCT recording_pid) AS recordings FROM b GROUP BY 1""",
    "seg_duration_band": f"WITH {SEG} SELECT id, duration_seconds FROM seg WHERE duration_seconds BETWEEN 300 AND 600",
    "seg_medians": f"WITH {SEG}, {SEG_WORK}, {_MED} SELECT * FROM med",
    "seg_length_classes": f"WITH {SEG}, {SEG_WORK}, {_MED} SELECT CASE WHEN median_s < 600 THEN 'short' WHEN median_s < 1800 THEN 'medium' ELSE 'long' END AS class, count(*) AS works FROM med GROUP BY 1",
    "seg_mbid_aliases": f"WITH {SEG} SELECT composer_mbid, count(DISTINCT ck) AS names FROM seg WHERE composer_mbid IS NOT NULL AND ck <> '' GROUP BY 1 HAVING count(DISTINCT ck) > 1",
    "seg_ambiguous": f"""WITH {SEG}, k AS (SELECT composer_mbid, {sql_surname('composer_name')} AS ck FROM seg) SELECT ck, count(DISTINCT composer_mbid) AS ids FROM k WHERE composer_mbid IS NOT NULL AND ck <> '' GROUP BY 1 HAVING count(DISTINCT composer_mbid) > 1""",
    "seg_backfill": f"""WITH {SEG}, k AS (SELECT ck, min(composer_mbid) AS lo FROM seg WHERE composer_mbid IS NOT NULL AND ck <> '' GROUP BY ck HAVING min(composer_mbid) = max(composer_mbid))
SELECT CASE WHEN composer_mbid IS NOT NULL THEN composer_mbid WHEN lo IS NOT NULL THEN lo WHEN seg.ck IS NOT NULL THEN concat('name:', seg.ck) END AS cid, count(*) AS n FROM seg LEFT JOIN k USING (ck) GROUP BY 1""",
    "seg_national_nights": f"""WITH {SEG}, b AS (SELECT episode_pid, {_LAND} AS country, count(*) AS n FROM seg WHERE {_BRC} NOT IN ('OTHER', 'UNATTRIBUTED') GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY episode_pid) AS recognised, row_number() OVER (PARTITION BY episode_pid ORDER BY n DESC, country DESC) AS k FROM b)
SELECT episode_pid, country, n, CAST(recognised AS BIGINT) AS recognised FROM r WHERE k = 1 AND recognised >= 3 AND n >= 0.3 * recognised""",
    "seg_signature": f"""WITH {SEG}, p AS (SELECT {_LAND} AS country, ck, count(*) AS n FROM seg WHERE ck <> '' AND {_BRC} NOT IN ('OTHER', 'UNATTRIBUTED') GROUP BY ALL),
l AS (SELECT country, ck, n, round((n / sum(n) OVER (PARTITION BY country)) / (sum(n) OVER (PARTITION BY ck) / sum(n) OVER ()), 6) AS lift FROM p)
SELECT country, ck, lift, place FROM (SELECT country, ck, lift, row_number() OVER (PARTITION BY country ORDER BY lift DESC, ck) AS place FROM l WHERE n >= 3) WHERE place <= 5""",
    "seg_collaborators": f"""WITH {SEG}, {_ROLES}, u AS (SELECT DISTINCT id, recording_pid, identity FROM ident WHERE recording_pid IS NOT NULL),
p AS (SELECT a.identity, b.identity AS other, count(DISTINCT a.recording_pid) AS recordings FROM u a JOIN u b ON a.id = b.id AND a.identity <> b.identity GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY recordings DESC, other) AS place FROM p) WHERE place <= 3""",
    "seg_kinds": f"""WITH {SEG}, {_ROLES}, k AS (SELECT identity, CASE WHEN role = 'conductor' THEN 'conductor' WHEN role IN ('orchestra', 'ensemble', 'choir') THEN 'ensemble' WHEN role = 'composer' THEN 'composer' WHEN regexp_matches(role, 'soprano|alto|tenor|baritone|bass$|singer') THEN 'singer' ELSE 'performer' END AS kind, count(*) AS n FROM ident GROUP BY ALL)
SELECT identity, kind FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY n DESC, kind) AS r FROM k) WHERE r = 1""",
    "seg_house": f"""WITH {SEG}, {SEG_WORK}, chief AS (SELECT ck, wk, count(*) AS al FROM segw WHERE ck <> '' AND wk <> '' GROUP BY ALL ORDER BY al DESC, ck, wk LIMIT 50),
n AS (SELECT ck, wk, recording_pid, count(*) AS n FROM segw JOIN chief USING (ck, wk) WHERE year(bdate) >= 2016 AND recording_pid IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY ck, wk) AS t, row_number() OVER (PARTITION BY ck, wk ORDER BY n DESC, recording_pid) AS k FROM n)
SELECT ck, wk, recording_pid, n AS airings, round(n / t, 6) AS share FROM r WHERE k = 1""",
}
