"""Queries of audits, page figures and the whole content build, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import audit as U
from aubade.operators import curation as C
from aubade.operators import ranking as R
from aubade.operators import segments as S
from aubade.operators import temporal as T
from aubade.operators import warehouse as W
from aubade.plans.common import AIR, SEG, SEG_ONLY, SEG_WORK, air, segments
from aubade.plans.temporal import _LEN
from aubade.sources.tables import load


def audit_majorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers whose commonest spelling may be the wrong one."""
    return U.doubtful_majorities(air(spark, sf_dir), 0.1)


def audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typical length and title of works."""
    rows = air(spark, sf_dir)
    return U.typical_lengths(rows, T.track_lengths(rows))


def audit_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contributors are called."""
    return U.contributor_displays(S.role_rows(segments(spark, sf_dir)))


def audit_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every year."""
    return U.yearly_summary(air(spark, sf_dir))


def audit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What works' pages show."""
    rows = air(spark, sf_dir)
    return U.gates(rows, T.track_lengths(rows))


def audit_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings beside their works, each with one."""
    segs = segments(spark, sf_dir)
    return U.recordings_with_works(W.recording_rows(segs), S.works(segs).select("ck", "wk", F.col("airings").alias("work_airings"))).select("recording_pid", "ck", "wk", "airings", "work_airings")


def audit_recording_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings held by works."""
    return U.recording_sets(S.with_work(segments(spark, sf_dir)))


def audit_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of segments as text."""
    return U.formatted(segments(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of composers as lines of text."""
    return U.rendered(R.ordered(R.rank_composers(air(spark, sf_dir)), top=100), "ck")


def audit_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the title each episode's subtitle begins with, and what of it is worth showing."""
    rows = load(spark, sf_dir, "episodes").where("title is not null and subtitle is not null")
    return rows.select("pid", C.common_prefix(F.col("title"), F.col("subtitle")).cast("bigint").alias("common"), U.useful_subtitle(F.col("title"), F.col("subtitle")).alias("useful"), U.page_url(F.lit("episode"), F.col("pid")).alias("url"))


def site_content_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references among the content tables as they would be published."""
    return W.closure(*W.content_tables(air(spark, sf_dir), segments(spark, sf_dir)))


_NAMED = (audit_majorities, audit_lengths, audit_displays, audit_years, audit_gates, audit_guarded, audit_recording_sets, audit_formats, audit_report, audit_prefixes, site_content_closure)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

_EXCLUDED = r"(strpos(composer, ',') > 0 OR regexp_matches(composer, '(?i)\barr\b') OR regexp_matches(composer, '^(Traditional|Anon|Unknown)'))"
ORACLES: dict[str, str] = {
    "audit_majorities": rf"""WITH {AIR}, n AS (SELECT ck, composer, count(*) AS n, min(id) AS f FROM air WHERE ck <> '' AND NOT {_EXCLUDED} GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY n DESC, f) AS k FROM n),
p AS (SELECT a.ck, a.composer AS big, b.composer AS small, a.n AS n_big, b.n AS n_small FROM k a JOIN k b ON a.ck = b.ck AND a.k = 1 AND b.k = 2)
SELECT * FROM p WHERE n_small >= 0.1 * n_big AND (length(regexp_replace(small, '[\x00-\x7f]', '', 'g')) > length(regexp_replace(big, '[\x00-\x7f]', '', 'g')) OR length(small) > length(big))""",
    "audit_lengths": f"""WITH {AIR}, {_LEN}, r AS (SELECT air.*, length_s FROM air LEFT JOIN len USING (id) WHERE ck <> '' AND wk <> ''), m AS (SELECT ck, wk, quantile_cont(length_s, 0.5) AS median_s FROM r GROUP BY ALL),
t AS (SELECT ck, wk, title, row_number() OVER (PARTITION BY ck, wk ORDER BY count(*) DESC, title DESC) AS k FROM r WHERE title IS NOT NULL GROUP BY ck, wk, title) SELECT m.ck, m.wk, title, median_s FROM m LEFT JOIN t ON m.ck = t.ck AND m.wk = t.wk AND k = 1""",
    "audit_years": f"""WITH {AIR}, y AS (SELECT CAST(yr AS INTEGER) AS yr, count(*) AS airings, count(DISTINCT CASE WHEN wk <> '' THEN concat(ck, '|', wk) END) AS works, count(DISTINCT CASE WHEN ck <> '' THEN ck END) AS composers, min(bdate) AS first_night, max(bdate) AS last_night FROM air WHERE bdate IS NOT NULL GROUP BY yr),
s AS (SELECT CAST(yr AS INTEGER) AS yr, pid, count(*) AS n FROM air WHERE yr IS NOT NULL GROUP BY ALL), m AS (SELECT yr, count(*) AS nights, list_sort(list(n))[len(list(n)) // 2 + 1] AS median_tracks FROM s GROUP BY yr) SELECT y.*, nights, median_tracks FROM y JOIN m USING (yr)""",
    "audit_gates": f"""WITH {AIR}, {_LEN} SELECT ck, wk, count(*) AS airings, count(DISTINCT yr) >= 3 OR count(*) >= 5 AS bars, count(length_s) >= 0.9 * count(*) AS lengths FROM air LEFT JOIN len USING (id) WHERE ck <> '' AND wk <> '' GROUP BY ck, wk""",
    "audit_guarded": f"""WITH {AIR}, {SEG_ONLY}, {SEG_WORK}, c AS (SELECT recording_pid, ck, wk, count(*) AS n FROM segw WHERE recording_pid IS NOT NULL AND ck <> '' AND wk <> '' GROUP BY ALL), b AS (SELECT recording_pid, list(struct_pack(ck := ck, wk := wk) ORDER BY n DESC, ck, wk)[1] AS w, CAST(sum(n) AS BIGINT) AS airings FROM c GROUP BY 1),
w AS (SELECT ck, wk, count(*) AS work_airings FROM segw WHERE ck <> '' AND wk <> '' GROUP BY ALL) SELECT recording_pid, w.ck, w.wk, airings, work_airings FROM b JOIN w ON b.w.ck = w.ck AND b.w.wk = w.wk""",
    "audit_recording_sets": f"WITH {SEG}, {SEG_WORK} SELECT DISTINCT concat(ck, '|', wk) AS key, recording_pid AS rp FROM segw WHERE recording_pid IS NOT NULL AND ck <> '' AND wk <> ''",
    "audit_formats": f"""WITH {SEG}, s AS (SELECT *, (version_offset % 86400 + 86400) % 86400 AS o FROM seg) SELECT id, CASE WHEN duration_seconds >= 3600 THEN printf('%d:%02d:%02d', duration_seconds // 3600, duration_seconds % 3600 // 60, duration_seconds % 60) WHEN duration_seconds IS NOT NULL THEN printf('%d:%02d', duration_seconds % 3600 // 60, duration_seconds % 60) END AS length,
 CASE WHEN version_offset IS NOT NULL THEN printf('%d:%02d %s', (o // 3600 + 11) % 12 + 1, o % 3600 // 60, CASE WHEN o < 43200 THEN 'AM' ELSE 'PM' END) END AS starts, strftime(bdate, '%-d %B %Y') AS night FROM s""",
    "audit_report": f"""WITH {AIR}, c AS (SELECT ck, count(*) AS airings, min(id) AS f FROM air WHERE ck <> '' GROUP BY ck), r AS (SELECT ck, airings, row_number() OVER (ORDER BY airings DESC, f) AS rank FROM c)
SELECT rank, concat(lpad(CAST(rank AS VARCHAR), 4, ' '), '. ', CASE WHEN length(ck) < 60 THEN rpad(ck, 60, ' ') ELSE ck END, ' ', lpad(CAST(airings AS VARCHAR), 6, ' ')) AS line FROM r WHERE rank <= 100""",
    "audit_prefixes": """SELECT pid, CAST((SELECT coalesce(max(i), 0) FROM range(1, least(length(title), length(subtitle)) + 1) t(i) WHERE substr(title, 1, i) = substr(subtitle, 1, i)) AS BIGINT) AS common,
 CASE WHEN subtitle <> '' AND NOT contains(lower(trim(title)), lower(trim(subtitle))) THEN trim(subtitle) ELSE '' END AS useful, concat('/episodes/', pid, '/') AS url FROM episodes WHERE title IS NOT NULL AND subtitle IS NOT NULL""",
    "audit_displays": None,
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
