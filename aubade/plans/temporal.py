"""Queries over nights and years, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aubade.operators import ranking as R
from aubade.operators import temporal as T
from aubade.plans.common import AIR, CLOCK, SEG, air, nights, segments


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of tracks."""
    return T.track_lengths(air(spark, sf_dir))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of tracks from the night's first clock."""
    return T.episode_offsets(air(spark, sf_dir))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist digests."""
    return T.fingerprints(segments(spark, sf_dir))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier dates with the same playlist."""
    return T.repeats(T.fingerprints(segments(spark, sf_dir)), nights(spark, sf_dir))


def first_airings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First airings of works."""
    return T.first_airings(air(spark, sf_dir))


def first_of_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First track of each work and date."""
    return T.first_of_night(air(spark, sf_dir))


def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of composers by year."""
    return T.with_lift(T.year_counts(air(spark, sf_dir)))


def anniversaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anniversaries, at a floor of two plays for these data."""
    rows = air(spark, sf_dir)
    return T.anniversaries(T.year_counts(rows), R.composer_lives(rows), 2, 1.0)


def distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers a year stands out by."""
    return T.distinctive(T.year_counts(air(spark, sf_dir)), 3)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers first played lately and kept."""
    return T.arrivals(T.year_counts(air(spark, sf_dir)), 2026, 2008, 2)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates before and after each date."""
    return T.neighbours(nights(spark, sf_dir))


def on_this_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nights of Christmas Eve."""
    return T.on_this_night(nights(spark, sf_dir), "2100-12-24")


def theme_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First segments after two and four hours."""
    return T.theme_markers(segments(spark, sf_dir))


def opening_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening runs of one composer."""
    return T.opening_runs(air(spark, sf_dir))


def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a year's nights."""
    rows = air(spark, sf_dir)
    return T.texture(rows, T.track_lengths(rows))


_NAMED = (lengths, offsets, fingerprints, repeats, first_airings, first_of_night, lift, anniversaries, distinctive, arrivals, neighbours, on_this_night, theme_markers, opening_runs, texture)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"time_{q.__name__}": q for q in _NAMED}

_LEN = f"""clk AS (SELECT id, pid, position, {CLOCK} AS s FROM air), nxt AS (SELECT *, lead(s) OVER w AS ns, lead(position) OVER w AS np FROM clk WINDOW w AS (PARTITION BY pid ORDER BY position, id)),
len AS (SELECT id, CAST(CASE WHEN np = position + 1 AND (ns - s + 86400) % 86400 BETWEEN 1 AND 5400 THEN (ns - s + 86400) % 86400 END AS BIGINT) AS length_s FROM nxt)"""
_PRINT = """prints AS (SELECT episode_pid AS pid, sha1(string_agg(recording_pid, '|' ORDER BY coalesce(position, 1099511627776), id)) AS print FROM seg WHERE recording_pid IS NOT NULL GROUP BY 1)"""
_LIFT = """yc AS (SELECT ck, CAST(yr AS INTEGER) AS yr, count(*) AS plays FROM air WHERE ck <> '' AND yr IS NOT NULL GROUP BY ALL),
lf AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN round(plays / ((sum(plays) OVER w - plays) / (count(*) OVER w - 1)), 6) END AS lift FROM yc WINDOW w AS (PARTITION BY ck))"""
_LIVES = r"""sp AS (SELECT ck, try_cast(regexp_extract(composer_line, '[(\[](\d{4})\s*[-–]\s*(\d{4})[)\]]', 1) AS INTEGER) AS born, try_cast(regexp_extract(composer_line, '[(\[](\d{4})\s*[-–]\s*(\d{4})[)\]]', 2) AS INTEGER) AS died FROM air WHERE ck <> ''),
sn AS (SELECT ck, born, died, count(*) AS n FROM sp WHERE born IS NOT NULL AND died IS NOT NULL GROUP BY ALL),
lives AS (SELECT ck, born, died FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY n DESC, born, died) AS r FROM sn) WHERE r = 1)"""
_RAW: dict[str, str] = {
    "lengths": f"WITH {AIR}, {_LEN} SELECT * FROM len",
    "offsets": f"""WITH {AIR}, clk AS (SELECT id, pid, position, {CLOCK} AS s FROM air), c AS (SELECT * FROM clk WHERE s IS NOT NULL),
w AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY pid ORDER BY position, id) THEN 1 ELSE 0 END AS wrap FROM c)
SELECT id, CAST(s + 86400 * sum(wrap) OVER (PARTITION BY pid ORDER BY position, id) - first_value(s) OVER (PARTITION BY pid ORDER BY position, id) AS BIGINT) AS offset_s FROM w""",
    "fingerprints": f"WITH {SEG}, {_PRINT} SELECT * FROM prints",
    "repeats": f"""WITH {SEG}, {_PRINT}, d AS (SELECT p.pid, print, bdate FROM prints p JOIN nights n ON p.pid = n.pid WHERE bdate IS NOT NULL)
SELECT pid, (SELECT count(DISTINCT e.bdate) FROM d e WHERE e.print = d.print AND e.bdate < d.bdate) AS earlier FROM d""",
    "first_airings": f"""WITH {AIR}, r AS (SELECT *, row_number() OVER (PARTITION BY ck, wk ORDER BY bdate, position NULLS FIRST, id) AS k FROM air WHERE bdate IS NOT NULL AND ck <> '' AND wk <> '')
SELECT id, k = 1 AND bdate >= DATE '2012-03-15' AS work_first FROM r""",
    "first_of_night": f"""WITH {AIR} SELECT ck, wk, bdate, pid, position FROM (SELECT *, row_number() OVER (PARTITION BY ck, wk, bdate ORDER BY position NULLS FIRST, pid) AS k FROM air WHERE bdate IS NOT NULL AND ck <> '' AND wk <> '') WHERE k = 1""",
    "lift": f"WITH {AIR}, {_LIFT} SELECT * FROM lf",
    "anniversaries": f"""WITH {AIR}, {_LIFT}, {_LIVES}, j AS (SELECT *, CASE WHEN yr > born AND (yr - born) % 50 = 0 THEN yr - born END AS b, CASE WHEN yr > died AND (yr - died) % 50 = 0 THEN yr - died END AS d
 FROM lf JOIN lives USING (ck) WHERE plays >= 2 AND ck NOT IN ('anonymous', 'traditional', 'various') AND (lift IS NULL OR lift >= 1.0))
SELECT yr, ck, CASE WHEN b IS NOT NULL AND d IS NOT NULL THEN 'double' WHEN b IS NOT NULL THEN 'birth' ELSE 'death' END AS kind, CAST(coalesce(b, d) AS BIGINT) AS years, plays, lift FROM j WHERE b IS NOT NULL OR d IS NOT NULL""",
    "distinctive": f"""WITH {AIR}, {_LIFT} SELECT * FROM (SELECT yr, row_number() OVER (PARTITION BY yr ORDER BY lift DESC, plays DESC, ck) AS place, ck, plays, lift FROM lf WHERE plays >= 3 AND lift >= 1.4) WHERE place <= 10""",
    "arrivals": f"""WITH {AIR}, {_LIFT} SELECT ck, min(yr) AS debut, count(DISTINCT yr) - 1 AS later_years FROM yc GROUP BY ck HAVING min(yr) BETWEEN 2008 AND 2023 AND count(DISTINCT yr) - 1 >= 2""",
    "neighbours": f"WITH {AIR}, d AS (SELECT DISTINCT bdate FROM nights WHERE bdate IS NOT NULL) SELECT bdate, lag(bdate) OVER (ORDER BY bdate) AS before, lead(bdate) OVER (ORDER BY bdate) AS after FROM d",
    "on_this_night": f"WITH {AIR} SELECT DISTINCT bdate FROM nights WHERE strftime(bdate, '%m-%d') = '12-24' AND bdate < DATE '2100-12-24'",
    "theme_markers": f"""WITH {SEG}, b(boundary) AS (VALUES (CAST(7200 AS BIGINT)), (CAST(14400 AS BIGINT))), r AS (SELECT episode_pid, boundary, id, version_offset, row_number() OVER (PARTITION BY episode_pid, boundary ORDER BY version_offset, id) AS k,
 (SELECT min(version_offset) FROM seg x WHERE x.episode_pid = seg.episode_pid) AS lo FROM seg, b WHERE version_offset >= boundary)
SELECT episode_pid, boundary, id FROM r WHERE k = 1 AND lo < boundary""",
    "opening_runs": f"""WITH {AIR}, o AS (SELECT *, first_value(ck) OVER (PARTITION BY pid ORDER BY position, id) AS opener FROM air WHERE ck <> ''),
k AS (SELECT *, sum(CASE WHEN ck <> opener THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY position, id) AS breaks FROM o) SELECT pid, opener AS ck, count(*) AS tracks FROM k WHERE breaks = 0 GROUP BY ALL""",
    "texture": f"""WITH {AIR}, {_LEN} SELECT CAST(yr AS INTEGER) AS yr, count(DISTINCT pid) AS nights, round(count(*) / count(DISTINCT pid), 6) AS tracks_a_night, round(avg(length_s), 6) AS mean_length FROM air JOIN len USING (id) WHERE yr IS NOT NULL GROUP BY yr""",
}
ORACLES: dict[str, str] = {f"time_{k}": v for k, v in _RAW.items()}
