"""Queries of the content tables, registry, closure and search, and relational extras, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import ranking as R
from aubade.operators import search as Q
from aubade.operators import temporal as T
from aubade.operators import warehouse as W
from aubade.plans.common import AIR, SEG_ONLY, SEG_WORK, air, nights, segments, sql_fold
from aubade.plans.matching import sql_slug
from aubade.plans.segments import _BRC, _LAND
from aubade.sources.tables import load


def site_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works table."""
    return W.work_rows(air(spark, sf_dir), segments(spark, sf_dir))


def site_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings table."""
    return W.recording_rows(segments(spark, sf_dir))


def site_composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers table."""
    return W.composer_rows(air(spark, sf_dir))


def site_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes table."""
    return W.episode_rows(air(spark, sf_dir), T.repeats(T.fingerprints(segments(spark, sf_dir)), nights(spark, sf_dir)))


def site_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browse lists."""
    return W.browse(air(spark, sf_dir), segments(spark, sf_dir))


def site_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique slugs of composers."""
    return W.with_slugs(R.rank_composers(air(spark, sf_dir)).select("ck"), "ck", ["ck"]).select("ck", "slug")


def site_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references of the base tables."""
    tables = {t: load(spark, sf_dir, t) for t in ("episodes", "tracks", "segment_events")}
    references = [("tracks", "episode_pid", "episodes", "pid"), ("segment_events", "episode_pid", "episodes", "pid"), ("episodes", "previous_pid", "episodes", "pid"), ("episodes", "next_pid", "episodes", "pid")]
    return W.closure(tables, references)


def site_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs after the composers from 2015 on meet a registry of those before."""
    rows = air(spark, sf_dir).where("ck <> '' and yr is not null")
    old = W.with_slugs(rows.where("yr < 2015").select("ck").distinct(), "ck", ["ck"]).select(F.col("ck").alias("key"), "slug")
    new = W.with_slugs(rows.where("yr >= 2015").select("ck").distinct(), "ck", ["ck"]).select(F.col("ck").alias("key"), "slug")
    after = W.sync_registry(old, new)[0]
    seen = lambda df, c: df.select("key", F.lit(True).alias(c)).distinct()
    told = after.join(seen(old, "was"), "key", "left").join(seen(new, "is"), "key", "left")
    return told.select("key", "slug", F.when(F.col("was").isNull(), "minted").when(F.col("is").isNull(), "orphan").otherwise("kept").alias("status"))


def search_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents of all kinds."""
    return Q.catalogue(air(spark, sf_dir), segments(spark, sf_dir))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index."""
    return Q.inverted(Q.catalogue(air(spark, sf_dir), segments(spark, sf_dir)))


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for 'beduveveld ulrich'."""
    return Q.search(Q.catalogue(air(spark, sf_dir), segments(spark, sf_dir)), "Beduveveld Ulrich")


def extra_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue rolled up over return flag and line status."""
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


def extra_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in 1995 but none in 1996."""
    orders = load(spark, sf_dir, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).select("o_custkey")
    return year(1995).exceptAll(year(1996)).distinct().subtract(year(1996))


def extra_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, closed after 30 minutes."""
    return load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("w.start").alias("started"), "n", "value")


def extra_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and year over five joined tables."""
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", F.year("o_orderdate").alias("yr")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_NAMED = (site_works, site_recordings, site_composers, site_episodes, site_browse, site_slugs, site_closure, site_registry, search_catalogue, search_index, search_query, extra_rollup, extra_setops, extra_sessions, extra_regions)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

ORACLES: dict[str, str] = {
    "site_episodes": f"""WITH {AIR}, {SEG_ONLY}, prints AS (SELECT episode_pid AS pid, sha1(string_agg(recording_pid, '|' ORDER BY coalesce(position, 1099511627776), id)) AS print FROM seg WHERE recording_pid IS NOT NULL GROUP BY 1),
d AS (SELECT p.pid, print, bdate FROM prints p JOIN nights n ON p.pid = n.pid WHERE bdate IS NOT NULL), r AS (SELECT pid, (SELECT count(DISTINCT e.bdate) FROM d e WHERE e.print = d.print AND e.bdate < d.bdate) AS earlier FROM d),
c AS (SELECT pid, bdate, count(*) AS tracks, count(DISTINCT CASE WHEN ck <> '' THEN ck END) AS composers FROM air GROUP BY ALL) SELECT c.*, coalesce(earlier, 0) AS earlier FROM c LEFT JOIN r USING (pid)""",
    "site_works": f"""WITH {AIR}, {SEG_ONLY}, {SEG_WORK}, r AS (SELECT ck, wk, count(DISTINCT recording_pid) AS n_recordings, count(*) AS n_segments FROM segw WHERE ck <> '' AND wk <> '' GROUP BY ALL),
t AS (SELECT ck, wk, count(*) AS airings, min(bdate) AS first_aired, max(bdate) AS last_aired, count(DISTINCT pid) AS nights FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL)
SELECT ck, wk, airings, coalesce(n_recordings, 0) AS n_recordings, greatest(airings - coalesce(n_segments, 0), 0) AS n_text_only, first_aired, last_aired, nights FROM t LEFT JOIN r USING (ck, wk)""",
    "site_recordings": f"""WITH {AIR}, {SEG_ONLY}, {SEG_WORK}, c AS (SELECT recording_pid, ck, wk, count(*) AS n, min(bdate) AS lo, max(bdate) AS hi FROM segw WHERE recording_pid IS NOT NULL AND ck <> '' AND wk <> '' GROUP BY ALL),
l0 AS (SELECT recording_pid, record_label, count(*) AS n FROM seg WHERE recording_pid IS NOT NULL AND record_label <> '' GROUP BY ALL), l AS (SELECT recording_pid, record_label, row_number() OVER (PARTITION BY recording_pid ORDER BY n DESC, record_label) AS k FROM l0),
b AS (SELECT recording_pid, list(struct_pack(ck := ck, wk := wk) ORDER BY n DESC, ck, wk)[1] AS w, CAST(sum(n) AS BIGINT) AS airings, min(lo) AS first_aired, max(hi) AS last_aired FROM c GROUP BY 1)
SELECT b.recording_pid, w.ck AS ck, w.wk AS wk, airings, record_label AS label, first_aired, last_aired FROM b LEFT JOIN l ON b.recording_pid = l.recording_pid AND k = 1""",
    "site_composers": f"""WITH {AIR}, w AS (SELECT ck, wk, count(*) AS n FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY n DESC, wk) AS k FROM w)
SELECT ck, CAST(sum(n) AS BIGINT) AS airings, count(*) AS works, string_agg(wk, '; ' ORDER BY k) FILTER (k <= 5) AS top_works FROM r GROUP BY ck""",
    "site_slugs": f"""WITH {AIR}, c AS (SELECT DISTINCT ck FROM air WHERE ck <> ''), b AS (SELECT ck, {sql_slug('ck')} AS base FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ck) AS k FROM b)
SELECT ck, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END AS slug FROM n""",
    "site_closure": """SELECT 'tracks.episode_pid -> episodes.pid' AS reference, count(*) AS dangling FROM tracks WHERE episode_pid IS NOT NULL AND episode_pid NOT IN (SELECT pid FROM episodes)
UNION ALL SELECT 'segment_events.episode_pid -> episodes.pid', count(*) FROM segment_events WHERE episode_pid IS NOT NULL AND episode_pid NOT IN (SELECT pid FROM episodes)
UNION ALL SELECT 'episodes.previous_pid -> episodes.pid', count(*) FROM episodes WHERE previous_pid IS NOT NULL AND previous_pid NOT IN (SELECT pid FROM episodes)
UNION ALL SELECT 'episodes.next_pid -> episodes.pid', count(*) FROM episodes WHERE next_pid IS NOT NULL AND next_pid NOT IN (SELECT pid FROM episodes)""",
    "site_registry": f"""WITH {AIR}, o AS (SELECT DISTINCT ck FROM air WHERE ck <> '' AND yr < 2015), n AS (SELECT DISTINCT ck FROM air WHERE ck <> '' AND yr >= 2015), b AS (SELECT ck, ck IN (SELECT ck FROM o) AS was, ck IN (SELECT ck FROM n) AS now, {sql_slug('ck')} AS base FROM (SELECT ck FROM o UNION SELECT ck FROM n)),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY NOT was, ck) AS i FROM b) SELECT ck AS key, CASE WHEN i = 1 THEN base ELSE concat(base, '-', i) END AS slug, CASE WHEN NOT was THEN 'minted' WHEN NOT now THEN 'orphan' ELSE 'kept' END AS status FROM k""",
    "site_browse": f"""WITH {AIR}, {SEG_ONLY}, w AS (SELECT concat_ws(' | ', ck, wk) AS label, count(*) AS airings FROM air WHERE ck <> '' AND wk <> '' GROUP BY 1), c AS (SELECT ck AS label, count(*) AS airings FROM air WHERE ck <> '' GROUP BY 1),
d AS (SELECT title, ck, wk, count(*) AS n FROM air WHERE title IS NOT NULL GROUP BY ALL), fw(form, word) AS (VALUES {', '.join(f"('{k}', '{x}')" for k, v in R.FORMS.items() for x in v.split())}),
fh AS (SELECT DISTINCT title, ck, wk, n, form FROM (SELECT *, unnest(string_split_regex({sql_fold('lower(title)')}, '[^a-z0-9_]+')) AS word FROM d) JOIN fw USING (word)), f AS (SELECT form AS label, CAST(sum(n) AS BIGINT) AS airings FROM fh GROUP BY 1),
b AS (SELECT {_BRC} AS label, count(*) AS airings FROM seg GROUP BY 1), l AS (SELECT {_LAND} AS label, count(*) AS airings FROM seg GROUP BY 1),
x AS (SELECT concat_ws(' | ', ck, wk) AS label, count(*) AS airings FROM air WHERE ck <> '' AND wk <> '' AND strftime(bdate, '%m-%d') IN ('12-24', '12-25', '12-26') GROUP BY 1),
a AS (SELECT 'works' AS list, * FROM w UNION ALL SELECT 'composers', * FROM c UNION ALL SELECT 'forms', * FROM f UNION ALL SELECT 'broadcasters', * FROM b UNION ALL SELECT 'countries', * FROM l UNION ALL SELECT 'christmas', * FROM x)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY airings DESC, label) AS place FROM a) WHERE place <= 25""",
    "extra_rollup": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extra_setops": "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)",
    "extra_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""",
    "extra_regions": """SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
