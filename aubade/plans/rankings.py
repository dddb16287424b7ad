"""Queries of rankings and summaries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import ranking as R
from aubade.plans.common import AIR, air

GOOD = r"NOT regexp_matches({c}, '[^ -~\x{{00a1}}-\x{{00ac}}\x{{00ae}}-\x{{024f}}\x{{2013}}\x{{2014}}\x{{2018}}\x{{2019}}\x{{201c}}\x{{201d}}]')"


def _best(keys: str, text: str, where: str) -> str:
    return rf"""spelled AS (SELECT {keys}, {text}, count(*) AS n, min(id) AS first_id FROM air WHERE {text} IS NOT NULL AND {where} GROUP BY ALL),
best AS (SELECT {keys}, {text} AS display FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {GOOD.format(c=text)} DESC, NOT regexp_matches({text}, '[(\[]') DESC, n DESC, first_id) AS r FROM spelled) WHERE r = 1)"""


def rank_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by airings with their best spelling."""
    return R.rank_works(air(spark, sf_dir)).select("ck", "wk", "airings", "first_aired", "last_aired", "first_id", "display")


def rank_works_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most aired works, numbered."""
    ranked = R.rank_works(air(spark, sf_dir))
    return R.numbered(ranked, F.col("airings").desc(), F.col("first_id"), top=50).select("rank", "ck", "wk", "airings")


def rank_composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers by airings, with works."""
    return R.rank_composers(air(spark, sf_dir)).select("ck", "airings", "works", "first_id", "display")


def rank_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces as printed."""
    return R.rank_pieces(air(spark, sf_dir))


def rank_conductors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductors by airings and works."""
    return R.rank_conductors(air(spark, sf_dir))


def rank_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works aired two to five times."""
    return R.with_band(R.rank_works(air(spark, sf_dir)), 2, 5).select("ck", "wk", "airings")


def rank_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 chief composers and the rest in one row."""
    ranked = R.rank_composers(air(spark, sf_dir)).select(F.col("ck").alias("label"), "airings")
    return R.with_tail(ranked, 20, F.col("airings").desc(), F.col("label"))


def top_works_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most aired works of each year."""
    counts = air(spark, sf_dir).where("yr is not null and ck <> '' and wk <> ''").groupBy("yr", "ck", "wk").agg(F.count("*").alias("airings"))
    return R.top_per_group(counts, ["yr"], 10, F.col("airings").desc(), F.col("ck"), F.col("wk"))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year breakdown."""
    return R.years(air(spark, sf_dir))


def partial_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partly covered years."""
    return R.partial_years(R.years(air(spark, sf_dir)))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the corpus."""
    return R.summary(air(spark, sf_dir))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by airing-count bucket."""
    return R.buckets(R.rank_works(air(spark, sf_dir)))


def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airings of the Christmas days from 2012 on."""
    return R.in_dates(air(spark, sf_dir), after="2012-01-01", before="2030-12-31", christmas=True).select("id", "bdate")


def filter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airings of titles with 'wind octet'."""
    return R.title_matches(air(spark, sf_dir), "Wind octet").select("id", "title")


def filter_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airings and works by form."""
    return R.forms(air(spark, sf_dir))


def filter_composer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All airings of composers of whom a spelling holds 'beduveveld'."""
    return R.composer_identity(air(spark, sf_dir), "beduveveld").select("id", "ck")


def filter_conductor_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All airings under conductors of whom a spelling holds 'begosurin'."""
    return R.conductor_identity(air(spark, sf_dir), "begosurin").select("id")


def composer_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life years by composer."""
    return R.composer_lives(air(spark, sf_dir))


def credit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed credits by role."""
    return R.credits(air(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


_NAMED = (rank_works, rank_works_top, rank_composers, rank_pieces, rank_conductors, rank_band, rank_tail, top_works_by_year, years, partial_years, summary, buckets, filter_dates, filter_title, filter_form, filter_composer_identity, filter_conductor_identity, composer_lives, credit_rows)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

_WORKS = "works AS (SELECT ck, wk, count(*) AS airings, min(bdate) AS first_aired, max(bdate) AS last_aired, min(id) AS first_id FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL)"
_YEARS = """years AS (SELECT yr, count(*) AS airings, count(DISTINCT CASE WHEN wk <> '' THEN concat(ck, '|', wk) END) AS works, count(DISTINCT CASE WHEN ck <> '' THEN ck END) AS composers,
 min(bdate) AS first_night, max(bdate) AS last_night FROM air WHERE bdate IS NOT NULL GROUP BY yr)"""
_CREDITS = r"""cr AS (SELECT id, pid, bdate, ck, wk, unnest(regexp_extract_all(performers, '([^(),;|/\n\[\]]+)[(\[]([^)\]]+)[)\]]')) AS credit FROM air WHERE performers IS NOT NULL),
credits AS (SELECT * FROM (SELECT id, pid, bdate, ck, wk, trim(regexp_extract(credit, '^([^(\[]+)', 1), ' ') AS name, lower(trim(regexp_extract(credit, '[(\[]([^)\]]+)[)\]]', 1))) AS role FROM cr) WHERE name <> '')"""


def _key(x: str) -> str:
    from aubade.plans.common import sql_key

    return sql_key(x)


def _fold(x: str) -> str:
    from aubade.plans.common import sql_fold

    return sql_fold(f"lower({x})")


ORACLES: dict[str, str] = {
    "rank_works": f"WITH {AIR}, {_WORKS}, {_best('ck, wk', 'title', chr(39).join(['ck <> ', '', ' AND wk <> ', '', '']))} SELECT works.*, display FROM works LEFT JOIN best USING (ck, wk)",
    "rank_works_top": f"WITH {AIR}, {_WORKS} SELECT row_number() OVER (ORDER BY airings DESC, first_id) AS rank, ck, wk, airings FROM works ORDER BY airings DESC, first_id LIMIT 50",
    "rank_composers": f"""WITH {AIR}, {_best('ck', 'composer', "ck <> ''")}, tot AS (SELECT ck, count(*) AS airings, count(DISTINCT CASE WHEN wk <> '' THEN wk END) AS works, min(id) AS first_id FROM air WHERE ck <> '' GROUP BY ck)
SELECT tot.*, display FROM tot LEFT JOIN best USING (ck)""",
    "rank_pieces": f"WITH {AIR} SELECT composer, title, count(*) AS airings, min(id) AS first_id FROM air WHERE composer IS NOT NULL AND title IS NOT NULL GROUP BY ALL",
    "rank_conductors": f"WITH {AIR}, {_CREDITS}, c AS (SELECT *, {_key('name')} AS nk FROM credits WHERE role = 'conductor') SELECT nk, count(*) AS airings, count(DISTINCT concat(ck, '|', wk)) AS works FROM c WHERE nk <> '' GROUP BY nk",
    "rank_band": f"WITH {AIR}, {_WORKS} SELECT ck, wk, airings FROM works WHERE airings BETWEEN 2 AND 5",
    "rank_tail": f"""WITH {AIR}, r AS (SELECT ck AS label, count(*) AS airings FROM air WHERE ck <> '' GROUP BY ck), h AS (SELECT * FROM r ORDER BY airings DESC, label LIMIT 20)
SELECT label, airings, CAST(1 AS BIGINT) AS members FROM h UNION ALL SELECT '... more', CAST((SELECT sum(airings) FROM r) - (SELECT sum(airings) FROM h) AS BIGINT), (SELECT count(*) FROM r) - 20 WHERE (SELECT count(*) FROM r) > 20""",
    "top_works_by_year": f"""WITH {AIR}, c AS (SELECT yr, ck, wk, count(*) AS airings FROM air WHERE yr IS NOT NULL AND ck <> '' AND wk <> '' GROUP BY ALL)
SELECT * FROM (SELECT CAST(yr AS INTEGER) AS yr, ck, wk, airings, row_number() OVER (PARTITION BY yr ORDER BY airings DESC, ck, wk) AS place FROM c) WHERE place <= 10""",
    "years": f"WITH {AIR}, {_YEARS} SELECT CAST(yr AS INTEGER) AS yr, airings, works, composers, first_night, last_night FROM years",
    "partial_years": f"""WITH {AIR}, {_YEARS} SELECT CAST(yr AS INTEGER) AS yr, (yr = (SELECT min(yr) FROM years) AND strftime(first_night, '%m-%d') > '01-01') OR (yr = (SELECT max(yr) FROM years) AND strftime(last_night, '%m-%d') < '12-31') AS partial FROM years""",
    "summary": f"""WITH {AIR}, full_air AS (SELECT * FROM air WHERE composer <> '' AND title <> ''), s AS (SELECT pid, count(*) AS n FROM full_air GROUP BY pid)
SELECT count(*) AS airings, count(DISTINCT pid) AS nights, count(DISTINCT CASE WHEN ck <> '' THEN ck END) AS composers, count(DISTINCT CASE WHEN wk <> '' AND ck <> '' THEN concat(ck, '|', wk) END) AS works,
 (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] FROM s) AS median_tracks, round(count(*) / count(DISTINCT pid), 6) AS mean_tracks FROM full_air""",
    "buckets": f"""WITH {AIR}, {_WORKS} SELECT CASE WHEN airings <= 1 THEN '1' WHEN airings <= 5 THEN '2-5' WHEN airings <= 10 THEN '6-10' WHEN airings <= 50 THEN '11-50' WHEN airings <= 100 THEN '51-100' ELSE '100+' END AS bucket,
 count(*) AS entries, CAST(sum(airings) AS BIGINT) AS airings FROM works GROUP BY 1""",
    "filter_dates": f"WITH {AIR} SELECT id, bdate FROM air WHERE bdate BETWEEN DATE '2012-01-01' AND DATE '2030-12-31' AND strftime(bdate, '%m-%d') IN ('12-24', '12-25', '12-26')",
    "filter_title": f"WITH {AIR} SELECT id, title FROM air WHERE concat(' ', {_key('title')}, ' ') LIKE '% wind octet %'",
    "filter_form": f"""WITH {AIR}, d AS (SELECT title, ck, wk, count(*) AS n FROM air WHERE title IS NOT NULL GROUP BY ALL), f(form, word) AS (VALUES {', '.join(f"('{k}', '{w}')" for k, v in R.FORMS.items() for w in v.split())}),
h AS (SELECT DISTINCT title, ck, wk, n, form FROM (SELECT *, unnest(string_split_regex({_fold('title')}, '[^a-z0-9_]+')) AS word FROM d) JOIN f USING (word)) SELECT form, CAST(sum(n) AS BIGINT) AS airings, count(DISTINCT concat(ck, '|', wk)) AS works FROM h GROUP BY form""",
    "filter_composer_identity": f"WITH {AIR} SELECT id, ck FROM air WHERE ck IN (SELECT ck FROM air WHERE {_fold('composer')} LIKE '%beduveveld%')",
    "filter_conductor_identity": f"""WITH {AIR}, {_CREDITS}, c AS (SELECT *, {_key('name')} AS nk FROM credits WHERE role = 'conductor')
SELECT id FROM air WHERE id IN (SELECT id FROM c WHERE nk IN (SELECT nk FROM c WHERE {_fold('name')} LIKE '%begosurin%'))""",
    "composer_lives": rf"""WITH {AIR}, s AS (SELECT ck, try_cast(regexp_extract(composer_line, '[(\[](\d{{4}})\s*[-–]\s*(\d{{4}})[)\]]', 1) AS INTEGER) AS born, try_cast(regexp_extract(composer_line, '[(\[](\d{{4}})\s*[-–]\s*(\d{{4}})[)\]]', 2) AS INTEGER) AS died FROM air WHERE ck <> ''),
n AS (SELECT ck, born, died, count(*) AS n FROM s WHERE born IS NOT NULL AND died IS NOT NULL GROUP BY ALL)
SELECT ck, born, died FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY n DESC, born, died) AS r FROM n) WHERE r = 1""",
    "credit_rows": f"WITH {AIR}, {_CREDITS} SELECT role, count(*) AS n, count(DISTINCT name) AS names FROM credits GROUP BY role",
}
