"""Tables and SQL fragments that the reference queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.functions.text import AND_WORDS, CANONICAL_STEPS, DOUBLE_QUOTES, NUMBER_WORDS, SINGLE_QUOTES, NARROW, WIDE
from aubade.functions.titlekey import composer_key
from aubade.operators import ranking
from aubade.operators.instants import MONTHS
from aubade.operators.ranking import DAY_FORMS
from aubade.operators.temporal import CLOCK_FORM
from aubade.sources.tables import load


def air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All airings."""
    return ranking.airings(load(spark, sf_dir, "tracks"), load(spark, sf_dir, "episodes"))


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, bdate`` of all episodes."""
    return load(spark, sf_dir, "episodes").select("pid", ranking.broadcast_day(F.col("broadcast_date")).alias("bdate"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment rows with their night's date and composer key; re-deliveries of one event reduced to the first (A5)."""
    rows = load(spark, sf_dir, "segment_events")
    first = rows.groupBy("event_pid").agg(F.min("id").alias("id"))
    kept = rows.join(first, ["event_pid", "id"], "left_semi")
    return kept.join(nights(spark, sf_dir), kept.episode_pid == F.col("pid")).drop("pid").withColumn("ck", composer_key(F.col("composer_name")))


def sql_fold(x: str) -> str:
    """SQL of the fold to unaccented letters in lower case."""
    for a, b in (("ł", "l"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("ħ", "h"), ("ı", "i"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents(translate({x}, '{WIDE}', '{NARROW.lower().replace(chr(39), chr(39) * 2)}'))"


def sql_key(x: str) -> str:
    """SQL of plain_key."""
    return rf"trim(regexp_replace(regexp_replace({sql_fold(f'lower({x})')}, '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def sql_surname(x: str) -> str:
    """SQL of surname."""
    key = rf"trim(regexp_replace({sql_key(x)}, ' (jr|sr|i|ii|iii|the elder|the younger)$', ''))"
    return f"CASE WHEN starts_with({key}, 'anon') THEN 'anonymous' WHEN starts_with({key}, 'trad') THEN 'traditional' ELSE list_last(string_split({key}, ' ')) END"


def sql_canonical(x: str) -> str:
    """SQL of canonical_key, for texts that need no repair."""
    t = f"translate({sql_fold(f'lower({x})')}, '‐‑–—{SINGLE_QUOTES}{DOUBLE_QUOTES}', '----{chr(39) * 2 * len(SINGLE_QUOTES)}{chr(34) * len(DOUBLE_QUOTES)}')"
    for pattern, to in CANONICAL_STEPS:
        pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t})"


def sql_tokens_key(canon: str) -> str:
    """SQL of token_key."""
    t = rf"regexp_replace(replace(replace({canon}, '-', ' '), '''', ''), '\b(in [a-g](?: (?:flat|sharp))?) major\b', '\1', 'g')"
    pairs = {**NUMBER_WORDS, **{w: "and" for w in AND_WORDS}}
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
    return f"array_to_string(list_sort(list_transform(list_filter(string_split({t}, ' '), lambda w: w <> ''), lambda w: CASE w {case} ELSE w END)), ' ')"


def sql_day(x: str) -> str:
    """SQL of broadcast_day."""
    months = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS.split(), 1))
    made = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"
    part = lambda p, i: rf"try_cast(regexp_extract({x}, '{p}', {i}) AS INTEGER)"
    iso, basic, slash, words, number = DAY_FORMS
    month = rf"(CASE lower(regexp_extract({x}, '{words}', 2)) {months} END)"
    seconds = rf"CAST(regexp_extract({x}, '{number}', 1) AS BIGINT)"
    return rf"""CASE WHEN regexp_matches({x}, '{iso}') THEN {made(part(iso, 1), part(iso, 2), part(iso, 3))} WHEN regexp_matches({x}, '{basic}') THEN {made(part(basic, 1), part(basic, 2), part(basic, 3))}
 WHEN regexp_matches({x}, '{slash}') THEN {made(part(slash, 3), part(slash, 2), part(slash, 1))} WHEN regexp_matches({x}, '{words}') THEN {made(part(words, 3), month, part(words, 1))}
 WHEN regexp_matches({x}, '{number}') THEN CAST(to_timestamp(CASE WHEN abs({seconds}) >= 100000000000 THEN {seconds} // 1000 ELSE {seconds} END) AT TIME ZONE 'Europe/London' AS DATE) END"""


COMPOSER = r"regexp_replace(trim(regexp_replace(CASE WHEN regexp_matches(t.composer_line, '(?i)\(arranger\)\s*$') AND trim(split_part(t.composer, ',', 1)) <> '' THEN trim(split_part(t.composer, ',', 1)) ELSE t.composer END, '\s*\([^()]*\)\s*$', '')), '^''(.*)''$', '\1')"
AIR = rf"""nights AS (SELECT pid, {sql_day('broadcast_date')} AS bdate FROM episodes),
air AS (SELECT t.id, t.episode_pid AS pid, t.position, t.time_str, t.composer, t.composer_line, t.title, t.performers, n.bdate, year(n.bdate) AS yr,
  coalesce({sql_canonical(COMPOSER)}, '') AS ck, coalesce({sql_tokens_key(sql_canonical('t.title'))}, '') AS wk
  FROM tracks t JOIN nights n ON t.episode_pid = n.pid)"""
SEG_ONLY = rf"""seg AS (SELECT s.*, n.bdate, {sql_canonical(COMPOSER.replace('t.composer_line', "''").replace('t.composer', 's.composer_name'))} AS ck FROM segment_events s JOIN nights n ON s.episode_pid = n.pid
  WHERE s.id = (SELECT min(x.id) FROM segment_events x WHERE x.event_pid = s.event_pid))"""
SEG = f"nights AS (SELECT pid, {sql_day('broadcast_date')} AS bdate FROM episodes), {SEG_ONLY}"
SEG_WORK = f"segw AS (SELECT *, coalesce({sql_tokens_key(sql_canonical('track_title'))}, '') AS wk FROM seg)"
_P = CLOCK_FORM.replace("'", "''")
CLOCK = rf"""CASE WHEN regexp_matches(time_str, '{_P}') THEN
  (SELECT CASE WHEN h <= 23 AND m <= 59 AND s <= 59 THEN (CASE WHEN p = 'p' THEN h % 12 + 12 WHEN p = 'a' OR h = 12 THEN h % 12 ELSE h END) * 3600 + m * 60 + s END FROM (SELECT
   try_cast(regexp_extract(time_str, '{_P}', 1) AS INTEGER) AS h, try_cast(regexp_extract(time_str, '{_P}', 2) AS INTEGER) AS m, coalesce(try_cast(regexp_extract(time_str, '{_P}', 3) AS INTEGER), 0) AS s,
   lower(regexp_extract(time_str, '{_P}', 4)) AS p)) END"""
