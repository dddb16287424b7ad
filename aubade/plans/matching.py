"""Queries of pairing and duplicate detection, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.functions import text as X
from aubade.operators import graph as G
from aubade.operators import instants as I
from aubade.operators import matching as M
from aubade.operators import ranking as R
from aubade.operators import temporal as T
from aubade.session import pinned
from aubade.plans.common import AIR, SEG, SEG_ONLY, SEG_WORK, air, segments, sql_canonical, sql_fold, sql_key
from aubade.sources.tables import load


def match_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-keeping alignment of all nights."""
    rows = pinned(air(spark, sf_dir).select("id", "pid", "position", "composer", "title"))
    segs = pinned(segments(spark, sf_dir).select("id", "episode_pid", "position", "version_offset", "composer_name", "track_title"))
    clocks = I.track_instants(load(spark, sf_dir, "tracks"), load(spark, sf_dir, "episodes"), undated=True)
    return M.aligned(rows, T.instant_offsets(rows, clocks), segs)


def match_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of confidently aligned tracks."""
    return M.projection(match_aligned(spark, sf_dir), segments(spark, sf_dir))


def match_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every track of a night with segments."""
    return M.reconciled(match_aligned(spark, sf_dir), air(spark, sf_dir), segments(spark, sf_dir))


def match_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by position or as the night's only one of the composer."""
    return M.positional(air(spark, sf_dir), segments(spark, sf_dir))


def match_composer_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers that may be one."""
    rows = air(spark, sf_dir)
    return M.composer_duplicates(rows, R.composer_lives(rows))


def match_work_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that may be one."""
    return M.work_duplicates(air(spark, sf_dir))


def match_work_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of works joined by duplicate pairs."""
    return M.work_components(air(spark, sf_dir))


def match_text_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text airings of one work and set of credits."""
    return M.text_recordings(air(spark, sf_dir), 1)


def match_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recordings are known by."""
    told = [F.coalesce(F.array_join(c, ";"), F.lit("")).alias(c) for c in ("conductors", "soloists", "ensembles")]
    return M.pid_signatures(segments(spark, sf_dir)).select("recording_pid", "ck", "wk", *told, "length_s")


def match_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text recordings met by one recording. Airings and segments are read several times, so they are made once."""
    rows = pinned(air(spark, sf_dir).select("id", "pid", "position", "ck", "wk", "performers"))
    segs = pinned(segments(spark, sf_dir).select("id", "episode_pid", "recording_pid", "ck", "duration_seconds", "track_title", "contributions_json"))
    clocks = I.track_instants(load(spark, sf_dir, "tracks"), load(spark, sf_dir, "episodes"), undated=True)
    return M.bridged(rows, segs, T.instant_lengths(rows, clocks))


def match_reairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-off works that may be re-airings of each other."""
    return M.reairing_pairs(air(spark, sf_dir))


def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composer keys before 2020 found again from 2020 on by their recordings."""
    rows = segments(spark, sf_dir).where("recording_pid is not null and ck <> '' and bdate is not null")
    old = rows.where("year(bdate) < 2020").select(F.col("ck").alias("old_key"), F.col("recording_pid").alias("rp"))
    return M.evidence(old, rows.where("year(bdate) >= 2020").select(F.col("ck").alias("new_key"), F.col("recording_pid").alias("rp")))


def match_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airings under minority names."""
    return M.fragmentation(segments(spark, sf_dir))


def match_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned pairs, and whether their names support each other."""
    rows, segs = air(spark, sf_dir), segments(spark, sf_dir)
    pairs = match_aligned(spark, sf_dir).join(rows.select(F.col("id").alias("track_id"), "composer"), "track_id").join(segs.select(F.col("id").alias("segment_id"), "composer_name"), "segment_id")
    return pairs.select("track_id", "segment_id", "tier", F.coalesce(M.corroborated(F.col("composer"), F.col("composer_name")), F.lit(False)).alias("supported"))


def alias_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode neighbours as an alias table: every chain of next nights followed to its end."""
    rows = load(spark, sf_dir, "episodes").where("next_pid is not null").select(F.col("pid").alias("variant"), F.col("next_pid").alias("preferred"))
    return G.resolved(rows)


def alias_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained and unused aliases of episode parents."""
    rows = load(spark, sf_dir, "episodes")
    return G.alias_health(rows.where("next_pid is not null").select(F.col("pid").alias("variant"), F.col("next_pid").alias("preferred")), load(spark, sf_dir, "tracks").select(F.col("episode_pid").alias("variant")))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical key, tokens, opus and numbers of every distinct title."""
    titles = load(spark, sf_dir, "tracks").where("title is not null").select("title").distinct()
    t = F.col("title")
    join = lambda a: F.array_join(a, ",")
    return titles.select("title", X.canonical_key(t).alias("key"), join(X.significant_tokens(t)).alias("tokens"), join(X.opus_numbers(t)).alias("opus"), join(X.work_numbers(t)).alias("numbers"), join(X.key_signatures(t)).alias("keys"), join(X.catalogue_refs(t)).alias("refs"), X.slug(t).alias("slug"))


def text_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surname, slug and short id of every distinct composer."""
    names = load(spark, sf_dir, "tracks").where("composer is not null").select("composer").distinct()
    return names.select("composer", X.surname(F.col("composer")).alias("surname"), X.slug(F.col("composer")).alias("slug"), X.candidate_id(F.col("composer"), F.lit("x")).alias("pair_id"))


_NAMED = (match_aligned, match_projection, match_reconciled, match_positional, match_composer_duplicates, match_work_duplicates, match_work_components, match_text_recordings, match_signatures, match_bridged, match_reairings, match_evidence, match_fragmentation, match_corroborated, alias_resolved, alias_health, text_keys, text_surnames)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}


def sql_tokens(x: str) -> str:
    """SQL of significant_tokens."""
    words = ", ".join(f"'{w}'" for w in X.GENERIC_WORDS)
    return f"list_sort(list_distinct(list_filter(string_split({sql_canonical(x)}, ' '), lambda w: w <> '' AND NOT list_contains([{words}], w))))"


def sql_slug(x: str) -> str:
    """SQL of slug."""
    base = f"replace(substr({sql_key(x)}, 1, 60), ' ', '-')"
    return f"CASE WHEN {base} = '' THEN concat('x-', substr(sha1({x}), 1, 8)) ELSE regexp_replace({base}, '-+$', '') END"


def _found(x: str, pattern: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({x}), '{pattern}', 1))), ',')"


_SURNAME = rf"trim(regexp_replace({sql_key('composer')}, ' (jr|sr|i|ii|iii|the elder|the younger)$', ''))"
_DUP = f"""ti AS (SELECT ck, wk, min(title) AS title FROM air WHERE ck <> '' AND wk <> '' AND title IS NOT NULL GROUP BY ALL),
tw AS (SELECT *, {sql_tokens('title')} AS words FROM ti),
tk AS (SELECT ck, wk, unnest(words) AS word FROM tw), df AS (SELECT ck, word, count(*) AS df FROM tk GROUP BY ALL),
rw AS (SELECT ck, wk, list(word) AS rare FROM tk JOIN df USING (ck, word) WHERE df <= 3 AND NOT regexp_matches(word, '^\\d+$') GROUP BY ALL)"""
_LISTS = {"opus": r"\bop\.? ?(\d+)", "numbers": r"\bno\.? ?(\d+)"}
_DIFFER = " OR ".join(f"({_found('a.title', p)} <> '' AND {_found('b.title', p)} <> '' AND {_found('a.title', p)} <> {_found('b.title', p)})" for p in _LISTS.values())

_NAME = sql_key(r"trim(regexp_extract(p, '^([^(\[]*)', 1))")
#: Credits of performers texts as rows, as credit_sets.
CREDIT_PARTS = rf"""cs AS (SELECT id, pid, ck, wk, bdate, unnest(string_split_regex(performers, '[,;|\n]| and ')) AS p FROM air WHERE performers <> ''),
cp AS (SELECT id, pid, ck, wk, bdate, {_NAME} AS nk, lower(regexp_extract(p, '[(\[]([^)\]]*)[)\]]', 1)) AS role FROM cs)"""
SOLO_ROLES = M._SOLO

ORACLES: dict[str, str] = {
    "match_signatures": f"""WITH {SEG}, {SEG_WORK}, raw AS (SELECT id, CASE WHEN trim(contributions_json) LIKE '{{%' THEN concat('[', contributions_json, ']') ELSE contributions_json END AS j FROM segw WHERE contributions_json IS NOT NULL),
cells AS (SELECT id, unnest(from_json(j, '["JSON"]')) AS c FROM raw WHERE json_valid(j)), named AS (SELECT id, {sql_key("json_extract_string(c, '$.name')")} AS nk, lower(json_extract_string(c, '$.role')) AS role FROM cells),
base AS (SELECT * FROM segw WHERE recording_pid IS NOT NULL AND ck <> '' AND wk <> ''), people AS (SELECT DISTINCT recording_pid, ck, wk, nk, role FROM base JOIN named USING (id) WHERE nk <> '' AND nk <> ck),
sets AS (SELECT recording_pid, ck, wk, list(DISTINCT nk) FILTER (regexp_matches(role, 'conductor')) AS c, list(DISTINCT nk) FILTER (regexp_matches(role, '{SOLO_ROLES}')) AS s, list(DISTINCT nk) FILTER (regexp_matches(role, 'orchestra|ensemble|choir|performer')) AS e FROM people GROUP BY ALL),
lengths AS (SELECT recording_pid, ck, wk, max(duration_seconds) AS length_s FROM base GROUP BY ALL)
SELECT l.recording_pid, l.ck, l.wk, coalesce(array_to_string(list_sort(c), ';'), '') AS conductors, coalesce(array_to_string(list_sort(s), ';'), '') AS soloists, coalesce(array_to_string(list_sort(e), ';'), '') AS ensembles, length_s FROM lengths l LEFT JOIN sets USING (recording_pid, ck, wk)""",
    "match_text_recordings": f"""WITH {AIR}, {CREDIT_PARTS}, k AS (SELECT id, ck, wk, bdate, coalesce(array_to_string(list_sort(list(DISTINCT nk) FILTER (nk <> '')), ';'), '') AS credit_key FROM cp WHERE ck <> '' AND wk <> '' GROUP BY ALL)
SELECT ck, wk, credit_key, count(*) AS airings, count(DISTINCT bdate) AS dates, min(bdate) AS first_aired FROM k GROUP BY ALL HAVING count(DISTINCT bdate) >= 1""",
    "match_positional": f"""WITH {AIR}, {SEG_ONLY},
atp AS (SELECT episode_pid AS pid, position - 1 AS position, list(recording_pid ORDER BY id)[1] AS rp, list(ck ORDER BY id)[1] AS sck FROM seg WHERE position IS NOT NULL AND recording_pid IS NOT NULL GROUP BY ALL),
sole AS (SELECT episode_pid AS pid, ck, min(recording_pid) AS only_rp FROM seg WHERE recording_pid IS NOT NULL AND ck <> '' GROUP BY ALL HAVING count(*) = 1)
SELECT id, CASE WHEN rp IS NOT NULL AND sck = air.ck THEN rp ELSE only_rp END AS recording_pid, CASE WHEN rp IS NOT NULL AND sck = air.ck THEN 'position' WHEN only_rp IS NOT NULL THEN 'sole' ELSE 'none' END AS way
FROM air LEFT JOIN atp ON air.pid = atp.pid AND air.position = atp.position LEFT JOIN sole ON air.pid = sole.pid AND air.ck = sole.ck""",
    "match_work_duplicates": f"""WITH {AIR}, {_DUP}, p AS (SELECT a.ck, a.wk AS a, b.wk AS b, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS share,
 coalesce(list_has_any(ra.rare, rb.rare), false) AS rare, ({_DIFFER}) AS differ
 FROM tw a JOIN tw b ON a.ck = b.ck AND a.wk < b.wk LEFT JOIN rw ra ON ra.ck = a.ck AND ra.wk = a.wk LEFT JOIN rw rb ON rb.ck = b.ck AND rb.wk = b.wk WHERE len(a.words) > 0 AND len(b.words) > 0)
SELECT ck, a, b, share, CASE WHEN share >= 0.5 THEN 'base' ELSE 'boost' END AS reason FROM p WHERE (share >= 0.5 OR (share >= 0.2 AND rare)) AND NOT (differ AND NOT rare)""",
    "match_evidence": f"""WITH {SEG}, r AS (SELECT ck, recording_pid AS rp, year(bdate) AS y FROM seg WHERE recording_pid IS NOT NULL AND ck <> '' AND bdate IS NOT NULL),
o AS (SELECT DISTINCT ck AS old_key, rp FROM r WHERE y < 2020), w AS (SELECT DISTINCT ck AS new_key, rp FROM r WHERE y >= 2020), n AS (SELECT old_key, count(*) AS n FROM o GROUP BY 1),
e AS (SELECT old_key, new_key, count(*) AS shared FROM o JOIN w USING (rp) GROUP BY ALL), k AS (SELECT old_key, min(new_key) AS new_key, min(shared) AS shared FROM e JOIN n USING (old_key) WHERE shared >= ceil(n / 2) GROUP BY 1 HAVING count(*) = 1)
SELECT old_key, CASE WHEN s THEN old_key ELSE k.new_key END AS new_key, CASE WHEN s THEN n ELSE coalesce(shared, 0) END AS shared, CASE WHEN s THEN 'A' WHEN k.new_key IS NOT NULL THEN 'B' ELSE 'D' END AS tier
FROM (SELECT *, old_key IN (SELECT new_key FROM w) AS s FROM n) LEFT JOIN k USING (old_key)""",
    "match_fragmentation": f"""WITH {SEG}, c AS (SELECT composer_mbid, ck, count(*) AS n FROM seg WHERE composer_mbid IS NOT NULL AND ck <> '' GROUP BY ALL),
m AS (SELECT composer_mbid, list(ck ORDER BY n DESC, ck)[1] AS ck, sum(n) - max(n) AS minority FROM c GROUP BY 1) SELECT ck, CAST(sum(minority) AS BIGINT) AS minority FROM m GROUP BY ck HAVING sum(minority) > 0""",
    "alias_resolved": """WITH RECURSIVE e AS (SELECT pid AS variant, min(next_pid) AS preferred FROM episodes WHERE next_pid IS NOT NULL AND next_pid <> pid GROUP BY pid),
walk AS (SELECT variant, preferred, 1 AS depth FROM e UNION ALL SELECT walk.variant, e.preferred, depth + 1 FROM walk JOIN e ON walk.preferred = e.variant WHERE depth < 100000)
SELECT variant, list(preferred ORDER BY depth DESC)[1] AS preferred FROM walk GROUP BY variant""",
    "alias_health": """WITH a AS (SELECT pid AS variant, next_pid AS preferred FROM episodes WHERE next_pid IS NOT NULL)
SELECT (SELECT count(*) FROM a WHERE preferred IN (SELECT variant FROM a)) AS chained, (SELECT count(*) FROM a WHERE variant NOT IN (SELECT episode_pid FROM tracks WHERE episode_pid IS NOT NULL)) AS dead""",
    "text_keys": rf"""WITH d AS (SELECT DISTINCT title FROM tracks WHERE title IS NOT NULL) SELECT title, {sql_canonical('title')} AS key, array_to_string({sql_tokens('title')}, ',') AS tokens, {_found('title', _LISTS['opus'])} AS opus, {_found('title', _LISTS['numbers'])} AS numbers,
 {_found('title', r'\bin ([a-g](?: flat| sharp)? (?:major|minor))\b')} AS keys, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({sql_fold('lower(title)')}, '\b((?:bwv|hwv|rv|kv|k|d|twv|wq|woo|hob|s|bb|op) ?\.? ?0*\d+)', 1), lambda x: regexp_replace(regexp_replace(x, '[ .]', '', 'g'), '^([a-z]+?)0*(\d+)$', '\1\2')))), ',') AS refs, {sql_slug('title')} AS slug FROM d""",
    "text_surnames": f"""WITH d AS (SELECT DISTINCT composer FROM tracks WHERE composer IS NOT NULL) SELECT composer, CASE WHEN starts_with({_SURNAME}, 'anon') THEN 'anonymous' WHEN starts_with({_SURNAME}, 'trad') THEN 'traditional' ELSE list_last(string_split({_SURNAME}, ' ')) END AS surname,
 {sql_slug('composer')} AS slug, substr(sha1(concat(least(composer, 'x'), chr(0), greatest(composer, 'x'))), 1, 8) AS pair_id FROM d""",
}
