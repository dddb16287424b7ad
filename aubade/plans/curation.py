"""Queries of identity filters, curator's lists and landed data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aubade.operators import curation as C
from aubade.operators import instants
from aubade.plans.common import AIR, SEG, SEG_ONLY, SEG_WORK, air, segments, sql_canonical, sql_fold, sql_key
from aubade.plans.matching import CREDIT_PARTS, SOLO_ROLES, match_bridged, sql_slug, sql_tokens
from aubade.functions import stations as B
from aubade.plans.segments import _BRC, _LAND, _ROLES, _TIDY
from aubade.sources import landed
from aubade.sources.tables import load


def cur_performer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of recordings with a performer."""
    return C.by_performer(segments(spark, sf_dir), "ribukorin").select("id", "recording_pid")


def cur_broadcaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a broadcaster."""
    return C.by_broadcaster(segments(spark, sf_dir), "qxd", private=True).select("id", "brc")


def cur_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels with their station, country and flag, those of a station with a code of the list added to the archive's."""
    known = spark.createDataFrame([(c,) for c in ("plpr ", "BERTF", "USWFMT", "QQQQQ", "CHEUR", "RSRTV", "Some label", "", None)], "record_label string")
    return C.decoded(segments(spark, sf_dir).select("record_label").unionByName(known), private=True)


def cur_interstitials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without frequent short recordings."""
    return C.without_interstitials(segments(spark, sf_dir), 3, 600).select("id")


def cur_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works meant by a phrase."""
    return C.resolve_work(air(spark, sf_dir), "night harbour")


def cur_work_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works and their spellings."""
    return C.work_index(air(spark, sf_dir))


def cur_one_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-off works by composer."""
    return C.one_offs(air(spark, sf_dir))


def cur_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words by composer."""
    return C.rare_tokens(air(spark, sf_dir))


def cur_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works under one catalogue number."""
    return C.families(air(spark, sf_dir))


def cur_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opuses that are sets."""
    return C.set_catalogues(air(spark, sf_dir))


def cur_exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work keys under several composers."""
    return C.exclusivity(air(spark, sf_dir))


def cur_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and recorded works that may be one."""
    return C.relaxed_links(air(spark, sf_dir), segments(spark, sf_dir))


def cur_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases to propose."""
    return C.alias_proposals(cur_relaxed(spark, sf_dir))


def cur_cross_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text airings that links add to recordings."""
    return C.best_recordings(match_bridged(spark, sf_dir), air(spark, sf_dir))


def cur_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductors and ensembles by night."""
    return C.name_sets(air(spark, sf_dir))


def cur_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed ensembles."""
    return C.confirmed_ensembles(air(spark, sf_dir), 3)


def landed_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a walk starts."""
    return landed.seed(instants.start_instants(load(spark, sf_dir, "episodes")), 1_500_000_000)


def landed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights reached backwards from those nobody follows."""
    rows = load(spark, sf_dir, "episodes")
    last = rows.join(rows.select(F.col("previous_pid").alias("pid")).distinct(), "pid", "left_anti")
    return landed.walk_back(rows, last.select("pid"))


def landed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights whose segments are to be asked for."""
    rows = load(spark, sf_dir, "episodes")
    return landed.gaps(rows, instants.start_instants(rows), 1_800_000_000, 1_331_769_600, retry=True)


def landed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights by outcome of the fetch."""
    return landed.outcomes(load(spark, sf_dir, "episodes"))


_NAMED = (cur_performer, cur_broadcaster, cur_labels, cur_interstitials, cur_resolve, cur_work_index, cur_one_offs, cur_rare_tokens, cur_families, cur_sets, cur_exclusivity, cur_relaxed, cur_proposals, cur_cross_era, cur_name_sets, cur_ensembles, landed_seed, landed_walk, landed_gaps, landed_outcomes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in _NAMED}

_TITLES = "ti AS (SELECT ck, wk, min(title) AS title FROM air WHERE ck <> '' AND wk <> '' AND title IS NOT NULL GROUP BY ALL)"
_REFS = rf"""list_transform(regexp_extract_all({sql_fold('lower(title)')}, '\b((?:bwv|hwv|rv|kv|k|d|twv|wq|woo|hob|s|bb|op) ?\.? ?0*\d+)', 1), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[ .]', '', 'g'), '^kv', 'k'), '^([a-z]+?)0*(\d+)$', '\1\2'))"""
_SHARE = lambda a, b: f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6)"
_SET = lambda x, p: f"list_distinct(regexp_extract_all({sql_canonical(x)}, '{p}', 1))"
_APART = lambda p: f"(len(list_filter({_SET('ta', p)}, lambda w: NOT list_contains({_SET('tb', p)}, w))) > 0 AND len(list_filter({_SET('tb', p)}, lambda w: NOT list_contains({_SET('ta', p)}, w))) > 0)"
_NUMBERS = lambda x, p: f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({x}), '{p}', 1))), ',')"
_DIFFER = lambda p: f"({_NUMBERS('ta', p)} <> '' AND {_NUMBERS('tb', p)} <> '' AND {_NUMBERS('ta', p)} <> {_NUMBERS('tb', p)})"
_RELAXED = f"""{_TITLES}, sg AS (SELECT ck, wk, min(track_title) AS title FROM segw WHERE ck <> '' AND wk <> '' AND track_title IS NOT NULL GROUP BY ALL), tx AS (SELECT * FROM ti ANTI JOIN sg USING (ck, wk)),
tt AS (SELECT ck, wk, title AS ta, {sql_tokens('title')} AS wa FROM tx), ss AS (SELECT ck, wk, title AS tb, {sql_tokens('title')} AS wb FROM sg),
rl AS (SELECT tt.ck, tt.wk AS text_wk, ss.wk AS seg_wk, ta, tb, {_SHARE('wa', 'wb')} AS share FROM tt JOIN ss ON tt.ck = ss.ck AND tt.wk <> ss.wk WHERE len(wa) > 0 AND len(wb) > 0),
relaxed AS (SELECT ck, text_wk, seg_wk, share, CASE WHEN {_DIFFER(chr(92) + 'bop' + chr(92) + '.? ?(' + chr(92) + 'd+)')} THEN 'opus' WHEN {_DIFFER(chr(92) + 'bno' + chr(92) + '.? ?(' + chr(92) + 'd+)')} THEN 'number'
 WHEN {_APART('(' + chr(92) + 'd+)')} OR {_APART(chr(92) + 'b([a-g](?: flat| sharp)? (?:major|minor))' + chr(92) + 'b')} THEN 'key' ELSE 'fold' END AS reason FROM rl WHERE share >= 0.5)"""
ORACLES: dict[str, str] = {
    "cur_relaxed": f"WITH {AIR}, {SEG_ONLY}, {SEG_WORK}, {_RELAXED} SELECT * FROM relaxed",
    "cur_proposals": f"""WITH {AIR}, {SEG_ONLY}, {SEG_WORK}, {_RELAXED}, best AS (SELECT ck, text_wk AS variant, list(seg_wk ORDER BY share DESC, seg_wk DESC)[1] AS preferred FROM relaxed WHERE reason = 'fold' GROUP BY ALL)
SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.ck = b.ck AND x.preferred = b.variant)""",
    "cur_resolve": f"""WITH {AIR}, w AS (SELECT ck, wk, count(*) AS airings, min(title) AS title, max(CAST(contains({sql_key('title')}, 'night harbour') AS INTEGER)) AS holds FROM air WHERE ck <> '' AND wk <> '' AND title IS NOT NULL GROUP BY ALL),
n AS (SELECT *, {sql_slug("concat_ws(' ', ck, title)")} AS slug, len(list_intersect({sql_tokens('title')}, ['harbour', 'night'])) AS shared FROM w),
g AS (SELECT *, CASE WHEN slug = 'night harbour' THEN 3 WHEN holds = 1 THEN 2 WHEN shared > 0 THEN 1 ELSE 0 END AS grade FROM n), t AS (SELECT max(grade) AS top FROM g)
SELECT ck, wk, slug, airings, CASE grade WHEN 3 THEN 'slug' WHEN 2 THEN 'spelling' ELSE 'near' END AS how FROM g, t WHERE grade = top AND grade > 1
UNION ALL SELECT * FROM (SELECT ck, wk, slug, airings, 'near' FROM g, t WHERE top = 1 AND grade = 1 ORDER BY shared DESC, airings DESC, slug LIMIT 5)""",
    "cur_families": rf"""WITH {AIR}, {_TITLES}, f AS (SELECT ck, wk, unnest(list_distinct(list_concat({_REFS}, list_transform(regexp_extract_all(lower(title), '\bop\.? ?(\d+)', 1), lambda x: concat('op', x))))) AS family FROM ti)
SELECT ck, family, count(*) AS members FROM f GROUP BY ALL""",
    "cur_ensembles": f"WITH {AIR}, {CREDIT_PARTS} SELECT nk AS name, count(DISTINCT id) AS tracks FROM cp WHERE nk <> '' AND NOT regexp_matches(role, 'conductor|director|{SOLO_ROLES}') GROUP BY nk HAVING count(DISTINCT id) >= 3",
    "cur_name_sets": f"""WITH {AIR}, {CREDIT_PARTS}, k AS (SELECT pid, nk, regexp_matches(role, 'conductor|director') AS c, NOT regexp_matches(role, 'conductor|director|{SOLO_ROLES}') AS e FROM cp WHERE nk <> '')
SELECT pid, count(DISTINCT CASE WHEN c THEN nk END) AS conductors, count(DISTINCT CASE WHEN e THEN nk END) AS ensembles FROM k WHERE c OR e GROUP BY pid""",
    "cur_performer": f"""WITH {SEG}, {_ROLES}, h AS (SELECT DISTINCT identity FROM ident WHERE nk LIKE '%ribukorin%')
SELECT id, recording_pid FROM seg WHERE recording_pid IN (SELECT recording_pid FROM ident WHERE identity IN (SELECT identity FROM h) AND recording_pid IS NOT NULL)""",
    "cur_broadcaster": f"WITH {SEG}, b AS (SELECT *, {_BRC} AS brc FROM seg) SELECT id, brc FROM b WHERE brc IN (SELECT brc FROM b WHERE upper(record_label) LIKE '%QXD%')",
    "cur_labels": f"""WITH {SEG}, l AS (SELECT DISTINCT record_label FROM (SELECT record_label FROM seg UNION ALL SELECT unnest(['plpr ', 'BERTF', 'USWFMT', 'QQQQQ', 'CHEUR', 'RSRTV', 'Some label', '', NULL])))
SELECT record_label, {_BRC} AS code, coalesce(map([{", ".join(f"'{c}'" for c in B.CODES)}], [{", ".join("'" + B.SHOWN.get(c, n).replace("'", "''") + "'" for c, (n, _, _) in B.CODES.items())}])[{_TIDY}], record_label) AS station, {_LAND} AS country,
 coalesce(map([{", ".join(f"'{c}'" for c in B.CODES)}], [{", ".join("'" + ("" if cc in B.NO_FLAG or n in B.NO_FLAG_NAMES else "".join(chr(0x1F1E6 + ord(x) - 65) for x in cc)) + "'" for _, cc, n in B.CODES.values())}])[{_TIDY}], '') AS flag,
 CASE {_LAND} WHEN '(multilateral)' THEN '{B.NOTES["(multilateral)"]}' ELSE '' END AS note FROM l""",
    "cur_interstitials": f"""WITH {SEG}, o AS (SELECT recording_pid FROM seg WHERE recording_pid IS NOT NULL GROUP BY 1 HAVING count(DISTINCT episode_pid) >= 3 AND max(duration_seconds) <= 600)
SELECT id FROM seg WHERE recording_pid IS NULL OR recording_pid NOT IN (SELECT recording_pid FROM o)""",
    "cur_work_index": f"WITH {AIR} SELECT ck, wk, count(*) AS airings, count(DISTINCT title) AS spellings FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL",
    "cur_one_offs": f"WITH {AIR}, w AS (SELECT ck, wk, count(*) AS n FROM air WHERE ck <> '' AND wk <> '' GROUP BY ALL) SELECT ck, count(*) AS works FROM w WHERE n = 1 GROUP BY ck",
    "cur_rare_tokens": f"WITH {AIR}, {_TITLES}, t AS (SELECT ck, unnest({sql_tokens('title')}) AS word FROM ti) SELECT ck, word, count(*) AS works FROM t GROUP BY ALL HAVING count(*) <= 2",
    "cur_sets": rf"""WITH {AIR}, {_TITLES}, o AS (SELECT ck, title, unnest(list_distinct(regexp_extract_all(lower(title), '\bop\.? ?(\d+)', 1))) AS family FROM ti),
n AS (SELECT ck, family, unnest(list_distinct(regexp_extract_all(lower(title), '\bno\.? ?(\d+)', 1))) AS number FROM o) SELECT ck, family, count(DISTINCT number) AS numbers FROM n GROUP BY ALL HAVING count(DISTINCT number) >= 3""",
    "cur_exclusivity": f"WITH {AIR} SELECT wk, count(DISTINCT ck) AS composers FROM air WHERE ck <> '' AND wk <> '' GROUP BY wk HAVING count(DISTINCT ck) > 1",
    "landed_walk": """WITH RECURSIVE e AS (SELECT pid, min(previous_pid) AS prev FROM episodes WHERE previous_pid IS NOT NULL AND previous_pid <> pid GROUP BY pid),
a AS (SELECT pid FROM episodes WHERE pid NOT IN (SELECT previous_pid FROM episodes WHERE previous_pid IS NOT NULL)),
w AS (SELECT pid AS anchor, pid, CAST(0 AS BIGINT) AS steps FROM a UNION ALL SELECT anchor, e.prev, steps + 1 FROM w JOIN e ON w.pid = e.pid WHERE steps < 100000)
SELECT anchor, pid, min(steps) AS steps FROM w GROUP BY ALL""",
    "landed_outcomes": "SELECT CASE WHEN segments_raw_json IS NOT NULL THEN 'present' WHEN segments_fetched_at IS NOT NULL THEN 'absent' ELSE 'unfetched' END AS status, count(*) AS nights FROM episodes GROUP BY 1",
}
