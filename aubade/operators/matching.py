"""Pairing and duplicate detection: nights aligned to segments, works, composers and recordings that may be one."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aubade.functions.text import ascii_fold, candidate_id, canonical_key, catalogue_ref, jaccard, opus_numbers, plain_key, surname, tokens_of, work_numbers
from aubade.functions.titlekey import canonical_title, work_key
from aubade.operators.graph import components
from aubade.operators.segments import contributions, name_maps, role_rows
from aubade.session import pinned

#: Weights and costs of the alignment.
TOLERANCE_S, W_TIME, W_CONTENT, GAP = 90.0, 0.6, 0.4, 0.85
#: Columns of the alignment table that are worked at once; of no effect on results.
TILE = 1024

MATCH_SCHEMA = "episode_pid string, track_id bigint, segment_id bigint, cost double, tier string"


def pair_cost(t_s: float | None, s_s: float | None, same_surname: bool, title_share: float) -> float:
    """Cost from 0 to 1 of pairing a track and a segment."""
    content = 1.0 - (0.7 * same_surname + 0.3 * title_share)
    if t_s is None or s_s is None:
        return min(1.0, 0.15 + content)
    apart = abs(t_s - s_s)
    return W_TIME * apart / (TOLERANCE_S + apart) + W_CONTENT * content


def tier_of(cost: float, same_surname: bool, timed: bool) -> str:
    """Confidence of a pair (I3); ``timed``: both have times, no further apart than three tolerances."""
    if same_surname:
        return "high" if cost < 0.6 else "low"
    return "medium" if cost < 0.7 and timed or cost < 0.6 else "low"


def title_words(title: Column) -> Column:
    """All distinct words of a title, folded; none for a missing one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(ascii_fold(F.coalesce(title, F.lit("")))), F.lit("([a-z0-9]+)"), F.lit(1)))


class _Costs:
    """pair_cost of stretches of tracks and segments; a pair's words meet through an index of the segments' words."""

    def __init__(self, tracks: pd.DataFrame, segs: pd.DataFrame):
        codes: dict[str, int] = {}
        code = lambda names, none: np.array([codes.setdefault(x, len(codes)) if isinstance(x, str) and x else none for x in names], np.int64)
        self.t_sur, self.s_sur = code(tracks.sur, -1), code(segs.sur, -2)
        self.t_s, self.s_s = tracks.offset_s.to_numpy(np.float64, na_value=np.nan), segs.offset_s.to_numpy(np.float64, na_value=np.nan)
        self.t_words, s_words = [frozenset(w) for w in tracks.words], [frozenset(w) for w in segs.words]
        self.s_words, self.s_size = s_words, np.array([len(w) for w in s_words], np.int64)
        at: dict[str, list[int]] = {}
        for j, words in enumerate(s_words):
            for word in words:
                at.setdefault(word, []).append(j)
        self.at = {word: np.array(js, np.int64) for word, js in at.items()}

    def block(self, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
        shared = np.zeros((i1 - i0, j1 - j0))
        sizes = np.array([len(w) for w in self.t_words[i0:i1]], np.int64)
        for i, words in enumerate(self.t_words[i0:i1]):
            for word in words:
                if (js := self.at.get(word)) is not None:
                    shared[i, js if len(self.s_size) == j1 - j0 else js[np.searchsorted(js, j0) : np.searchsorted(js, j1)] - j0] += 1
        union = sizes[:, None] + self.s_size[None, j0:j1] - shared
        share = np.where(union == 0, 1.0, shared / np.maximum(union, 1))
        content = 1.0 - (0.7 * (self.t_sur[i0:i1, None] == self.s_sur[None, j0:j1]) + 0.3 * share)
        apart = np.abs(self.t_s[i0:i1, None] - self.s_s[None, j0:j1])
        return np.where(np.isnan(apart), np.minimum(1.0, 0.15 + content), W_TIME * apart / (TOLERANCE_S + apart) + W_CONTENT * content)

    def pair(self, i: int, j: int) -> tuple[float, str]:
        """Cost and tier of one pair."""
        t_s, s_s, same, union = self.t_s[i], self.s_s[j], bool(self.t_sur[i] == self.s_sur[j]), len(self.t_words[i] | self.s_words[j])
        timed = t_s == t_s and s_s == s_s
        cost = float(pair_cost(*((t_s, s_s) if timed else (None, None)), same, len(self.t_words[i] & self.s_words[j]) / union if union else 1.0))
        return cost, tier_of(cost, same, bool(timed and abs(t_s - s_s) <= 3 * TOLERANCE_S))


def _tile(cost: np.ndarray, top: np.ndarray, left: np.ndarray, steps: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The lowest row and last column of a tile of the table from its upper row and first column, by anti-diagonals."""
    h, w = cost.shape
    best, padded = np.empty((h + 1, w + 1)), np.empty((h + 1, w + 1))
    best[0], best[:, 0], padded[1:, 1:] = top, left, cost
    flat, costs = best.reshape(-1), padded.reshape(-1)
    for d in range(h + w - 1):
        lo, hi = max(0, d - w + 1), min(h - 1, d)
        first = (lo + 1) * (w + 1) + d - lo + 1
        end = first + (hi - lo) * w + 1
        skip = np.minimum(flat[first - w - 1 : end - w - 1 : w], flat[first - 1 : end - 1 : w])
        skip += GAP
        np.minimum(flat[first - w - 2 : end - w - 2 : w] + costs[first:end:w], skip, out=flat[first:end:w])
    if steps is not None:
        match, up, back = best[:-1, :-1] + cost, best[:-1, 1:] + GAP, best[1:, :-1] + GAP
        steps[:, :] = np.where(match <= np.minimum(up, back), 0, np.where(up <= back, 1, 2))
    return best[-1], best[:, -1]


def _align(key: tuple, tracks: pd.DataFrame, segs: pd.DataFrame) -> pd.DataFrame:
    """Cheapest order-keeping pairing; equal costs prefer a match, then skipping the track.

    The whole table of the night is worked. Of its costs only every ``high``-th row is kept; the way back works the rows
    between two of these again, so that memory grows with the segments and the root of the tracks.
    """
    tracks, segs = tracks.sort_values(["position", "rid"]), segs.sort_values(["position", "rid"])
    columns = ["episode_pid", "track_id", "segment_id", "cost", "tier"]
    n, m = len(tracks), len(segs)
    if not n or not m:
        return pd.DataFrame([], columns=columns)
    costs, high = _Costs(tracks, segs), max(64, int((8 * n) ** 0.5))

    def rows(i0: int, top: np.ndarray, steps: np.ndarray | None) -> np.ndarray:
        i1, low = min(n, i0 + high), np.empty(m + 1)
        left = np.arange(i0, i1 + 1) * GAP
        low[0] = left[-1]
        for j0 in range(0, m, TILE):
            j1 = min(m, j0 + TILE)
            lowest, left = _tile(costs.block(i0, i1, j0, j1), top[j0 : j1 + 1], left, None if steps is None else steps[:, j0:j1])
            low[j0 + 1 : j1 + 1] = lowest[1:]
        return low

    tops = [np.arange(m + 1) * GAP]
    for i0 in range(0, n - high, high):
        tops.append(rows(i0, tops[-1], None))
    out, i, j = [], n, m
    t_ids, s_ids = tracks.rid.tolist(), segs.rid.tolist()
    for i0 in range((len(tops) - 1) * high, -1, -high):
        steps = np.empty((min(n, i0 + high) - i0, m), np.int8)
        rows(i0, tops.pop(), steps)
        while i > i0 and j:
            step = steps[i - 1 - i0, j - 1]
            if step == 0:
                i, j = i - 1, j - 1
                out.append((key[0], t_ids[i], s_ids[j], *costs.pair(i, j)))
            elif step == 1:
                i -= 1
            else:
                j -= 1
    return pd.DataFrame(out, columns=columns)


def aligned(air: DataFrame, offsets: DataFrame, segments: DataFrame) -> DataFrame:
    """``episode_pid, track_id, segment_id, cost, tier`` of every pair in the nights' cheapest alignments.

    A night is aligned whole in one task, whatever its length; its time grows with tracks x segments.
    """
    tracks = air.join(offsets, "id", "left").select(F.col("pid").alias("episode_pid"), F.col("id").alias("rid"), "position", "offset_s", surname(F.col("composer")).alias("sur"), title_words(F.col("title")).alias("words"))
    place = F.coalesce("position", "version_offset", F.lit(0))
    # Both sides count from their own beginning: segments from the first in order that has an offset.
    begun = segments.where("version_offset is not null").groupBy("episode_pid").agg(F.min(F.struct(place.alias("p"), "id", "version_offset")).alias("b")).select("episode_pid", F.col("b.version_offset").alias("begun_s"))
    segs = segments.join(begun, "episode_pid", "left").select("episode_pid", F.col("id").alias("rid"), place.alias("position"), (F.col("version_offset") - F.col("begun_s")).alias("offset_s"), surname(F.col("composer_name")).alias("sur"), title_words(F.col("track_title")).alias("words"))
    return tracks.groupBy("episode_pid").cogroup(segs.groupBy("episode_pid")).applyInPandas(_align, MATCH_SCHEMA)


def reconciled(matches: DataFrame, air: DataFrame, segments: DataFrame) -> DataFrame:
    """``episode_pid, track_id, segment_id, recording_pid, composer_mbid, tier``: one row a track of the nights that have both sides, 'unmatched' where it has no pair."""
    sides = segments.select(F.col("episode_pid").alias("pid")).distinct()
    tracks = air.join(sides, "pid", "left_semi").select(F.col("pid").alias("episode_pid"), F.col("id").alias("track_id"))
    pairs = matches.select("track_id", "segment_id", "tier").join(segments.select(F.col("id").alias("segment_id"), "recording_pid", "composer_mbid"), "segment_id")
    return tracks.join(pairs, "track_id", "left").select("episode_pid", "track_id", "segment_id", "recording_pid", "composer_mbid", F.coalesce("tier", F.lit("unmatched")).alias("tier"))


def projection(matches: DataFrame, segments: DataFrame, tiers: tuple[str, ...] = ("high",)) -> DataFrame:
    """``track_id, recording_pid`` of trusted pairs (I4); pass both tiers for what may be shown."""
    return matches.where(F.col("tier").isin(*tiers)).join(segments.select(F.col("id").alias("segment_id"), "recording_pid"), "segment_id").where("recording_pid is not null").select("track_id", "recording_pid")


def positional(air: DataFrame, segments: DataFrame) -> DataFrame:
    """``id, recording_pid, way``: tracks (0-based) met by segments (1-based) at the next position; else the night's only segment of the composer (E5)."""
    at = segments.where("position is not null and recording_pid is not null").groupBy("episode_pid", "position").agg(F.min_by("recording_pid", "id").alias("rp"), F.min_by("ck", "id").alias("sck"))
    direct = air.join(at.select(F.col("episode_pid").alias("pid"), (F.col("position") - 1).alias("position"), "rp", "sck"), ["pid", "position"], "left")
    sole = segments.where("recording_pid is not null and ck <> ''").groupBy(F.col("episode_pid").alias("pid"), "ck").agg(F.count("*").alias("n"), F.min("recording_pid").alias("only")).where("n = 1").drop("n")
    both = direct.join(sole, ["pid", "ck"], "left")
    met = F.col("rp").isNotNull() & (F.col("sck") == F.col("ck"))
    return both.select("id", F.when(met, F.col("rp")).otherwise(F.col("only")).alias("recording_pid"), F.when(met, "position").when(F.col("only").isNotNull(), "sole").otherwise("none").alias("way"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def composer_duplicates(air: DataFrame, lives: DataFrame, spanned: float = 0.74, undated: float = 0.88, high: float = 0.82) -> DataFrame:
    """``a, b, block, ratio, level``: composers of one life span, or one surname, with like names.

    Distinct composer keys meet within a span or surname, never the airings.
    """
    names = air.where("ck <> ''").where(~F.col("ck").rlike("^(?:anon|trad|unknown)")).select("ck").distinct()
    dated = names.join(lives, "ck", "left")
    span = dated.where("born is not null").select("ck", F.concat_ws("-", "born", "died").alias("block"), F.lit("span").alias("kind"))
    last = dated.select("ck", F.element_at(F.split("ck", " "), -1).alias("block"), F.lit("surname").alias("kind")).where(F.length("block") > 2)
    blocks = span.unionByName(last)
    pairs = blocks.select(F.col("ck").alias("a"), "block", "kind").join(blocks.select(F.col("ck").alias("b"), "block", "kind"), ["block", "kind"]).where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.max("kind").alias("k1"), F.min("kind").alias("k0")).select("a", "b", F.when(F.col("k0") == "span", "span").when(F.col("k1") == "span", "span").otherwise("surname").alias("block"))
    scored = pairs.withColumn("ratio", F.round(sequence_ratio("a", "b"), 6)).where(F.when(F.col("block") == "span", F.col("ratio") >= spanned).otherwise(F.col("ratio") >= undated))
    return scored.withColumn("level", F.when(F.col("ratio") >= high, "high").otherwise("low"))


def title_facts(title: Column) -> Column:
    """struct(words, numbers, modes, opus, items) of a title: what pairs are compared by, to be read once a title and not once a pair."""
    canon = canonical_title(title)
    found = lambda p: F.array_distinct(F.regexp_extract_all(canon, F.lit(p), F.lit(1)))
    return F.struct(tokens_of(canon).alias("words"), found(r"(\d+)").alias("numbers"), found(r"\b([a-g](?: flat| sharp)? (?:major|minor))\b").alias("modes"), opus_numbers(title).alias("opus"), work_numbers(title).alias("items"))


def facts_conflict(a: str, b: str) -> Column:
    """Whether the facts of two titles disagree on numbers or key: neither side's set holds the other's."""
    apart = lambda x, y: (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)
    return apart(f"{a}.numbers", f"{b}.numbers") | apart(f"{a}.modes", f"{b}.modes")


def facts_differ(a: str, b: str, what: str) -> Column:
    """Whether both titles name numbers of a kind, and not the same ones."""
    x, y = F.col(f"{a}.{what}"), F.col(f"{b}.{what}")
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def title_conflict(a: Column, b: Column) -> Column:
    """Whether two titles disagree on numbers or key: neither side's set holds the other's."""
    x, y = title_facts(a), title_facts(b)
    apart = lambda f: (F.size(F.array_except(x[f], y[f])) > 0) & (F.size(F.array_except(y[f], x[f])) > 0)
    return apart("numbers") | apart("modes")


def work_duplicates(air: DataFrame, base: float = 0.5, low: float = 0.2, rare: int = 3) -> DataFrame:
    """``ck, a, b, share, reason``: works of one composer whose titles overlap.

    Candidates share one of the rarest words of both titles - as many as the base share requires - or a word rare with
    the composer; so frequent words of a composer with very many works never meet.
    """
    return duplicate_titles(titles_of(air), base, low, rare).select("ck", "a", "b", "share", "reason")


def work_components(air: DataFrame) -> DataFrame:
    """``id, root``: works that duplicate pairs join, and the first of each group (I10); both as ``ck|wk``.

    Groups are found over the works' numbers, so that no round carries keys.
    """
    titles = titles_of(air)
    groups = components(duplicate_titles(titles).select(F.col("na").alias("a"), F.col("nb").alias("b")))
    named = groups.join(titles.select(F.col("n").alias("id"), F.concat_ws("|", "ck", "wk").alias("key")), "id").select("root", "key")
    first = named.groupBy("root").agg(F.min("key").alias("first"))
    return named.join(first, "root").select(F.col("key").alias("id"), F.col("first").alias("root"))


def titles_of(air: DataFrame) -> DataFrame:
    """``ck, wk, facts, words, n``: all works with words in their titles, numbered."""
    titles = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.min("title").alias("title"))
    return pinned(titles.withColumn("facts", title_facts(F.col("title"))).withColumn("words", F.col("facts.words")).where("size(words) > 0").drop("title").withColumn("n", F.monotonically_increasing_id()))


def duplicate_titles(titles: DataFrame, base: float = 0.5, low: float = 0.2, rare: int = 3) -> DataFrame:
    """The pairs of ``work_duplicates``, and the numbers ``na, nb`` of both works."""
    tokens = titles.select("ck", "wk", F.explode("words").alias("word"))
    frequency = tokens.groupBy("ck", "word").agg(F.count("*").alias("df"))
    # Each title's words by rarity, and its rare ones, made once for the index and for both sides of the pairs.
    rare_word = F.when((F.col("df") <= rare) & ~F.col("word").rlike(r"^\d+$"), F.col("word"))
    listed = pinned(tokens.join(frequency, ["ck", "word"]).groupBy("ck", "wk").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("l"), F.collect_set(rare_word).alias("rare")))
    # A title's words are few; share >= base needs a common word among the first n - ceil(base * n) + 1 by rarity.
    listed = listed.withColumn("cut", (F.size("l") - F.ceil(F.lit(base) * F.size("l")) + 1).cast("int"))
    index = listed.select("ck", "wk", F.posexplode("l").alias("i", "t"), "cut").where((F.col("i") < F.col("cut")) | ((F.col("t.df") <= rare) & ~F.col("t.word").rlike(r"^\d+$"))).select("ck", "wk", F.col("t.word").alias("word"))
    pairs = index.select("ck", F.col("wk").alias("a"), "word").join(index.select("ck", F.col("wk").alias("b"), "word"), ["ck", "word"]).where("a < b").select("ck", "a", "b").distinct()
    sides = titles.join(listed.select("ck", "wk", "rare"), ["ck", "wk"])
    both = pairs
    for side in "ab":
        both = both.join(sides.select("ck", F.col("wk").alias(side), F.col("n").alias(f"n{side}"), F.col("facts").alias(f"f{side}"), F.col("rare").alias(f"r{side}")), ["ck", side])
    share = F.round(jaccard(F.col("fa.words"), F.col("fb.words"), 0.0), 6)
    shared_rare = F.arrays_overlap("ra", "rb")
    sibling = (facts_differ("fa", "fb", "opus") | facts_differ("fa", "fb", "items")) & ~shared_rare
    reason = F.when(F.col("share") >= base, "base").when((F.col("share") >= low) & shared_rare, "boost")
    return both.withColumn("share", share).where(~sibling).withColumn("reason", reason).where("reason is not null")


#: Roles that tell recordings apart.
_SOLO = "piano|violin|viola|cello|flute|oboe|clarinet|organ|harp|lute|guitar|harpsichord|soprano|alto|tenor|baritone|bass|mezzo"


def credit_sets(performers: Column) -> Column:
    """struct(conductors, soloists, ensembles, degraded): names of a performers text by role, distinct and sorted."""
    parts = F.transform(F.split(performers, r"[,;|\n]| and "), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^(\[]*)", 1)).alias("n"), F.lower(F.regexp_extract(p, r"[(\[]([^)\]]*)[)\]]", 1)).alias("r")))
    pick = lambda test: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(parts, test), lambda x: plain_key(x["n"])), lambda k: k != "")))
    return F.struct(pick(lambda x: x["r"].rlike("conductor|director")).alias("conductors"), pick(lambda x: x["r"].rlike(_SOLO)).alias("soloists"), pick(lambda x: ~x["r"].rlike(f"conductor|director|{_SOLO}")).alias("ensembles"), (~performers.contains("(")).alias("degraded"))


def text_recordings(air: DataFrame, least_dates: int = 2) -> DataFrame:
    """``ck, wk, credit_key, airings, dates, first_aired``: text airings grouped by work and sorted credits."""
    sets = air.where("ck <> '' and wk <> '' and performers <> ''").select("ck", "wk", "bdate", credit_sets(F.col("performers")).alias("c"))
    keyed = sets.withColumn("credit_key", F.array_join(F.array_sort(F.array_distinct(F.concat("c.conductors", "c.soloists", "c.ensembles"))), ";"))
    grouped = keyed.groupBy("ck", "wk", "credit_key").agg(F.count("*").alias("airings"), F.countDistinct("bdate").alias("dates"), F.min("bdate").alias("first_aired"))
    return grouped.where(F.col("dates") >= least_dates)


def pid_signatures(segments: DataFrame) -> DataFrame:
    """``rp, ck, wk, conductors, soloists, ensembles, length_s``: what a recording is known by."""
    rows = segments.where("recording_pid is not null and ck <> ''").withColumn("wk", work_key(F.col("track_title"))).where("wk <> ''")
    people = rows.select("recording_pid", "ck", "wk", F.explode(contributions(F.col("contributions_json"))).alias("c"))
    people = people.select("recording_pid", "ck", "wk", plain_key(F.col("c.name")).alias("nk"), F.lower("c.role").alias("role")).where("nk <> '' and nk <> ck").distinct()
    of = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("nk"))))
    sets = people.groupBy("recording_pid", "ck", "wk").agg(of(F.col("role").rlike("conductor")).alias("conductors"), of(F.col("role").rlike(_SOLO)).alias("soloists"), of(F.col("role").rlike("orchestra|ensemble|choir|performer")).alias("ensembles"))
    lengths = rows.groupBy("recording_pid", "ck", "wk").agg(F.max("duration_seconds").alias("length_s"))
    return lengths.join(sets, ["recording_pid", "ck", "wk"], "left")


#: Names of chamber bodies, and of orchestras, which aren't.
_CHAMBER, _ORCHESTRA = "quartet|quintet|trio|sextet|octet|duo|consort", "orchestra|philharmon|symphony|sinfoni"


def bridged(air: DataFrame, segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ck, wk, credit_key, recording_pid, tier``: text recordings met by exactly one recording of the work.

    Names stand for the id that is theirs alone, else for themselves. Conductors, or soloists, with ids on both sides of
    which none is shared veto a link. A shared id of a conductor, soloist or chamber body makes it trusted if the lengths
    agree within the larger of four minutes and a quarter, and the credits name roles or the chamber body is shared; any
    other shared name makes a candidate. ``lengths``: ``id, length_s`` of tracks.
    """
    known = name_maps(role_rows(segments)).withColumnRenamed("only_mbid", "known")
    identity = F.coalesce("mbid", "known", F.concat(F.lit("name:"), "nk"))
    sets = air.where("ck <> '' and wk <> '' and performers <> ''").join(lengths, "id", "left").select("id", "ck", "wk", "length_s", credit_sets(F.col("performers")).alias("c"))
    sets = sets.withColumn("credit_key", F.array_join(F.array_sort(F.array_distinct(F.concat("c.conductors", "c.soloists", "c.ensembles"))), ";"))
    keys = ["ck", "wk", "credit_key"]
    # Each side is written once and numbered; from then on its number stands for its long keys.
    groups = pinned(sets.groupBy(*keys).agg(F.min("c.degraded").alias("degraded"), F.median("length_s").alias("text_s"), F.collect_set("c").alias("cs")).withColumn("gid", F.monotonically_increasing_id()))
    tag = lambda x, c: F.transform(x[c], lambda n: F.struct(F.lit(c[0]).alias("kind"), n.alias("nk")))
    # Credits without roles count only where no airing of the group has any.
    counted = F.filter("cs", lambda x: x["degraded"] == F.col("degraded"))
    tagged = F.array_distinct(F.flatten(F.transform(counted, lambda x: F.concat(*(tag(x, c) for c in ("conductors", "soloists", "ensembles"))))))
    names = groups.select("gid", F.explode(tagged).alias("p")).select("gid", "p.kind", "p.nk")
    names = names.join(known, "nk", "left").withColumn("mbid", F.lit(None).cast("string")).withColumn("identity", identity)
    of = lambda test: F.collect_set(F.when(test, F.col("identity")))
    kind = F.col("kind")
    texts = names.groupBy("gid").agg(of(kind == "c").alias("tc"), of(kind == "s").alias("ts"), of(kind == "e").alias("te"), of((kind == "e") & F.col("nk").rlike(_CHAMBER) & ~F.col("nk").rlike(_ORCHESTRA)).alias("tb"))
    texts = texts.join(groups.select("gid", "ck", "wk", "degraded", "text_s"), "gid")
    rows = segments.where("recording_pid is not null and ck <> ''").select("recording_pid", "ck", "duration_seconds", work_key(F.col("track_title")).alias("wk"), contributions(F.col("contributions_json")).alias("cs")).where("wk <> ''")
    # Airings of one recording repeat their credits: each set of credits once.
    rows = rows.groupBy("recording_pid", "ck", "wk", "cs").agg(F.max("duration_seconds").alias("duration_seconds")).select("recording_pid", "ck", "wk", "duration_seconds", F.explode("cs").alias("c"))
    people = rows.select("recording_pid", "ck", "wk", "duration_seconds", F.lower("c.role").alias("role"), F.col("c.musicbrainz_gid").alias("mbid"), plain_key(F.col("c.name")).alias("nk"))
    people = people.where("nk <> '' and nk <> ck").join(known, "nk", "left").withColumn("identity", identity)
    role = F.col("role")
    signed = people.groupBy("recording_pid", "ck", "wk").agg(of(role.rlike("conductor")).alias("pc"), of(role.rlike(f"performer|singer|{_SOLO}")).alias("ps"), of(role.rlike("orchestra|ensemble|choir")).alias("pe"), F.max("duration_seconds").alias("pid_s"))
    # Sides meet in a name of one kind that they share, as a link needs one; not all recordings of a work with all of its airings.
    met = lambda **kinds: F.explode(F.concat(*(F.transform(c, lambda x, k=k: F.struct(F.lit(k).alias("kind"), x.alias("identity"))) for k, c in kinds.items()))).alias("m")
    left, right = pinned(texts), pinned(signed.withColumn("rid", F.monotonically_increasing_id()))
    place = F.xxhash64("ck", "wk", "m").alias("place")  # a first sieve; names are compared below
    meets = left.select("gid", "ck", "wk", met(c="tc", s="ts", e="te")).select("gid", place).join(right.select("rid", "ck", "wk", met(c="pc", s="ps", e="pe")).select("rid", place), "place").select("gid", "rid").distinct()
    pairs = meets.join(left.withColumnsRenamed({"ck": "t_ck", "wk": "t_wk"}), "gid").join(right, "rid").where("t_ck = ck and t_wk = wk")
    ids = lambda c: F.filter(c, lambda x: ~x.startswith("name:"))
    meet = lambda x, y: F.arrays_overlap(ids(x), ids(y))
    veto = lambda x, y: (F.size(ids(x)) > 0) & (F.size(ids(y)) > 0) & ~meet(x, y)
    chamber = meet("tb", "pe")
    told = meet("tc", "pc") | meet("ts", "ps") | chamber
    any_shared = F.arrays_overlap("tc", "pc") | F.arrays_overlap("ts", "ps") | F.arrays_overlap("te", "pe")
    near = F.col("text_s").isNull() | (F.coalesce("pid_s", F.lit(0)) == 0) | (F.abs(F.col("pid_s") - F.col("text_s")) <= F.greatest(F.lit(240.0), F.col("pid_s") * 0.25))
    tier = F.when(veto("tc", "pc") | veto("ts", "ps") | ~any_shared, None).when(told & (~F.col("degraded") | chamber) & near, "trusted").otherwise("candidate")
    scored = pairs.withColumn("tier", tier).where("tier is not null")
    # A candidate's tier sorts before a trusted one's, but only groups with one recording stay.
    best = scored.groupBy("gid").agg(F.count("*").alias("n"), F.min("recording_pid").alias("recording_pid"), F.min("tier").alias("tier")).where("n = 1")
    return groups.select("gid", *keys).join(best, "gid").select(*keys, "recording_pid", "tier")


def performer_names(performers: Column) -> Column:
    """The keys of the names in a performers text, brackets left off, also an unclosed one."""
    bare = F.regexp_replace(F.regexp_replace(performers, r"\([^)]*\)", ""), r"\([^)]*$", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, r"[,;|]| and "), canonical_key), lambda k: k != ""))


def reairing_pairs(air: DataFrame, percent: int = 55) -> DataFrame:
    """``ck, a, b, pair_id``: one-off works of a composer that may be one, by like performers, without conflict (E9, F21, pairs of I10).

    Works of one catalogue number are alike; if not both have one, titles that share ``percent`` of their words. At least
    half of the names of the side with fewer must be shared. Candidates share their number, or one of the rarest words of
    both titles - as many as the percentage requires.
    """
    single = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.count("*").alias("n"), F.min("title").alias("title"), F.min("performers").alias("performers"), F.min("bdate").alias("bdate"), F.min("pid").alias("pid")).where("n = 1")
    words = F.array_distinct(F.filter(F.split(canonical_title(F.col("title")), " "), lambda w: w != ""))
    single = pinned(single.select("ck", "wk", "title", "bdate", "pid", catalogue_ref(F.col("title")).alias("cat"), words.alias("words"), title_facts(F.col("title")).alias("facts"), performer_names(F.col("performers")).alias("names")).where("size(names) > 0"))
    tokens = single.select("ck", "wk", F.explode("words").alias("word"))
    frequency = tokens.groupBy("ck", "word").agg(F.count("*").alias("df"))
    listed = tokens.join(frequency, ["ck", "word"]).groupBy("ck", "wk").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("l"))
    # In whole numbers: n - ceil(percent * n / 100) + 1 words by rarity.
    listed = listed.withColumn("cut", F.expr(f"cast(size(l) - (size(l) * {percent} + 99) div 100 + 1 as int)"))
    index = listed.select("ck", "wk", F.explode(F.slice("l", F.lit(1), F.col("cut"))).alias("t")).select("ck", "wk", F.concat(F.lit("w"), "t.word").alias("at"))
    index = index.unionByName(single.where("cat is not null").select("ck", "wk", F.concat(F.lit("c"), "cat").alias("at")))
    pairs = index.select("ck", F.col("wk").alias("a"), "at").join(index.select("ck", F.col("wk").alias("b"), "at"), ["ck", "at"]).where("a < b").select("ck", "a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(single.select("ck", F.col("wk").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("title", "bdate", "pid", "cat", "words", "facts", "names"))), ["ck", side])
    alike = F.size(F.array_intersect("words_a", "words_b")) * 100 >= F.size(F.array_union("words_a", "words_b")) * percent
    same_work = F.when(F.col("cat_a").isNotNull() & F.col("cat_b").isNotNull(), F.col("cat_a") == F.col("cat_b")).otherwise(alike)
    shared = F.size(F.array_intersect("names_a", "names_b"))
    same_names = (shared > 0) & (shared * 2 >= F.least(F.size("names_a"), F.size("names_b")))
    apart = (F.col("pid_a") != F.col("pid_b")) & F.coalesce(F.col("bdate_a") != F.col("bdate_b"), F.lit(True))
    kept = pairs.where(same_work & same_names & apart).where(~facts_conflict("facts_a", "facts_b"))
    return kept.select("ck", "a", "b", candidate_id(F.col("title_a"), F.col("title_b")).alias("pair_id"))


def corroborated(a: Column, b: Column) -> Column:
    """Whether two names support each other: equal or contained words, or one surname."""
    x, y = F.split(plain_key(a), " "), F.split(plain_key(b), " ")
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0) | (surname(a) == surname(b))


def evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_key, new_key, shared, tier``: identities found again by the recordings they hold.

    ``old``: ``old_key, rp``; ``new``: ``new_key, rp``. Tier A is the same key, B a new key that alone holds half of the
    old one's recordings or more, D nothing.
    """
    sizes = old.distinct().groupBy("old_key").agg(F.count("*").alias("n"))
    overlap = old.distinct().join(new.distinct(), "rp").groupBy("old_key", "new_key").agg(F.count("*").alias("shared"))
    enough = overlap.join(sizes, "old_key").where(F.col("shared") >= F.ceil(F.col("n") / 2))
    unique = enough.groupBy("old_key").agg(F.count("*").alias("k"), F.min("new_key").alias("new_key"), F.min("shared").alias("shared")).where("k = 1").drop("k")
    same = new.select(F.col("new_key").alias("old_key")).distinct().withColumn("same", F.lit(True))
    rows = sizes.join(same, "old_key", "left").join(unique, "old_key", "left")
    tier = F.when(F.col("same"), "A").when(F.col("new_key").isNotNull(), "B").otherwise("D")
    return rows.select("old_key", F.when(F.col("same"), F.col("old_key")).otherwise(F.col("new_key")).alias("new_key"), F.when(F.col("same"), F.col("n")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared"), tier.alias("tier"))


def fragmentation(segments: DataFrame) -> DataFrame:
    """``ck, minority``: airings of a composer id under names other than its most frequent one."""
    counts = segments.where("composer_mbid is not null and ck <> ''").groupBy("composer_mbid", "ck").agg(F.count("*").alias("n"))
    main = counts.groupBy("composer_mbid").agg(F.min(F.struct((-F.col("n")).alias("n"), "ck")).alias("m"), F.sum("n").alias("all"))
    return main.select(F.col("m.ck").alias("ck"), (F.col("all") + F.col("m.n")).alias("minority")).groupBy("ck").agg(F.sum("minority").alias("minority")).where("minority > 0")
