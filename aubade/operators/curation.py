"""Filters by identity and lists for a curator: resolution of a phrase, advisories, relaxed links, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aubade.functions.stations import broadcaster, country, flag, note, station
from aubade.functions.text import catalogue_refs, opus_numbers, plain_key, slug, tokens_of, work_numbers
from aubade.functions.titlekey import canonical_title
from aubade.operators import matching as M
from aubade.operators import segments as S
from aubade.session import pinned


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, i: F.when((i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)), F.greatest(best, i)).otherwise(best))


def decoded(labels: DataFrame, private: bool = False) -> DataFrame:
    """``record_label, code, station, country, flag, note`` of each distinct label."""
    label = F.col("record_label")
    where = country(label, private)
    return labels.select("record_label").distinct().select("record_label", broadcaster(label, private).alias("code"), station(label).alias("station"), where.alias("country"), flag(label).alias("flag"), note(where).alias("note"))


def by_performer(segments: DataFrame, phrase: str) -> DataFrame:
    """Segments of all recordings that credit an identity of which any spelling holds the phrase."""
    roles = S.identified(S.role_rows(segments))
    hit = roles.where(F.col("nk").contains(phrase.lower())).select("identity").distinct()
    pids = roles.join(hit, "identity", "left_semi").where("recording_pid is not null").select("recording_pid").distinct()
    return segments.join(pids, "recording_pid", "left_semi")


def by_broadcaster(segments: DataFrame, phrase: str, private: bool = False) -> DataFrame:
    """Segments of broadcasters of whom any label holds the phrase."""
    hit = segments.where(F.upper(F.col("record_label")).contains(phrase.upper())).select(broadcaster(F.col("record_label"), private).alias("brc")).distinct()
    return segments.withColumn("brc", broadcaster(F.col("record_label"), private)).join(hit, "brc", "left_semi")


def without_interstitials(segments: DataFrame, least_nights: int, longest_s: int = 60) -> DataFrame:
    """Segments without the short recordings that come back on many nights."""
    often = segments.where("recording_pid is not null").groupBy("recording_pid").agg(F.countDistinct("episode_pid").alias("nights"), F.max("duration_seconds").alias("longest"))
    return segments.join(often.where((F.col("nights") >= least_nights) & (F.col("longest") <= longest_s)), "recording_pid", "left_anti")


def resolve_work(air: DataFrame, phrase: str, near: int = 5) -> DataFrame:
    """``ck, wk, slug, airings, how``: works meant by a phrase - exact slug, else a spelling that holds it, else the likeliest by shared words."""
    works = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.count("*").alias("airings"), F.min("title").alias("title"), F.max(plain_key(F.col("title")).contains(" ".join(phrase.lower().split())).cast("int")).alias("holds"))
    named = works.withColumn("slug", slug(F.concat_ws(" ", "ck", "title")))
    wanted = F.array(*(F.lit(w) for w in sorted(set(phrase.lower().split()))))
    shared = F.size(F.array_intersect(tokens_of(canonical_title(F.col("title"))), wanted))
    graded = named.withColumn("grade", F.when(F.col("slug") == phrase, 3).when(F.col("holds") == 1, 2).when(shared > 0, 1).otherwise(0)).withColumn("shared", shared)
    top = graded.agg(F.max("grade").alias("top"))
    kept = graded.crossJoin(top).where((F.col("grade") == F.col("top")) & (F.col("grade") > 0))
    strict = kept.where("top > 1")
    loose = kept.where("top = 1").orderBy(F.col("shared").desc(), F.col("airings").desc(), "slug").limit(near)
    how = F.element_at(F.array(F.lit("near"), F.lit("spelling"), F.lit("slug")), F.col("grade"))
    return strict.unionByName(loose).select("ck", "wk", "slug", "airings", how.alias("how"))


def work_index(air: DataFrame) -> DataFrame:
    """``ck, wk, airings, spellings``: works with how many spellings they have."""
    return air.where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.count("*").alias("airings"), F.countDistinct("title").alias("spellings"))


def one_offs(air: DataFrame) -> DataFrame:
    """``ck, works``: how many works of a composer were aired once."""
    return air.where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.count("*").alias("n")).where("n = 1").groupBy("ck").agg(F.count("*").alias("works"))


def rare_tokens(air: DataFrame, most: int = 2) -> DataFrame:
    """``ck, word, works``: words in few of a composer's works."""
    titles = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.min("title").alias("title"))
    return titles.select("ck", F.explode(tokens_of(canonical_title(F.col("title")))).alias("word")).groupBy("ck", "word").agg(F.count("*").alias("works")).where(F.col("works") <= most)


def families(air: DataFrame) -> DataFrame:
    """``ck, family, members``: works of a composer under one catalogue number or opus."""
    titles = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.min("title").alias("title"))
    tags = F.array_distinct(F.concat(catalogue_refs(F.col("title")), F.transform(opus_numbers(F.col("title")), lambda x: F.concat(F.lit("op"), x))))
    return titles.select("ck", "wk", F.explode(tags).alias("family")).groupBy("ck", "family").agg(F.count("*").alias("members"))


def set_catalogues(air: DataFrame, least: int = 3) -> DataFrame:
    """``ck, family, numbers``: catalogue numbers or opuses whose works carry several numbers - sets, not one work."""
    titles = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.min("title").alias("title"))
    rows = titles.select("ck", "title", F.explode(opus_numbers(F.col("title"))).alias("family")).select("ck", "family", F.explode(work_numbers(F.col("title"))).alias("number"))
    return rows.groupBy("ck", "family").agg(F.countDistinct("number").alias("numbers")).where(F.col("numbers") >= least)


def exclusivity(air: DataFrame) -> DataFrame:
    """``wk, composers``: work keys under several composers."""
    return air.where("ck <> '' and wk <> ''").groupBy("wk").agg(F.countDistinct("ck").alias("composers")).where("composers > 1")


def relaxed_links(air: DataFrame, segments: DataFrame, least: float = 0.5) -> DataFrame:
    """``ck, text_wk, seg_wk, share, reason``: text works and recorded works of one composer under different keys whose titles overlap, with the first reason not to fold them.

    Titles meet in the rarest words that a share of ``least`` needs, not in frequent ones.
    """
    text = air.where("ck <> '' and wk <> '' and title is not null").groupBy("ck", "wk").agg(F.min("title").alias("title"))
    seg = S.with_work(segments).where("ck <> '' and wk <> '' and track_title is not null").groupBy("ck", "wk").agg(F.min("track_title").alias("title"))
    text = text.join(seg.select("ck", "wk"), ["ck", "wk"], "left_anti")
    sides = pinned(text.withColumn("side", F.lit("t")).unionByName(seg.withColumn("side", F.lit("s"))).select("ck", "wk", "side", M.title_facts(F.col("title")).alias("facts")))
    tokens = sides.select("ck", "wk", "side", F.explode("facts.words").alias("word"))
    frequency = tokens.groupBy("ck", "word").agg(F.count("*").alias("df"))
    listed = tokens.join(frequency, ["ck", "word"]).groupBy("ck", "wk", "side").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("l"))
    index = pinned(listed.select("ck", "wk", "side", F.explode(F.slice("l", F.lit(1), (F.size("l") - F.ceil(F.lit(least) * F.size("l")) + 1).cast("int"))).alias("t")).select("ck", "wk", "side", F.col("t.word").alias("word")))
    pairs = index.where("side = 't'").select("ck", F.col("wk").alias("text_wk"), "word").join(index.where("side = 's'").select("ck", F.col("wk").alias("seg_wk"), "word"), ["ck", "word"]).where("text_wk <> seg_wk").select("ck", "text_wk", "seg_wk").distinct()
    of = lambda side, wk, facts: sides.where(F.col("side") == side).select("ck", F.col("wk").alias(wk), F.col("facts").alias(facts))
    named = pairs.join(of("t", "text_wk", "fa"), ["ck", "text_wk"]).join(of("s", "seg_wk", "fb"), ["ck", "seg_wk"])
    share = F.round(M.jaccard(F.col("fa.words"), F.col("fb.words"), 0.0), 6)
    reason = F.when(M.facts_differ("fa", "fb", "opus"), "opus").when(M.facts_differ("fa", "fb", "items"), "number").when(M.facts_conflict("fa", "fb"), "key").otherwise("fold")
    return named.withColumn("share", share).where(F.col("share") >= least).select("ck", "text_wk", "seg_wk", "share", reason.alias("reason"))


def alias_proposals(links: DataFrame) -> DataFrame:
    """``ck, variant, preferred``: foldable links as chain-free aliases, each variant to its best target (I8)."""
    best = links.where("reason = 'fold'").groupBy("ck", "text_wk").agg(F.max(F.struct("share", "seg_wk")).alias("b")).select("ck", F.col("text_wk").alias("variant"), F.col("b.seg_wk").alias("preferred"))
    return best.join(best.select("ck", F.col("preferred").alias("variant")), ["ck", "variant"], "left_anti")


def without_rejected(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs ``a, b`` without those a ledger rejects, in either order."""
    tidy = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(tidy, ["a", "b"], "left_anti")


def best_recordings(bridged: DataFrame, air: DataFrame) -> DataFrame:
    """``recording_pid, airings, first_aired``: text airings that bridged links add to recordings."""
    keyed = air.where("ck <> '' and wk <> '' and performers <> ''").select("ck", "wk", "bdate", M.credit_sets(F.col("performers")).alias("c"))
    keyed = keyed.withColumn("credit_key", F.array_join(F.array_sort(F.array_distinct(F.concat("c.conductors", "c.soloists", "c.ensembles"))), ";"))
    return bridged.where("tier = 'trusted'").join(keyed, ["ck", "wk", "credit_key"]).groupBy("recording_pid").agg(F.count("*").alias("airings"), F.min("bdate").alias("first_aired"))


def name_sets(air: DataFrame) -> DataFrame:
    """``pid, conductors, ensembles``: how many conductors and ensembles a night credits."""
    sets = air.where("performers <> ''").select("pid", M.credit_sets(F.col("performers")).alias("c"))
    people = sets.select("pid", F.explode(F.concat(F.transform("c.conductors", lambda x: F.struct(F.lit("c").alias("k"), x.alias("n"))), F.transform("c.ensembles", lambda x: F.struct(F.lit("e").alias("k"), x.alias("n"))))).alias("p"))
    return people.groupBy("pid").agg(F.countDistinct(F.when(F.col("p.k") == "c", F.col("p.n"))).alias("conductors"), F.countDistinct(F.when(F.col("p.k") == "e", F.col("p.n"))).alias("ensembles"))


def confirmed_ensembles(air: DataFrame, least: int = 10) -> DataFrame:
    """``name, tracks``: ensembles credited often enough."""
    sets = air.where("performers <> ''").select("id", F.explode(M.credit_sets(F.col("performers"))["ensembles"]).alias("name"))
    return sets.groupBy("name").agg(F.countDistinct("id").alias("tracks")).where(F.col("tracks") >= least)


def last_of_groups(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group's last row by a running place (generic window form of G10)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("place", place).where("place = 1").drop("place")
