"""Structured segments: recordings, contributors, works and broadcasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aubade.functions.stations import broadcaster, country, pinned_last
from aubade.functions.text import plain_key
from aubade.functions.titlekey import work_key

#: Fixed value: the contributors of a segment row as JSON.
CREDITS = "array<struct<name:string,role:string,pid:string,musicbrainz_gid:string>>"
CREDIT = "struct<name:string,role:string,pid:string,musicbrainz_gid:string>"


def contributions(text: Column) -> Column:
    """The contributors of a JSON text; a bare object is a list of one."""
    return F.when(F.trim(text).startswith("{"), F.array(F.from_json(text, CREDIT))).otherwise(F.from_json(text, CREDITS))


def role_rows(segments: DataFrame) -> DataFrame:
    """One row a segment and contributor (A12): ``id, recording_pid, name, role, mbid, nk``."""
    rows = segments.select("id", "recording_pid", "episode_pid", F.explode(contributions(F.col("contributions_json"))).alias("c")).where("c.name is not null")
    return rows.select("id", "recording_pid", "episode_pid", F.col("c.name").alias("name"), F.lower("c.role").alias("role"), F.col("c.musicbrainz_gid").alias("mbid"), plain_key(F.col("c.name")).alias("nk"))


def name_maps(roles: DataFrame) -> DataFrame:
    """``nk, mbid``: the id that all identified rows of a name share (F13, unique backfill of F14)."""
    found = roles.where("mbid is not null and nk <> ''").groupBy("nk").agg(F.min("mbid").alias("lo"), F.max("mbid").alias("hi"))
    return found.where("lo = hi").select("nk", F.col("lo").alias("only_mbid"))


def identified(roles: DataFrame) -> DataFrame:
    """Roles with ``identity``: own id, else the only id of the name, else 'name:' and the key."""
    return roles.where("nk <> ''").join(name_maps(roles), "nk", "left").withColumn("identity", F.coalesce("mbid", "only_mbid", F.concat(F.lit("name:"), "nk")))


def recordings(segments: DataFrame) -> DataFrame:
    """Airings, dates and first-row attributes of each recording; rows without one form their own group (F8)."""
    return segments.groupBy("recording_pid").agg(
        F.count("*").alias("airings"), F.min("bdate").alias("first_aired"), F.max("bdate").alias("last_aired"),
        F.min_by("track_title", "id").alias("title"), F.min_by("composer_name", "id").alias("composer"), F.min_by("duration_seconds", "id").alias("duration"),
    )


def majority_labels(segments: DataFrame) -> DataFrame:
    """``recording_pid, label``: the most frequent label, ties to the smaller."""
    counted = segments.where("recording_pid is not null and record_label <> ''").groupBy("recording_pid", "record_label").agg(F.count("*").alias("n"))
    best = counted.groupBy("recording_pid").agg(F.min(F.struct((-F.col("n")).alias("n"), "record_label")).alias("b"))
    return best.select("recording_pid", F.col("b.record_label").alias("label"))


def rank_contributors(roles: DataFrame, segments: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """``identity, airings, recordings``: an identity counts once a recording, with the recording's whole airings."""
    rows = identified(roles).where("recording_pid is not null")
    if wanted is not None:
        rows = rows.where(F.col("role").isin(*wanted))
    counts = segments.where("recording_pid is not null").groupBy("recording_pid").agg(F.count("*").alias("n"))
    return rows.select("recording_pid", "identity").distinct().join(counts, "recording_pid").groupBy("identity").agg(F.sum("n").alias("airings"), F.count("*").alias("recordings"))


def coverage(roles: DataFrame) -> DataFrame:
    """How many credit rows an id covers."""
    rows = identified(roles)
    return rows.agg(F.count_if(~F.col("identity").startswith("name:")).alias("by_id"), F.count_if(F.col("identity").startswith("name:")).alias("by_name"))


def with_work(segments: DataFrame) -> DataFrame:
    """Segments with the native key of their title."""
    return segments.withColumn("wk", work_key(F.col("track_title")))


def works(segments: DataFrame) -> DataFrame:
    """``ck, wk, airings, recordings, excerpt``: works of recordings; an excerpt's lengths differ twofold."""
    rows = with_work(segments).where("ck <> '' and wk <> ''")
    return rows.groupBy("ck", "wk").agg(
        F.count("*").alias("airings"), F.countDistinct("recording_pid").alias("recordings"),
        F.coalesce(F.max("duration_seconds") >= 2 * F.min("duration_seconds"), F.lit(False)).alias("excerpt"),
    )


def alias_candidates(segments: DataFrame) -> DataFrame:
    """``recording_pid, works``: recordings filed under several works."""
    rows = with_work(segments).where("recording_pid is not null and ck <> '' and wk <> ''")
    return rows.groupBy("recording_pid").agg(F.countDistinct(F.struct("ck", "wk")).alias("works")).where("works > 1")


def broadcasters(segments: DataFrame, private: bool = False) -> DataFrame:
    """``brc, tier, airings, recordings, share``: share of attributed airings in percent; ``tier`` puts OTHER and UNATTRIBUTED last."""
    rows = segments.groupBy(broadcaster(F.col("record_label"), private).alias("brc")).agg(F.count("*").alias("airings"), F.countDistinct("recording_pid").alias("recordings"))
    total = rows.where("brc <> 'UNATTRIBUTED'").agg(F.sum("airings").alias("all"))
    share = F.when(F.col("brc") != "UNATTRIBUTED", F.round(100 * F.col("airings") / F.col("all"), 4))
    return rows.crossJoin(total).select("brc", pinned_last(F.col("brc")).alias("tier"), "airings", "recordings", share.alias("share"))


def countries(segments: DataFrame, private: bool = False) -> DataFrame:
    """``country, airings, recordings`` by the country of a label's broadcaster."""
    return segments.groupBy(country(F.col("record_label"), private).alias("country")).agg(F.count("*").alias("airings"), F.countDistinct("recording_pid").alias("recordings"))


def duration_band(segments: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows within a band of seconds; unknown lengths never pass, lengths under ten seconds are unknown."""
    sane = F.when(F.col("duration_seconds") >= 10, F.col("duration_seconds"))
    out = segments if least is None else segments.where(sane >= least)
    return out if most is None else out.where(sane <= most)


def median_lengths(segments: DataFrame) -> DataFrame:
    """``ck, wk, median_s``: the airing-weighted lower median length of a work (F25): half the airings are no longer."""
    rows = with_work(segments).where("ck <> '' and wk <> '' and duration_seconds >= 10")
    # The histogram of whole seconds is what is ordered, not the airings.
    sizes = rows.groupBy("ck", "wk", "duration_seconds").agg(F.count("*").alias("n"))
    work = Window.partitionBy("ck", "wk")
    cumulated = sizes.withColumns({"cum": F.sum("n").over(work.orderBy("duration_seconds")), "all": F.sum("n").over(work)})
    return cumulated.where(2 * F.col("cum") >= F.col("all")).groupBy("ck", "wk").agg(F.min("duration_seconds").alias("median_s"))


def length_classes(medians: DataFrame) -> DataFrame:
    """``class, works``: short under 10 minutes, long from 30."""
    m = F.col("median_s")
    return medians.groupBy(F.when(m < 600, "short").when(m < 1800, "medium").otherwise("long").alias("class")).agg(F.count("*").alias("works"))


def mbid_aliases(segments: DataFrame) -> DataFrame:
    """``composer_mbid, names``: composer ids under several name keys."""
    return segments.where("composer_mbid is not null and ck <> ''").groupBy("composer_mbid").agg(F.countDistinct("ck").alias("names")).where("names > 1")


def ambiguous_names(segments: DataFrame, key: Column | None = None) -> DataFrame:
    """``ck, ids``: name keys - or another key, such as surnames - under several composer ids."""
    rows = segments if key is None else segments.withColumn("ck", key)
    return rows.where("composer_mbid is not null and ck <> ''").groupBy("ck").agg(F.countDistinct("composer_mbid").alias("ids")).where("ids > 1")


def backfilled(segments: DataFrame) -> DataFrame:
    """Segments with ``cid``: own composer id, else the only id of the name key, else the key."""
    known = segments.where("composer_mbid is not null and ck <> ''").groupBy("ck").agg(F.min("composer_mbid").alias("lo"), F.max("composer_mbid").alias("hi")).where("lo = hi").select("ck", "lo")
    return segments.join(known, "ck", "left").withColumn("cid", F.coalesce("composer_mbid", "lo", F.when(F.col("ck") != "", F.concat(F.lit("name:"), "ck")))).drop("lo")


def national_nights(segments: DataFrame, least: int = 10, share: float = 0.7, private: bool = False) -> DataFrame:
    """``episode_pid, country, n, recognised``: nights of which one country holds most recognised segments."""
    rows = segments.withColumn("country", country(F.col("record_label"), private)).where(~F.col("country").isin("OTHER", "UNATTRIBUTED"))
    counts = rows.groupBy("episode_pid", "country").agg(F.count("*").alias("n"))
    totals = counts.groupBy("episode_pid").agg(F.sum("n").alias("recognised"), F.max_by("country", F.struct("n", "country")).alias("country"), F.max("n").alias("n"))
    return totals.where((F.col("recognised") >= least) & (F.col("n") >= share * F.col("recognised")))


def night_signature(segments: DataFrame, least: int = 3, top: int = 5, private: bool = False) -> DataFrame:
    """``country, place, ck, lift``: composers over-represented in a country's segments, share over share."""
    rows = segments.where("ck <> ''").select("ck", country(F.col("record_label"), private).alias("country")).where(~F.col("country").isin("OTHER", "UNATTRIBUTED"))
    pair = rows.groupBy("country", "ck").agg(F.count("*").alias("n"))
    by_country = pair.groupBy("country").agg(F.sum("n").alias("cn"))
    by_composer = pair.groupBy("ck").agg(F.sum("n").alias("kn"))
    everything = pair.agg(F.sum("n").alias("alln"))
    lift = F.round((F.col("n") / F.col("cn")) / (F.col("kn") / F.col("alln")), 6)
    scored = pair.where(F.col("n") >= least).join(by_country, "country").join(by_composer, "ck").crossJoin(everything).select("country", "ck", lift.alias("lift"))
    order = Window.partitionBy("country").orderBy(F.col("lift").desc(), F.col("ck"))
    return scored.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= top)


def collaborators(roles: DataFrame, top: int = 3) -> DataFrame:
    """``identity, place, other, recordings``: who is credited with whom on most recordings.

    Only credits of one segment row meet, so a pair list is bounded by one row's text, not by a recording's airings.
    """
    rows = identified(roles).where("recording_pid is not null").select("id", "recording_pid", "identity").distinct()
    listed = rows.groupBy("id", "recording_pid").agg(F.collect_set("identity").alias("all"))
    pairs = listed.select("recording_pid", "all", F.explode("all").alias("identity")).select("recording_pid", "identity", F.explode("all").alias("other")).where("identity <> other")
    counted = pairs.groupBy("identity", "other").agg(F.countDistinct("recording_pid").alias("recordings"))
    order = Window.partitionBy("identity").orderBy(F.col("recordings").desc(), F.col("other"))
    return counted.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= top)


def kinds(roles: DataFrame) -> DataFrame:
    """``identity, kind``: the dominant family of roles, ties by name."""
    family = F.when(F.col("role") == "conductor", "conductor").when(F.col("role").isin("orchestra", "ensemble", "choir"), "ensemble").when(F.col("role").isin("composer"), "composer").when(F.col("role").rlike("soprano|alto|tenor|baritone|bass$|singer"), "singer").otherwise("performer")
    counted = identified(roles).withColumn("kind", family).groupBy("identity", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy("identity").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("b")).select("identity", F.col("b.kind").alias("kind"))


def house_performances(segments: DataFrame, top: int = 50, since: int = 2016) -> DataFrame:
    """``ck, wk, recording_pid, airings, share``: the recording a chief work is mostly played from lately."""
    rows = with_work(segments).where("ck <> '' and wk <> ''")
    chief = rows.groupBy("ck", "wk").agg(F.count("*").alias("all")).orderBy(F.col("all").desc(), "ck", "wk").limit(top)
    late = rows.where((F.year("bdate") >= since) & F.col("recording_pid").isNotNull()).join(F.broadcast(chief), ["ck", "wk"])  # at most `top` rows
    counts = late.groupBy("ck", "wk", "recording_pid").agg(F.count("*").alias("n"))
    best = counts.groupBy("ck", "wk").agg(F.min(F.struct((-F.col("n")).alias("n"), "recording_pid")).alias("b"), F.sum("n").alias("t"))
    return best.select("ck", "wk", F.col("b.recording_pid").alias("recording_pid"), (-F.col("b.n")).alias("airings"), F.round(-F.col("b.n") / F.col("t"), 6).alias("share"))
