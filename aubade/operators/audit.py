"""Checks and lists of audits and pages: excluded names, doubtful majorities, shared evidence, displays, gates, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aubade.functions.text import duration_text
from aubade.operators.ranking import best_spelling, years
from aubade.operators.segments import identified
from aubade.session import pinned


def excluded_name(composer: Column) -> Column:
    """Whether a composer text names no single composer: several names, an arranger, or a source without one."""
    return composer.contains(",") | composer.rlike(r"(?i)\barr\b") | composer.rlike("^(?:Traditional|Anon|Unknown)")


def majority_doubtful(big: Column, small: Column) -> Column:
    """Whether the rarer spelling looks the better one: it has more accented letters, or says more."""
    accents = lambda x: F.length(F.regexp_replace(x, r"[\x00-\x7f]", ""))
    return (accents(small) > accents(big)) | (F.length(small) > F.length(big))


def doubtful_majorities(air: DataFrame, share: float = 0.5) -> DataFrame:
    """``ck, big, small, n_big, n_small``: composers whose second spelling looks better than the first and has at least a share of its airings."""
    counts = air.where("ck <> ''").where(~excluded_name(F.col("composer"))).groupBy("ck", "composer").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = counts.groupBy("ck").agg(F.max(F.struct("n", (-F.col("first_id")).alias("early"), "composer")).alias("b"))
    rest = counts.join(best, "ck").where("composer <> b.composer").groupBy("ck", "b").agg(F.max(F.struct("n", (-F.col("first_id")).alias("early"), "composer")).alias("s"))
    pairs = rest.select("ck", F.col("b.composer").alias("big"), F.col("s.composer").alias("small"), F.col("b.n").alias("n_big"), F.col("s.n").alias("n_small"))
    return pairs.where(majority_doubtful(F.col("big"), F.col("small")) & (F.col("n_small") >= share * F.col("n_big")))


def same_work(a: Column, b: Column, generic: Column) -> Column:
    """Whether two titles' words show one work: one specific word in common, or three of the generic ones."""
    shared = F.array_intersect(a, b)
    return (F.size(F.array_except(shared, generic)) >= 1) | (F.size(shared) >= 3)


def typical_lengths(air: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ck, wk, title, median_s``: each work's commonest title and interpolated median length; unknown lengths don't count."""
    rows = air.where("ck <> '' and wk <> ''").join(lengths, "id", "left")
    medians = rows.groupBy("ck", "wk").agg(F.percentile("length_s", 0.5).alias("median_s"))
    titles = rows.where("title is not null").groupBy("ck", "wk", "title").agg(F.count("*").alias("n")).groupBy("ck", "wk").agg(F.max(F.struct("n", "title")).alias("t"))
    return medians.join(titles, ["ck", "wk"], "left").select("ck", "wk", F.col("t.title").alias("title"), "median_s")


def contributor_displays(roles: DataFrame) -> DataFrame:
    """``identity, display``: of an id the name of its first row, else the commonest spelling."""
    rows = identified(roles)
    byid = rows.where(~F.col("identity").startswith("name:")).groupBy("identity").agg(F.min(F.struct("id", "name")).alias("f")).select("identity", F.col("f.name").alias("first_name"))
    return best_spelling(rows, ["identity"], "name").join(byid, "identity", "left").select("identity", F.coalesce("first_name", "display").alias("display"))


def yearly_summary(air: DataFrame) -> DataFrame:
    """``yr, airings, works, composers, first_night, last_night, nights, median_tracks``: the summary of every year in one pass."""
    sizes = air.where("yr is not null").groupBy("yr", "pid").agg(F.count("*").alias("n")).groupBy("yr", "n").agg(F.count("*").alias("nights"))
    # A year's histogram of nights by size has a few rows.
    total = sizes.groupBy("yr").agg(F.sum("nights").alias("nights"), F.array_sort(F.collect_list(F.struct("n", "nights"))).alias("h"))
    upper = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("bigint").alias("m")), lambda s, x: F.struct((s["cum"] + x["nights"]).alias("cum"), F.when(s["m"].isNull() & (s["cum"] + x["nights"] > F.floor(F.col("nights") / 2)), x["n"]).otherwise(s["m"]).alias("m")))["m"]
    return years(air).join(total.select("yr", "nights", upper.alias("median_tracks")), "yr")


def gates(air: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ck, wk, airings, bars, lengths``: whether a work's page shows bars by year (three years or five airings) and a column of lengths (nine tenths known)."""
    rows = air.where("ck <> '' and wk <> ''").join(lengths, "id", "left")
    totals = rows.groupBy("ck", "wk").agg(F.count("*").alias("airings"), F.countDistinct("yr").alias("n_years"), F.count("length_s").alias("known"))
    return totals.select("ck", "wk", "airings", ((F.col("n_years") >= 3) | (F.col("airings") >= 5)).alias("bars"), (F.col("known") >= 0.9 * F.col("airings")).alias("lengths"))


def recordings_with_works(recordings: DataFrame, works: DataFrame) -> DataFrame:
    """Recordings with their work's row; an error if one has no work or several, as the rows then differ in number."""
    joined = pinned(recordings.join(works, ["ck", "wk"]))
    before, after = recordings.count(), joined.count()
    if before != after:
        raise ValueError(f"{before} recordings, but {after} with a work")
    return joined


def recording_sets(segments: DataFrame) -> DataFrame:
    """``key, rp``: which recordings a work holds, as evidence of it for another build."""
    return segments.where("recording_pid is not null and ck <> '' and wk <> ''").select(F.concat_ws("|", "ck", "wk").alias("key"), F.col("recording_pid").alias("rp")).distinct()


def lookups(recordings: DataFrame, slugs: DataFrame) -> DataFrame:
    """``recording_pid, slug, label``: what pages of sources show of a recording (L16). ``slugs``: ``ck, wk, slug``."""
    return recordings.join(slugs, ["ck", "wk"], "left").select("recording_pid", "slug", F.coalesce("label", F.lit("")).alias("label"))


def rendered(numbered: DataFrame, name: str, count: str = "airings") -> DataFrame:
    """``line``: the lines of a report as text, in order of ``rank`` (K2)."""
    line = F.format_string("%4d. %-60s %6d", F.col("rank"), F.coalesce(F.col(name), F.lit("")), F.col(count))
    return numbered.select("rank", line.alias("line"))


def clock_text(seconds: Column) -> Column:
    """'1:05 AM' of a second of the day."""
    hour, minute = F.floor(F.pmod(seconds, F.lit(86_400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.format_string("%d:%02d %s", F.pmod(hour + 11, F.lit(12)) + 1, minute, F.when(hour < 12, "AM").otherwise("PM"))


def date_text(day: Column) -> Column:
    """'3 March 2019' of a date."""
    return F.date_format(day, "d MMMM yyyy")


def span_text(first: Column, last: Column) -> Column:
    """'2008', or '2008–2019' of two years."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string")))


#: Folders of pages by kind.
PAGES = {"work": "works", "composer": "composers", "episode": "episodes", "year": "years", "form": "forms", "broadcaster": "broadcasters", "country": "countries", "artist": "artists", "ensemble": "artists"}


def page_url(kind: Column, slug: Column) -> Column:
    """The one address of a page, null for a kind without pages."""
    folders = F.create_map(*(F.lit(x) for pair in PAGES.items() for x in pair))
    return F.concat(F.lit("/"), F.try_element_at(folders, kind), F.lit("/"), slug, F.lit("/"))


def useful_subtitle(title: Column, subtitle: Column) -> Column:
    """A subtitle that says more than the title, else '' (C35)."""
    plain = lambda x: F.lower(F.trim(x))
    return F.when((F.coalesce(subtitle, F.lit("")) != "") & ~plain(F.coalesce(title, F.lit(""))).contains(plain(subtitle)), F.trim(subtitle)).otherwise("")


def formatted(segments: DataFrame) -> DataFrame:
    """``id, length, starts, night``: a segment's figures as a page shows them."""
    return segments.select("id", F.when(F.col("duration_seconds").isNotNull(), duration_text(F.col("duration_seconds"))).alias("length"), F.when(F.col("version_offset").isNotNull(), clock_text(F.col("version_offset"))).alias("starts"), date_text(F.col("bdate")).alias("night"))
