"""Analytics over nights and years: lengths, first airings, repeats, lift, anniversaries, arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_GAP = 90 * 60
DAY = 86_400


#: Fixed value: a clock text, with or without seconds, half of the day, stray colons, and a zone, which isn't counted; also as 0040h.
CLOCK_FORM = r"(?i)^\s*(\d{1,2})[:.]?(\d{2})(?:[:.](\d{2}))?\s*:?\s*(?:([ap])\.?m\.?)?\s*:?\s*(?:h|z|[a-z]{3,4}|[+-]\d{2}:?\d{2})?\s*$"


def clock_seconds(text: Column) -> Column:
    """Second of the day of a clock text; without AM or PM it is morning, 12 AM is 0."""
    part = lambda i: F.regexp_extract(text, CLOCK_FORM, i)
    h, m, s, half = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0)), F.lower(part(4))
    value = F.when(half == "p", h % 12 + 12).when((half == "a") | (h == 12), h % 12).otherwise(h) * 3600 + m * 60 + s
    return F.when((h <= 23) & (m <= 59) & (s <= 59), value)


def track_lengths(air: DataFrame) -> DataFrame:
    """``id, length_s``: the gap to the next position's clock, up to 90 minutes, over midnight."""
    night = Window.partitionBy("pid").orderBy("position", "id")
    rows = air.withColumn("s", clock_seconds(F.col("time_str")))
    rows = rows.withColumns({"next_s": F.lead("s").over(night), "next_pos": F.lead("position").over(night)})
    gap = F.pmod(F.col("next_s") - F.col("s"), F.lit(DAY))
    return rows.select("id", F.when((F.col("next_pos") == F.col("position") + 1) & (gap > 0) & (gap <= LONGEST_GAP), gap).cast("bigint").alias("length_s"))


def episode_offsets(air: DataFrame) -> DataFrame:
    """``id, offset_s``: seconds since the night's first readable clock, a day added at each decrease."""
    night = Window.partitionBy("pid").orderBy("position", "id")
    rows = air.withColumn("s", clock_seconds(F.col("time_str"))).where("s is not null")
    rows = rows.withColumn("wrap", F.when(F.col("s") < F.lag("s").over(night), 1).otherwise(0))
    rows = rows.withColumns({"days": F.sum("wrap").over(night), "first_s": F.first("s").over(night)})
    return rows.select("id", (F.col("s") + F.col("days") * DAY - F.col("first_s")).cast("bigint").alias("offset_s"))


def instant_offsets(air: DataFrame, instants: DataFrame) -> DataFrame:
    """``id, offset_s``: as episode_offsets, for every clock text that ``instants.track_instants`` reads."""
    night = Window.partitionBy("pid").orderBy("position", "id")
    rows = air.join(instants.select(F.col("rec_id").alias("id"), "utc_s"), "id")
    return rows.select("id", (F.col("utc_s") - F.first("utc_s").over(night)).cast("bigint").alias("offset_s"))


def instant_lengths(air: DataFrame, instants: DataFrame) -> DataFrame:
    """``id, length_s``: as track_lengths, for every clock text that ``instants.track_instants`` reads."""
    night = Window.partitionBy("pid").orderBy("position", "id")
    rows = air.join(instants.select(F.col("rec_id").alias("id"), "utc_s"), "id", "left")
    rows = rows.withColumns({"gap": F.lead("utc_s").over(night) - F.col("utc_s"), "next_pos": F.lead("position").over(night)})
    return rows.select("id", F.when((F.col("next_pos") == F.col("position") + 1) & (F.col("gap") > 0) & (F.col("gap") <= LONGEST_GAP), F.col("gap")).alias("length_s"))


def fingerprints(segments: DataFrame) -> DataFrame:
    """``pid, print``: the recordings of a night in order, joined (F28). A night of unnamed recordings has none.

    The list is one night's; a digest of it stands in for long nights.
    """
    named = segments.where("recording_pid is not null").groupBy(F.col("episode_pid").alias("pid")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(1 << 40)).alias("p"), "id", "recording_pid"))).alias("l"))
    return named.select("pid", F.sha1(F.array_join(F.transform("l", lambda x: x["recording_pid"]), "|")).alias("print"))


def repeats(prints: DataFrame, nights: DataFrame) -> DataFrame:
    """``pid, earlier``: how many earlier dates had the same playlist."""
    dated = prints.join(nights.where("bdate is not null").select("pid", "bdate"), "pid")
    dates = dated.select("print", "bdate").distinct()
    ordered = dates.withColumn("earlier", F.row_number().over(Window.partitionBy("print").orderBy("bdate")) - 1)
    return dated.join(ordered, ["print", "bdate"]).select("pid", F.col("earlier").cast("bigint").alias("earlier"))


def first_airings(air: DataFrame, since: str = "2012-03-15") -> DataFrame:
    """``id, work_first``: whether a track is its work's first airing, from a date on (G6). The minimum is aggregated, then joined."""
    rows = air.where("bdate is not null and ck <> '' and wk <> ''")
    first = rows.groupBy("ck", "wk").agg(F.min(F.struct("bdate", "position", "id")).alias("f"))
    return rows.join(first, ["ck", "wk"]).select("id", ((F.col("id") == F.col("f.id")) & (F.col("bdate") >= F.lit(since).cast("date"))).alias("work_first"))


def first_of_night(air: DataFrame) -> DataFrame:
    """``ck, wk, bdate, pid, position``: the first track of each work on each date."""
    rows = air.where("bdate is not null and ck <> '' and wk <> ''")
    return rows.groupBy("ck", "wk", "bdate").agg(F.min(F.struct("position", "pid")).alias("f")).select("ck", "wk", "bdate", F.col("f.pid").alias("pid"), F.col("f.position").alias("position"))


def year_counts(air: DataFrame) -> DataFrame:
    """``ck, yr, plays``."""
    return air.where("ck <> '' and yr is not null").groupBy("ck", "yr").agg(F.count("*").alias("plays"))


def with_lift(counts: DataFrame) -> DataFrame:
    """Plays over the mean of the composer's other active years; null with a single year."""
    totals = counts.groupBy("ck").agg(F.sum("plays").alias("all_plays"), F.count("*").alias("active"))
    mean = (F.col("all_plays") - F.col("plays")) / (F.col("active") - 1)
    return counts.join(totals, "ck").withColumn("lift", F.when(F.col("active") > 1, F.round(F.col("plays") / mean, 6))).drop("all_plays", "active")


#: Displays that are no person.
NO_PERSON = ("anonymous", "traditional", "various")


def anniversaries(counts: DataFrame, lives: DataFrame, least: int = 15, least_lift: float = 1.3) -> DataFrame:
    """``yr, ck, kind, years, plays, lift``: multiples of 50 since birth or death; both in one year read 'double' (J10)."""
    rows = with_lift(counts).where(F.col("plays") >= least).where(~F.col("ck").isin(*NO_PERSON)).where(F.col("lift").isNull() | (F.col("lift") >= least_lift)).join(lives, "ck")
    since = lambda c: F.when((F.col("yr") > F.col(c)) & (F.pmod(F.col("yr") - F.col(c), F.lit(50)) == 0), F.col("yr") - F.col(c))
    rows = rows.withColumns({"b": since("born"), "d": since("died")}).where("b is not null or d is not null")
    kind = F.when(F.col("b").isNotNull() & F.col("d").isNotNull(), "double").when(F.col("b").isNotNull(), "birth").otherwise("death")
    return rows.select("yr", "ck", kind.alias("kind"), F.coalesce("b", "d").cast("bigint").alias("years"), "plays", "lift")


def distinctive(counts: DataFrame, least: int = 10, least_lift: float = 1.4, n: int = 10) -> DataFrame:
    """``yr, place, ck, plays, lift``: the composers a year stands out by."""
    rows = with_lift(counts).where((F.col("plays") >= least) & (F.col("lift") >= least_lift))
    order = Window.partitionBy("yr").orderBy(F.col("lift").desc(), F.col("plays").desc(), F.col("ck"))
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= n).select("yr", "place", "ck", "plays", "lift")


def arrivals(counts: DataFrame, current_year: int, since: int = 2016, later: int = 4) -> DataFrame:
    """``ck, debut, later_years``: composers first played lately and kept."""
    rows = counts.groupBy("ck").agg(F.min("yr").alias("debut"), (F.countDistinct("yr") - 1).alias("later_years"))
    return rows.where((F.col("debut") >= since) & (F.col("debut") <= current_year - 3) & (F.col("later_years") >= later))


def neighbours(nights: DataFrame) -> DataFrame:
    """``bdate, before, after``: the broadcast dates around each.

    Dates are ranged and chained by joining each month's ends, so no task holds all dates: within a month by a window,
    across months by the last and first date of the nearest months that have any - a table of one row a month.
    """
    dates = nights.where("bdate is not null").select("bdate").distinct().withColumn("month", F.date_trunc("month", "bdate").cast("date"))
    inside = Window.partitionBy("month").orderBy("bdate")
    months = dates.groupBy("month").agg(F.min("bdate").alias("lo"), F.max("bdate").alias("hi"))
    order = Window.orderBy("month")
    months = months.select("month", F.lag("hi").over(order).alias("prior"), F.lead("lo").over(order).alias("next"))
    rows = dates.withColumns({"b": F.lag("bdate").over(inside), "a": F.lead("bdate").over(inside)}).join(F.broadcast(months), "month")
    return rows.select("bdate", F.coalesce("b", "prior").alias("before"), F.coalesce("a", "next").alias("after"))


def on_this_night(nights: DataFrame, day: str | None = None) -> DataFrame:
    """``bdate``: earlier dates of a day's month and day, of the last date's unless one is given."""
    dates = nights.where("bdate is not null").select("bdate").distinct()
    last = dates.agg(F.max("bdate").alias("last") if day is None else F.max(F.lit(day).cast("date")).alias("last"))
    return dates.crossJoin(last).where((F.date_format("bdate", "MM-dd") == F.date_format("last", "MM-dd")) & (F.col("bdate") < F.col("last"))).select("bdate")


def theme_markers(segments: DataFrame, boundaries: tuple[int, ...] = (7200, 14400)) -> DataFrame:
    """``episode_pid, boundary, id``: the first segment at or after each boundary, if one starts before it."""
    rows = segments.where("version_offset is not null")
    out = None
    for b in boundaries:
        part = rows.groupBy("episode_pid").agg(F.min(F.when(F.col("version_offset") >= b, F.struct("version_offset", "id"))).alias("f"), F.min("version_offset").alias("lo")).where((F.col("lo") < b) & F.col("f").isNotNull())
        part = part.select("episode_pid", F.lit(b).cast("bigint").alias("boundary"), F.col("f.id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def opening_runs(air: DataFrame) -> DataFrame:
    """``pid, ck, tracks``: how many tracks from the start of a night on have its first composer (run core of G9, J5).

    By aggregates, so that no task holds a night: the first composer, the first place of another one, the tracks before it.
    """
    rows = air.where("ck <> ''").select("pid", "ck", F.struct("position", "id").alias("at"))
    opener = rows.groupBy("pid").agg(F.min(F.struct("at", "ck")).alias("o")).select("pid", F.col("o.ck").alias("opener"))
    joined = rows.join(opener, "pid")
    breaks = joined.where("ck <> opener").groupBy("pid").agg(F.min("at").alias("break_at"))
    run = joined.where("ck = opener").join(breaks, "pid", "left").where(F.col("break_at").isNull() | (F.col("at") < F.col("break_at")))
    return run.groupBy("pid", F.col("opener").alias("ck")).agg(F.count("*").alias("tracks"))


def texture(air: DataFrame, lengths: DataFrame) -> DataFrame:
    """``yr, nights, tracks_a_night, mean_length``: how a year sounds."""
    rows = air.where("yr is not null").join(lengths, "id")
    return rows.groupBy("yr").agg(F.countDistinct("pid").alias("nights"), F.round(F.count("*") / F.countDistinct("pid"), 6).alias("tracks_a_night"), F.round(F.avg("length_s"), 6).alias("mean_length"))
