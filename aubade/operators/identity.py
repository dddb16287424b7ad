"""The identity layer behind reports: recordings' clean names, aliases and full work keys, put on airings once.

Its result has the columns of ``ranking.airings``, so every ranking, summary, year and content table takes it as it is.
Keys are made by an Arrow function that remembers pairs of composer and title, without a shuffle; aliases and projected
recordings are joined, broadcast only where Spark's size limit allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aubade.functions.titlekey import composer_key, shown_title, title_key, without_staff_note
from aubade.operators.graph import with_alias


@F.pandas_udf(T.StringType())
def _clean_title(titles):  # noqa: ANN001, ANN202
    return titles.map(lambda t: without_staff_note(t), na_action="ignore")


def recording_names(segments: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``recording_pid, composer, title``: the clean pair of each recording, from the smallest of its own rows, else of rows of recordings that stand for it."""
    rows = segments.where("recording_pid is not null and track_title <> ''").select("recording_pid", "composer_name", "track_title").withColumn("own", F.lit(0))
    if aliases is not None:
        moved = with_alias(rows.withColumn("was", F.col("recording_pid")), "recording_pid", aliases)
        rows = moved.withColumn("own", F.when(F.col("was") == F.col("recording_pid"), 0).otherwise(1)).drop("was")
    best = rows.groupBy("recording_pid").agg(F.min(F.struct("own", F.coalesce("composer_name", F.lit("")).alias("composer"), F.col("track_title").alias("title"))).alias("b"))
    return best.select("recording_pid", F.col("b.composer").alias("composer"), _clean_title(F.col("b.title")).alias("title"))


def projected(air: DataFrame, projection: DataFrame, names: DataFrame) -> DataFrame:
    """Airings with the composer and title of the recording each is trusted to be; the others as they are.

    ``projection``: ``track_id, recording_pid``, at most one row a track; ``names``: as ``recording_names``.
    """
    clean = projection.join(names, "recording_pid").select(F.col("track_id").alias("id"), F.col("composer").alias("clean_composer"), F.col("title").alias("clean_title"))
    joined = air.join(clean, "id", "left")
    met = F.col("clean_title").isNotNull()
    pick = lambda new, old: F.when(met, F.col(new)).otherwise(F.col(old)).alias(old)
    kept = [F.col(c) for c in air.columns if c not in ("composer", "composer_line", "title")]
    return joined.select(*kept, pick("clean_composer", "composer"), F.when(met, F.col("clean_composer")).otherwise(F.col("composer_line")).alias("composer_line"), pick("clean_title", "title"))


def identified(air: DataFrame, composer_aliases: DataFrame | None = None, work_aliases: DataFrame | None = None, scoped_aliases: DataFrame | None = None) -> DataFrame:
    """Airings with ``ck`` and ``wk`` of the full rules, aliases applied one step: composers, then works within a composer, else anywhere.

    ``composer_aliases``, ``work_aliases``: ``variant, preferred`` keys; ``scoped_aliases``: ``ck, variant, preferred``.
    """
    rows = air.withColumn("ck", composer_key(F.col("composer"), F.col("composer_line")))
    if composer_aliases is not None:
        rows = with_alias(rows, "ck", composer_aliases)
    rows = rows.withColumn("wk", F.coalesce(title_key("title", "ck"), F.lit("")))
    if scoped_aliases is not None:
        table = scoped_aliases.select("ck", F.col("variant").alias("wk"), F.col("preferred").alias("scoped_to"))
        rows = rows.join(table, ["ck", "wk"], "left")
    else:
        rows = rows.withColumn("scoped_to", F.lit(None).cast("string"))
    if work_aliases is not None:
        table = work_aliases.select(F.col("variant").alias("wk"), F.col("preferred").alias("alias_to"))
        rows = rows.join(table, "wk", "left")
    else:
        rows = rows.withColumn("alias_to", F.lit(None).cast("string"))
    return rows.withColumn("wk", F.coalesce("scoped_to", "alias_to", "wk")).drop("scoped_to", "alias_to").select(*air.columns)


def displays(works: DataFrame) -> DataFrame:
    """A ranking of works with the title to show instead of the spelling as printed."""
    return works.withColumn("display", shown_title("display"))


def corpus(bridge: DataFrame, projection: DataFrame, starts: DataFrame, since: str = "2012-03-15") -> DataFrame:
    """``track_id, recording_pid, source``: links of nights before a date from the bridge, from then on from the projection (H5).

    ``starts``: ``track_id, bdate``. The two parts have no track in common.
    """
    early, late = F.col("bdate") < F.lit(since).cast("date"), F.col("bdate") >= F.lit(since).cast("date")
    return bridge.join(starts.where(early), "track_id", "left_semi").withColumn("source", F.lit("bridge")).unionByName(projection.join(starts.where(late), "track_id", "left_semi").withColumn("source", F.lit("projection")))


def status(projection: DataFrame, air: DataFrame) -> DataFrame:
    """``tracks, projected, share``: how many airings the projection covers."""
    met = air.select("id").join(projection.select(F.col("track_id").alias("id")).distinct().withColumn("met", F.lit(1)), "id", "left")
    return met.agg(F.count("*").alias("tracks"), F.count("met").alias("projected")).withColumn("share", F.round(F.try_divide("projected", "tracks"), 6))
