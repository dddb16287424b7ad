"""The content tables built from airings and segments, their checks and sinks."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aubade.functions.text import slug
from aubade.operators import ranking as R
from aubade.operators import segments as S
from aubade.session import pinned


def _free_number(place: Column, taken: Column) -> Column:
    """The number of a place (2 for the second) among the numbers not taken; ``taken`` is sorted."""
    return F.aggregate(taken, place, lambda n, t: F.when(t <= n, n + 1).otherwise(n))


def _suffixes(slugs: DataFrame) -> DataFrame:
    """``slug_base, taken``: the numbers that slugs of a base, or names that end like one, already have."""
    parts = slugs.select(F.regexp_extract("slug", r"^(.+)-(\d{1,9})$", 1).alias("slug_base"), F.regexp_extract("slug", r"^(.+)-(\d{1,9})$", 2).try_cast("int").alias("n"))
    return parts.where("slug_base <> '' and n >= 2").groupBy("slug_base").agg(F.array_sort(F.collect_set("n")).alias("taken"))


def _minted(rows: DataFrame, key: list[str], held: DataFrame) -> DataFrame:
    """Rows with a ``slug`` of their own: their ``slug_base``, or the next free number after it; ``held``: slugs that are taken."""
    rows = pinned(rows)  # read for its bases and for itself
    natural = rows.select(F.col("slug_base").alias("slug")).distinct()
    taken = _suffixes(natural.unionByName(held.select("slug")).distinct())
    here = held.select(F.col("slug").alias("slug_base")).distinct().withColumn("base_held", F.lit(1))
    joined = rows.join(taken, "slug_base", "left").join(here, "slug_base", "left")
    place = F.row_number().over(Window.partitionBy("slug_base").orderBy(*key)) + F.coalesce("base_held", F.lit(0))
    numbered = joined.withColumn("slug_place", place)
    number = _free_number(F.col("slug_place"), F.coalesce("taken", F.array().cast("array<int>")))
    slugged = numbered.withColumn("slug", F.when(F.col("slug_place") == 1, F.col("slug_base")).otherwise(F.concat_ws("-", "slug_base", number.cast("string"))))
    return slugged.drop("slug_base", "taken", "base_held", "slug_place")


def with_slugs(rows: DataFrame, text: str, key: list[str]) -> DataFrame:
    """Rows with a unique ``slug``: equal bases get -2, -3 in order of the key, past numbers that other bases end with."""
    return _minted(rows.withColumn("slug_base", slug(F.col(text))), key, rows.sparkSession.createDataFrame([], "slug string"))


def work_rows(air: DataFrame, segments: DataFrame) -> DataFrame:
    """``ck, wk, airings, n_recordings, n_text_only, first_aired, last_aired, nights`` (J1). A work's nights are one row a night and work."""
    recorded = S.with_work(segments).where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.countDistinct("recording_pid").alias("n_recordings"), F.count("*").alias("n_segments"))
    texts = air.where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.count("*").alias("airings"), F.min("bdate").alias("first_aired"), F.max("bdate").alias("last_aired"), F.countDistinct("pid").alias("nights"))
    joined = texts.join(recorded, ["ck", "wk"], "left")
    text_only = F.greatest(F.col("airings") - F.coalesce("n_segments", F.lit(0)), F.lit(0))
    return joined.select("ck", "wk", "airings", F.coalesce("n_recordings", F.lit(0)).alias("n_recordings"), text_only.alias("n_text_only"), "first_aired", "last_aired", "nights")


def recording_rows(segments: DataFrame) -> DataFrame:
    """``recording_pid, ck, wk, airings, label, first_aired, last_aired``: each recording's work of most airings, ties to the smaller key."""
    rows = S.with_work(segments).where("recording_pid is not null and ck <> '' and wk <> ''")
    counts = rows.groupBy("recording_pid", "ck", "wk").agg(F.count("*").alias("n"), F.min("bdate").alias("lo"), F.max("bdate").alias("hi"))
    best = counts.groupBy("recording_pid").agg(F.min(F.struct((-F.col("n")).alias("n"), "ck", "wk")).alias("b"), F.sum("n").alias("airings"), F.min("lo").alias("first_aired"), F.max("hi").alias("last_aired"))
    return best.join(S.majority_labels(segments), "recording_pid", "left").select("recording_pid", "b.ck", "b.wk", "airings", "label", "first_aired", "last_aired")


def composer_rows(air: DataFrame, top: int = 5) -> DataFrame:
    """``ck, airings, works, top_works``: composers with their chief works as one text."""
    works = air.where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.count("*").alias("n"))
    totals = works.groupBy("ck").agg(F.sum("n").alias("airings"), F.count("*").alias("works"))
    chief = R.top_per_group(works, ["ck"], top, F.col("n").desc(), F.col("wk"))
    listed = chief.groupBy("ck").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "wk"))), lambda x: x["wk"]), "; ").alias("top_works"))
    return totals.join(listed, "ck")


def episode_rows(air: DataFrame, repeats: DataFrame) -> DataFrame:
    """``pid, bdate, tracks, composers, earlier``: nights with their counts and earlier equal playlists."""
    counts = air.groupBy("pid", "bdate").agg(F.count("*").alias("tracks"), F.countDistinct(F.when(F.col("ck") != "", F.col("ck"))).alias("composers"))
    return counts.join(repeats, "pid", "left").select("pid", "bdate", "tracks", "composers", F.coalesce("earlier", F.lit(0)).alias("earlier"))


def browse(air: DataFrame, segments: DataFrame, top: int = 25) -> DataFrame:
    """``list, place, label, airings``: the browse lists in one table."""
    works = R.rank_works(air).select(F.lit("works").alias("list"), F.concat_ws(" | ", "ck", "wk").alias("label"), "airings")
    composers = R.rank_composers(air).select(F.lit("composers").alias("list"), F.col("ck").alias("label"), "airings")
    forms = R.forms(air).select(F.lit("forms").alias("list"), F.col("form").alias("label"), "airings")
    brcs = S.broadcasters(segments, private=True).select(F.lit("broadcasters").alias("list"), F.col("brc").alias("label"), "airings")
    countries = S.countries(segments, private=True).select(F.lit("countries").alias("list"), F.col("country").alias("label"), "airings")
    festive = R.rank_works(R.in_dates(air, christmas=True)).select(F.lit("christmas").alias("list"), F.concat_ws(" | ", "ck", "wk").alias("label"), "airings")
    rows = reduce(DataFrame.unionByName, [works, composers, forms, brcs, countries, festive])
    return R.top_per_group(rows, ["list"], top, F.col("airings").desc(), F.col("label"))


#: References among the content tables, as (table, column, table, column); null links are allowed.
REFERENCES = [
    ("works", "composer_slug", "composers", "slug"), ("recordings", "work_slug", "works", "slug"), ("recordings", "broadcaster", "broadcasters", "key"), ("recordings", "country", "countries", "key"), ("airings", "episode", "episodes", "pid"), ("airings", "work_slug", "works", "slug"), ("airings", "composer_slug", "composers", "slug"),
    ("airings", "recording", "recordings", "recording_pid"), ("forms", "work_slug", "works", "slug"), ("years", "top_work_slug", "works", "slug"), ("years", "top_composer_slug", "composers", "slug"), ("credits", "recording", "recordings", "recording_pid"), ("credits", "artist", "artists", "key"), ("episodes", "before", "episodes", "pid"), ("artists", "chief_recording", "recordings", "recording_pid"),
]


def content_tables(air: DataFrame, segments: DataFrame) -> tuple[dict[str, DataFrame], list[tuple[str, str, str, str]]]:
    """(tables, references) of the whole content build, keys and links by slug: what ``publish`` takes."""
    air, segs = pinned(air), pinned(S.with_work(segments))
    keys = pinned(air.where("ck <> '' and wk <> ''").select("ck", "wk").union(segs.where("ck <> '' and wk <> ''").select("ck", "wk")).distinct())
    composers = pinned(with_slugs(keys.select("ck").distinct(), "ck", ["ck"]))
    slugged = pinned(with_slugs(keys.withColumn("full", F.concat_ws(" ", "ck", "wk")), "full", ["ck", "wk"]).drop("full"))
    at = slugged.select("ck", "wk", F.col("slug").alias("work_slug"))
    by = composers.select("ck", F.col("slug").alias("composer_slug"))
    works = slugged.join(work_rows(air, segs), ["ck", "wk"], "left").join(by, "ck")
    recordings = pinned(recording_rows(segs).join(at, ["ck", "wk"], "left").withColumns({"broadcaster": S.broadcaster(F.col("label"), True), "country": S.country(F.col("label"), True)}))
    roles = S.identified(S.role_rows(segs)).where("recording_pid is not null")
    listed = pinned(roles.select("identity", F.col("recording_pid").alias("recording"), "role").distinct().join(recordings.select(F.col("recording_pid").alias("recording"), "airings"), "recording", "left_semi"))
    chief = listed.join(recordings.select(F.col("recording_pid").alias("recording"), "airings"), "recording").groupBy("identity").agg(F.max(F.struct("airings", "recording")).alias("c"), F.countDistinct("recording").alias("recordings"))
    nights = air.select("pid", "bdate").distinct()
    dated = nights.where("bdate is not null").groupBy("bdate").agg(F.min("pid").alias("pid"))
    before = F.add_months("bdate", -12)
    placed = air.join(at, ["ck", "wk"], "left").join(by, "ck", "left")
    per_year = lambda key, out: R.top_per_group(placed.where(f"yr is not null and {key} is not null").groupBy("yr", key).agg(F.count("*").alias("n")), ["yr"], 1, F.col("n").desc(), F.col(key)).select("yr", F.col(key).alias(out))
    own = segs.where("recording_pid is not null").groupBy(F.col("episode_pid").alias("pid"), (F.col("position") - 1).alias("position")).agg(F.min_by("recording_pid", "id").alias("recording")).join(recordings.select(F.col("recording_pid").alias("recording")), "recording", "left_semi")
    tables = {
        "composers": composers.join(composer_rows(air), "ck", "left"),
        "works": works,
        "recordings": recordings,
        "episodes": nights.join(dated.select(F.col("bdate").alias("year_ago"), F.col("pid").alias("before")), before == F.col("year_ago"), "left").select("pid", "bdate", "before"),
        "airings": placed.join(own, ["pid", "position"], "left").select("id", F.col("pid").alias("episode"), "position", "work_slug", "composer_slug", "recording"),
        "broadcasters": S.broadcasters(segs, True).select(F.col("brc").alias("key"), "airings", "recordings", "share"),
        "countries": S.countries(segs, True).select(F.col("country").alias("key"), "airings", "recordings"),
        "forms": placed.where("work_slug is not null and title is not null").select("work_slug", F.explode(R.form_matches(F.col("title"))).alias("form")).distinct(),
        "years": R.years(air).join(per_year("work_slug", "top_work_slug"), "yr", "left").join(per_year("composer_slug", "top_composer_slug"), "yr", "left"),
        "credits": listed.select(F.col("identity").alias("artist"), "recording", "role"),
        "artists": chief.select(F.col("identity").alias("key"), "recordings", F.col("c.recording").alias("chief_recording")),
    }
    return tables, REFERENCES


def closure(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """``reference, dangling``: how many non-null values of (table, column) are missing from (table, column)."""
    parts = []
    for table, column, target, key in references:
        values = tables[table].where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
        known = tables[target].select(F.col(key).alias("v")).distinct()
        parts.append(values.join(known, "v", "left_anti").agg(F.lit(f"{table}.{column} -> {target}.{key}").alias("reference"), F.count("*").alias("dangling")))
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order."""
    row = df.select(F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns)).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(repr((sorted(df.dtypes), row["n"], str(row["s"]), row["x"])).encode()).hexdigest()


def _files(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], path: str, references: list[tuple[str, str, str, str]]) -> dict[str, str]:
    """Write all tables to a staging folder, check closure there, then put each in place; dangling references stop it.

    Returns the tables' fingerprints. The tables before stay in ``_previous`` until all new ones are in place, and go
    back if a run ended in between.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    at, files = _files(spark, path)
    restore(spark, path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/_staging/{name}")
    staged = {name: spark.read.parquet(f"{path}/_staging/{name}") for name in tables}
    broken = closure(staged, references).where("dangling > 0").limit(20).collect() if references else []
    if broken:
        raise ValueError(f"dangling references: {[(r['reference'], r['dangling']) for r in broken]}")
    prints = {name: fingerprint(df) for name, df in staged.items()}
    files.mkdirs(at(f"{path}/_previous"))
    for name in tables:
        if files.exists(at(f"{path}/{name}")):
            files.rename(at(f"{path}/{name}"), at(f"{path}/_previous/{name}"))
    for name in tables:
        files.rename(at(f"{path}/_staging/{name}"), at(f"{path}/{name}"))
    files.delete(at(f"{path}/_previous"), True)
    files.delete(at(f"{path}/_staging"), True)
    return prints


def restore(spark: SparkSession, path: str) -> None:
    """Put the tables of ``_previous`` back, if a publication ended before its end."""
    at, files = _files(spark, path)
    if files.exists(at(f"{path}/_previous")):
        for entry in files.listStatus(at(f"{path}/_previous")):
            name = entry.getPath().getName()
            files.delete(at(f"{path}/{name}"), True)
            files.rename(entry.getPath(), at(f"{path}/{name}"))
        files.delete(at(f"{path}/_previous"), True)


def write_csv(df: DataFrame, path: str) -> None:
    """The whole report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_cache(df: DataFrame, path: str) -> None:
    """A derived table as JSON lines, written under a name of its own and then put in place."""
    at, files = _files(df.sparkSession, path)
    own = f"{path}.{uuid.uuid4().hex}"
    df.write.json(own)
    files.delete(at(path), True)
    files.rename(at(own), at(path))


def sync_registry(registry: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next registry, report) of slugs ``slug, key``.

    Keys keep their slug; new keys take theirs, or its next free number where it is taken; keys gone keep theirs and
    are reported as orphans.
    """
    held = registry.select("key", F.col("slug").alias("held"))
    wanted = derived.groupBy("key").agg(F.min("slug").alias("wanted"))
    both = held.join(wanted, "key", "full")
    minted = _minted(both.where("held is null").select("key", F.col("wanted").alias("slug_base")), ["key"], registry)
    kept = both.where("held is not null").select("key", F.col("held").alias("slug"))
    status = F.when(F.col("held").isNull(), "minted").when(F.col("wanted").isNull(), "orphan").otherwise("kept")
    return kept.unionByName(minted.select("key", "slug")), both.groupBy(status.alias("status")).agg(F.count("*").alias("entries"))


def registry_faults(registry: DataFrame, redirects: DataFrame) -> DataFrame:
    """``fault, slug``: slugs held twice, redirects from a slug that is held, and redirects that lead nowhere."""
    twice = registry.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("held twice").alias("fault"), "slug")
    shadowed = redirects.join(registry.select(F.col("slug").alias("source")), "source", "left_semi").select(F.lit("redirect shadowed").alias("fault"), F.col("source").alias("slug"))
    known = registry.select(F.col("slug").alias("target")).unionByName(redirects.select(F.col("source").alias("target")))
    lost = redirects.where("target is not null").join(known, "target", "left_anti").select(F.lit("redirect lost").alias("fault"), F.col("source").alias("slug"))
    return twice.unionByName(shadowed).unionByName(lost)


def renamed(registry: DataFrame, redirects: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, redirects) after ``changes`` (``old, new``): keys get their new slug, and the old one leads there.

    A change to a slug that another key holds is left out; of several changes of a slug the smallest holds.
    """
    one = changes.where("old <> new").groupBy("old").agg(F.min("new").alias("new")).groupBy("new").agg(F.min("old").alias("old"))
    free = one.join(registry.select(F.col("slug").alias("new")), "new", "left_anti").join(registry.select(F.col("slug").alias("old")), "old", "left_semi")
    after = registry.join(free, registry.slug == free.old, "left").select("key", F.coalesce("new", "slug").alias("slug"))
    joined = redirects.select("source", "target").unionByName(free.select(F.col("old").alias("source"), F.col("new").alias("target")))
    return after, redirects_collapsed(joined.join(after.select(F.col("slug").alias("source")), "source", "left_anti"))


def retired(registry: DataFrame, redirects: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, redirects, retired ``slug, key``) without the keys of some slugs, nor redirects that lead to them."""
    gone = registry.join(slugs.select("slug").distinct(), "slug", "left_semi").select("slug", "key")
    left = redirects.join(gone.select(F.col("slug").alias("target")), "target", "left_anti").select("source", "target")
    return registry.join(gone.select("slug"), "slug", "left_anti").select("key", "slug"), left, gone


def redirects_collapsed(redirects: DataFrame) -> DataFrame:
    """``source, target`` with each redirect leading straight to its end."""
    from aubade.operators.graph import resolved

    out = resolved(redirects.select(F.col("source").alias("variant"), F.col("target").alias("preferred")))
    return out.select(F.col("variant").alias("source"), F.col("preferred").alias("target"))
