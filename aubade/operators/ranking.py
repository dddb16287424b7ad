"""Rankings and summaries of airings: what is played, how often, when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aubade.functions.text import ascii_fold, canonical_key, life_years, plain_key
from aubade.functions.titlekey import composer_key, work_key
from aubade.operators.graph import with_alias
from aubade.operators.instants import HOME, MONTHS
from aubade.session import pinned

#: Upper ends of the airing-count buckets.
BUCKETS = ((1, "1"), (5, "2-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"))


#: How a night's date is written: year first, the same without signs, with slashes day first, with the month's
#: name, and as seconds or milliseconds since 1970.
DAY_FORMS = (
    r"^(\d{4})-(\d{2})-(\d{2})",
    r"^(\d{4})(\d{2})(\d{2})[Tt]\d{4}",
    r"^(\d{1,2})/(\d{1,2})/(\d{4})\b",
    r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\b",
    r"^(-?\d{9,14})$",
)


def broadcast_day(text: Column) -> Column:
    """The date of a start as written, or of bare seconds in London; null for other texts and impossible dates."""
    iso, basic, slash, words, number = DAY_FORMS
    part = lambda p, i: F.regexp_extract(text, p, i)
    plain = lambda p, y, m, d: F.concat_ws("-", part(p, y), F.lpad(part(p, m), 2, "0"), F.lpad(part(p, d), 2, "0")).try_cast("date")
    month = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS.split(), 1) for x in (m, f"{i:02d}"))), F.lower(part(words, 2)))
    named = F.concat_ws("-", part(words, 3), month, F.lpad(part(words, 1), 2, "0")).try_cast("date")
    seconds = part(number, 1).try_cast("bigint")
    seconds = F.when(F.abs(seconds) >= 100_000_000_000, F.floor(seconds / 1000)).otherwise(seconds)
    bare = F.from_utc_timestamp(F.timestamp_seconds(seconds), HOME).cast("date")
    return F.when(text.rlike(iso), plain(iso, 1, 2, 3)).when(text.rlike(basic), plain(basic, 1, 2, 3)).when(text.rlike(slash), plain(slash, 3, 2, 1)).when(text.rlike(words), named).when(text.rlike(number), bare)


def airings(tracks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Tracks with their night: ``id, pid, position, time_str, composer, composer_line, title, performers, bdate, yr, ck, wk``.

    ``ck`` and ``wk`` are the native keys; ``identity.identified`` gives those of the whole identity layer.
    """
    nights = episodes.select("pid", broadcast_day(F.col("broadcast_date")).alias("bdate"))
    joined = tracks.select("id", F.col("episode_pid").alias("pid"), "position", "time_str", "composer", "composer_line", "title", "performers").join(nights, "pid")
    return joined.select("id", "pid", "position", "time_str", "composer", "composer_line", "title", "performers", "bdate", F.year("bdate").alias("yr"), composer_key(F.col("composer"), F.col("composer_line")).alias("ck"), work_key(F.col("title")).alias("wk"))


def best_spelling(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The spelling of each key: clean ASCII-safe first, then free of bracketed notes, then most frequent, then first seen (F2)."""
    spelled = rows.where(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    good = ~F.col(text).rlike(r"[^ -~\u00a1-\u00ac\u00ae-\u024f\u2013\u2014\u2018\u2019\u201c\u201d]")
    order = F.struct(good.alias("clean"), (~F.col(text).rlike(r"[(\[]")).alias("note_free"), "n", (-F.col("first_id")).alias("early"))
    return spelled.groupBy(*keys).agg(F.max_by(text, order).alias("display"))


def rank_works(air: DataFrame) -> DataFrame:
    """Works by airings; ties by the first track id (F1, H1)."""
    works = air.where("ck <> '' and wk <> ''")
    totals = works.groupBy("ck", "wk").agg(F.count("*").alias("airings"), F.min("bdate").alias("first_aired"), F.max("bdate").alias("last_aired"), F.min("id").alias("first_id"))
    return totals.join(best_spelling(works, ["ck", "wk"], "title"), ["ck", "wk"], "left")


def rank_composers(air: DataFrame) -> DataFrame:
    """Composers by airings, with their distinct works (F1)."""
    rows = air.where("ck <> ''")
    totals = rows.groupBy("ck").agg(F.count("*").alias("airings"), F.countDistinct(F.when(F.col("wk") != "", F.col("wk"))).alias("works"), F.min("id").alias("first_id"))
    return totals.join(best_spelling(rows, ["ck"], "composer"), "ck", "left")


def rank_pieces(air: DataFrame) -> DataFrame:
    """Pieces as printed: composer and title untouched (F1)."""
    return air.where("composer is not null and title is not null").groupBy("composer", "title").agg(F.count("*").alias("airings"), F.min("id").alias("first_id"))


def credits(air: DataFrame) -> DataFrame:
    """One row a bracketed credit: ``id, pid, bdate, ck, wk, name, role``; equal credits of one track all count."""
    found = F.regexp_extract_all("performers", F.lit(r"([^(),;|/\n\[\]]+)[(\[]([^)\]]+)[)\]]"), F.lit(0))
    part = air.where("performers is not null").select("id", "pid", "bdate", "ck", "wk", F.posexplode(found).alias("place", "credit"))
    name, role = F.trim(F.regexp_extract("credit", r"^([^(\[]+)", 1)), F.lower(F.trim(F.regexp_extract("credit", r"[(\[]([^)\]]+)[)\]]", 1)))
    return part.select("id", "pid", "bdate", "ck", "wk", "place", name.alias("name"), role.alias("role")).where("name <> ''")


def rank_conductors(air: DataFrame) -> DataFrame:
    """Conductors by airings and works (F1)."""
    rows = credits(air).where("role = 'conductor'").withColumn("nk", plain_key(F.col("name"))).where("nk <> ''")
    return rows.groupBy("nk").agg(F.count("*").alias("airings"), F.countDistinct("ck", "wk").alias("works"))


#: Cities that follow an ensemble's name after a comma.
CITIES = "Cologne|Köln|Berlin|Dresden|Munich|München|Hamburg|Frankfurt|Stuttgart|Leipzig|Vienna|Wien|Salzburg|Katowice|Warsaw|Krakow|Kraków|Budapest|Prague|Bratislava|Ljubljana|Zagreb|Paris|Madrid|Rome|Milan|Helsinki|Stockholm|Oslo|Copenhagen|Bergen|London|Manchester|Toronto|Vancouver|Montreal|Saarbrücken Kaiserslautern"
_ROLE = r"^(.*?)\s*\(([^)]+)\)\s*\.?\s*$"


def performer_parts(performers: Column, cities: str = CITIES) -> Column:
    """The parts of a performers text between commas; a bare city goes to the bare part before it."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(performers, r"[. ]+$", ""), ","), lambda p: F.trim(p)), lambda p: p != "")
    known = F.array(*(F.lower(ascii_fold(F.lit(c))) for c in cities.split("|")))
    city = lambda p: F.array_contains(known, F.lower(ascii_fold(p)))
    none = F.array().cast("array<string>")
    joins = lambda acc, p: (F.size(acc) > 0) & ~p.contains("(") & ~F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("(")).contains("(") & city(p)
    return F.aggregate(parts, none, lambda acc, p: F.when(joins(acc, p), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(", "), p)))).otherwise(F.concat(acc, F.array(p))))


def performer_names(air: DataFrame, axis: str) -> DataFrame:
    """``id, pid, bdate, ck, wk, name, nk``: one row a credited ensemble (bare parts) or conductor (by role); none is counted once only."""
    parts = air.where("performers <> ''").select("id", "pid", "bdate", "ck", "wk", F.explode(performer_parts(F.col("performers"))).alias("part"))
    if axis == "ensemble":
        named = parts.where(~F.col("part").rlike(_ROLE)).withColumn("name", F.col("part"))
    else:
        named = parts.where(F.lower(F.regexp_extract("part", _ROLE, 2)).rlike("conductor|director")).withColumn("name", F.trim(F.regexp_extract("part", _ROLE, 1)))
    return named.withColumn("nk", canonical_key(F.col("name"))).where("nk <> ''").drop("part")


def rank_ensembles(air: DataFrame, axis: str = "ensemble", aliases: DataFrame | None = None) -> DataFrame:
    """``nk, airings, works, first_id, display`` of ensembles, or of conductors by the same parts (F1)."""
    rows = performer_names(air, axis)
    if aliases is not None:
        rows = with_alias(rows, "nk", aliases)
    totals = rows.groupBy("nk").agg(F.count("*").alias("airings"), F.countDistinct("ck", "wk").alias("works"), F.min("id").alias("first_id"))
    return totals.join(best_spelling(rows, ["nk"], "name"), "nk", "left")


def ensemble_identity(air: DataFrame, phrase: str, axis: str = "ensemble") -> DataFrame:
    """All tracks that credit an ensemble, or a conductor, of whom any spelling matches."""
    rows = performer_names(air, axis)
    hit = rows.where(F.lower(ascii_fold(F.col("name"))).contains(phrase.lower())).select("nk").distinct()
    return air.join(rows.join(hit, "nk", "left_semi").select("id").distinct(), "id", "left_semi")


def work_identity(air: DataFrame, composer: str, title_key: str) -> DataFrame:
    """All airings of one work."""
    return air.where((F.col("ck") == composer) & (F.col("wk") == title_key))


def composer_contains(rows: DataFrame, phrase: str, column: str = "composer_name") -> DataFrame:
    """Rows whose composer holds a folded phrase, without any expansion to its other spellings."""
    return rows.where(F.lower(ascii_fold(F.col(column))).contains(phrase.lower()))


def ordered(ranked: DataFrame, regime: str = "airings", top: int | None = None) -> DataFrame:
    """A ranking numbered by one of its three orders (H1): airings, ties by the first track; works, then airings and display; a band's count, then display."""
    shown = F.lower("display")
    orders = {"airings": (F.col("airings").desc(), F.col("first_id")), "works": (F.col("works").desc(), F.col("airings").desc(), shown, F.col("first_id")), "band": (F.col("airings").desc(), shown, F.col("first_id"))}
    return numbered(ranked, *orders[regime], top=top)


def displayed(ranked: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """A ranking with ``display`` replaced where a curator's ``key, label`` table has one."""
    table = labels.select(F.col("key").alias(key), "label")
    return ranked.join(table, key, "left").withColumn("display", F.coalesce("label", "display")).drop("label")


def summary_tops(air: DataFrame, n: int = 10) -> DataFrame:
    """``list, place, ck, wk, n``: composers by airings, composers by works, and works by airings of rows with a composer and a title."""
    works = air.where("ck <> '' and wk <> ''").groupBy("ck", "wk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    composers = works.groupBy("ck").agg(F.sum("n").alias("airings"), F.count("*").alias("works"), F.min("first_id").alias("first_id"))
    rows = works.select(F.lit("works").alias("list"), "ck", "wk", "n", "first_id")
    for name, column in (("composers", "airings"), ("composers_by_works", "works")):
        rows = rows.unionByName(composers.select(F.lit(name).alias("list"), "ck", F.lit("").alias("wk"), F.col(column).alias("n"), "first_id"))
    return top_per_group(rows, ["list"], n, F.col("n").desc(), F.col("first_id")).select("list", "place", "ck", "wk", "n")


def with_band(ranked: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Keep rows whose airings lie in a band."""
    out = ranked if least is None else ranked.where(F.col("airings") >= least)
    return out if most is None else out.where(F.col("airings") <= most)


def numbered(ranked: DataFrame, *order: Column, top: int | None = None) -> DataFrame:
    """Rank numbers by an order; ``top`` rows only by a top-k that never sorts the rest (G1, H3).

    A whole report is range-partitioned by the order; numbers are offsets of partitions plus places within them.
    """
    if top is not None:
        return ranked.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    laid = pinned(ranked.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"rank_part": F.spark_partition_id(), "rank_place": F.monotonically_increasing_id()}))
    sizes = laid.groupBy("rank_part").agg(F.count("*").alias("n"), F.min("rank_place").alias("first"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("rank_part", (before - F.col("first")).alias("offset"))
    return laid.join(F.broadcast(offsets), "rank_part").withColumn("rank", F.col("rank_place") + F.col("offset") + 1).drop("rank_part", "rank_place", "offset")


def with_tail(ranked: DataFrame, top: int, *order: Column) -> DataFrame:
    """The top rows and one row for all others: ``label, airings, members`` (H4)."""
    head = ranked.orderBy(*order).limit(top).select("label", "airings")
    sums = ranked.agg(F.coalesce(F.sum("airings"), F.lit(0)).alias("a"), F.count("*").alias("m"))
    seen = head.agg(F.coalesce(F.sum("airings"), F.lit(0)).alias("ha"), F.count("*").alias("hm"))
    rest = sums.crossJoin(seen).where("m > hm").select(F.lit("... more").alias("label"), (F.col("a") - F.col("ha")).alias("airings"), (F.col("m") - F.col("hm")).alias("members"))
    return head.withColumn("members", F.lit(1).cast("bigint")).unionByName(rest)


def top_per_group(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group with their place; Spark limits each partition's groups before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col("place") <= n)


def years(air: DataFrame) -> DataFrame:
    """Airings, works, composers and endpoints of each year."""
    rows = air.where("bdate is not null")
    return rows.groupBy("yr").agg(F.count("*").alias("airings"), F.countDistinct(F.when(F.col("wk") != "", F.struct("ck", "wk"))).alias("works"), F.countDistinct(F.when(F.col("ck") != "", F.col("ck"))).alias("composers"), F.min("bdate").alias("first_night"), F.max("bdate").alias("last_night"))


def partial_years(by_year: DataFrame) -> DataFrame:
    """Whether the first and last year are partly covered (F5). The table has one row a year."""
    ends = by_year.agg(F.min("yr").alias("lo"), F.max("yr").alias("hi"))
    late = F.date_format("first_night", "MM-dd") > "01-01"
    early = F.date_format("last_night", "MM-dd") < "12-31"
    return by_year.crossJoin(ends).select("yr", ((F.col("yr") == F.col("lo")) & late | (F.col("yr") == F.col("hi")) & early).alias("partial"))


def bucket_of(count: Column) -> Column:
    """Label of an airing-count bucket."""
    out = F.lit("100+")
    for most, label in reversed(BUCKETS):
        out = F.when(count <= most, label).otherwise(out)
    return out


def summary(air: DataFrame) -> DataFrame:
    """One row of totals of rows with a composer and a title: distincts, mean and upper median of tracks a night."""
    air = air.where("composer <> '' and title <> ''")
    totals = air.agg(F.count("*").alias("airings"), F.countDistinct("pid").alias("nights"), F.countDistinct(F.when(F.col("ck") != "", F.col("ck"))).alias("composers"), F.countDistinct(F.when((F.col("wk") != "") & (F.col("ck") != ""), F.struct("ck", "wk"))).alias("works"))
    sizes = air.groupBy("pid").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("nights"))
    # Upper median on the histogram of sizes, which is short whatever the number of nights.
    cumulated = sizes.withColumn("cum", F.sum("nights").over(Window.orderBy("n"))).crossJoin(sizes.agg(F.sum("nights").alias("all")))
    median = cumulated.where(F.col("cum") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median_tracks"))
    return totals.crossJoin(median).withColumn("mean_tracks", F.round(F.col("airings") / F.col("nights"), 6))


def buckets(ranked: DataFrame) -> DataFrame:
    """How many entries fall in each airing-count bucket."""
    return ranked.groupBy(bucket_of(F.col("airings")).alias("bucket")).agg(F.count("*").alias("entries"), F.sum("airings").alias("airings"))


def in_dates(air: DataFrame, after: str | None = None, before: str | None = None, year: int | None = None, christmas: bool = False) -> DataFrame:
    """Date filters (D2): inclusive ends; christmas keeps 24 to 26 December."""
    out = air
    if after is not None:
        out = out.where(F.col("bdate") >= F.lit(after).cast("date"))
    if before is not None:
        out = out.where(F.col("bdate") <= F.lit(before).cast("date"))
    if year is not None:
        out = out.where(F.col("yr") == year)
    return out.where(F.date_format("bdate", "MM-dd").isin("12-24", "12-25", "12-26")) if christmas else out


def title_matches(air: DataFrame, phrase: str) -> DataFrame:
    """Rows whose folded title holds a folded phrase at word boundaries (D3)."""
    key = "".join(c if c.isalnum() or c == " " else " " for c in phrase)
    return air.where(F.concat(F.lit(" "), plain_key(F.col("title")), F.lit(" ")).contains(" " + " ".join(key.lower().split()) + " "))


#: Forms and the title words that name them, folded.
FORMS = {
    "ballade": "ballade ballades", "barcarolle": "barcarolle barcarolles", "capriccio": "capriccio capriccios caprice", "cassation": "cassation", "concertino": "concertino", "concerto": "concerto concertos concerti konzert", "dance": "dance dances",
    "divertimento": "divertimento divertimentos divertimenti", "elegy": "elegie elegy", "etude": "etude etudes study studies", "fantasia": "fantasia fantasias fantasie fantasy", "fugue": "fugue", "impromptu": "impromptu impromptus", "intermezzo": "intermezzo",
    "lied": "lied lieder song songs", "march": "march marche", "mass": "mass missa", "mazurka": "mazurka mazurkas", "motet": "motet motets", "nocturne": "nocturne nocturnes notturno", "nonet": "nonet", "octet": "octet", "overture": "overture overtures ouverture",
    "partita": "partita partitas", "polonaise": "polonaise", "prelude": "prelude preludes", "quartet": "quartet quartets quartett", "quintet": "quintet", "reverie": "reverie reveries", "rhapsody": "rhapsody rhapsodies", "romance": "romance romances", "rondo": "rondo rondeau",
    "scherzo": "scherzo scherzos scherzi", "septet": "septet", "serenade": "serenade serenades serenata", "sextet": "sextet", "sinfonia": "sinfonia", "sinfonietta": "sinfonietta", "sonata": "sonata sonatas", "sonatina": "sonatina", "suite": "suite suites",
    "symphony": "symphony symphonies symphonie", "toccata": "toccata toccatas", "trio": "trio trios", "variations": "variations", "waltz": "waltz valse",
}


def form_matches(text: Column) -> Column:
    """The forms named in a title, in order of name: its words looked up in one table."""
    named = F.create_map(*(F.lit(x) for form, words in FORMS.items() for word in words.split() for x in (word, form)))
    words = F.split(F.lower(ascii_fold(text)), "[^a-z0-9_]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(named, w)), lambda x: x.isNotNull())))


def forms(air: DataFrame) -> DataFrame:
    """Airings and works by form; a title may name several."""
    distinct = air.where("title is not null").groupBy("title", "ck", "wk").agg(F.count("*").alias("n"))
    return distinct.select("ck", "wk", "n", F.explode(form_matches(F.col("title"))).alias("form")).groupBy("form").agg(F.sum("n").alias("airings"), F.countDistinct("ck", "wk").alias("works"))


def composer_identity(air: DataFrame, phrase: str) -> DataFrame:
    """All rows of each composer of whom any spelling matches, found by a semi join on keys."""
    hit = air.where(F.lower(ascii_fold(F.col("composer"))).contains(phrase.lower())).select("ck").distinct()
    return air.join(hit, "ck", "left_semi")


def conductor_identity(air: DataFrame, phrase: str) -> DataFrame:
    """All tracks that credit a conductor of whom any spelling matches."""
    rows = credits(air).where("role = 'conductor'").withColumn("nk", plain_key(F.col("name")))
    hit = rows.where(F.lower(ascii_fold(F.col("name"))).contains(phrase.lower())).select("nk").distinct()
    return air.join(rows.join(hit, "nk", "left_semi").select("id"), "id", "left_semi")


def composer_lives(air: DataFrame) -> DataFrame:
    """Most frequent birth and death year by composer; ties to the smaller."""
    birth, death = life_years(F.col("composer_line"))
    spans = air.where("ck <> ''").select("ck", birth.alias("born"), death.alias("died")).where("born is not null and died is not null")
    counted = spans.groupBy("ck", "born", "died").agg(F.count("*").alias("n"))
    return counted.groupBy("ck").agg(F.max_by(F.struct("born", "died"), F.struct("n", -F.col("born"), -F.col("died"))).alias("s")).select("ck", "s.born", "s.died")
