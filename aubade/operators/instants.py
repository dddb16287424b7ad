"""Mixed timestamp texts to one UTC instant.

Each distinct text of a batch is parsed into a local reading and the zone it names. A reading with an offset is
converted by arithmetic; one without is matched as-of against the exploded offset intervals of its zone:
two matching intervals mean an ambiguous reading, none a nonexistent one, one gives the offset directly.
A clock text has no date: its reading on each of the days it may fall on is matched in the same way, which gives the
instants that show it, and a pass over the night's sequence picks the first that is not before the previous one.

Defined results: null, empty and unreadable texts give no instant; impossible dates (30 February, hour 25)
are unreadable; years go from 1 to 9999; fractions are cut to whole seconds; equal rows stay separate rows; empty tables
give empty results; further columns of the inputs are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import date, datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aubade.session import pinned

DAY = 86_400
HOME = "Europe/London"
#: Where the clocks of a night without a readable start or timestamp begin; only differences are taken from it.
UNDATED_S = 946_684_800

#: Zone names in texts and their offsets in seconds.
NAMED_OFFSETS = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200, "eet": 7200, "eest": 10800, "msk": 10800}
#: The first three letters of the months in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_ZONE = "(" + "|".join(sorted(NAMED_OFFSETS, key=len, reverse=True)) + r"|(?:utc|gmt)?[+-]\d{2}:?\d{2})?"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[t ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*" + _ZONE + "$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?\s*" + _ZONE + "$"
_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?\s*(?:([ap])\.?m\.?)?\s*" + _ZONE + "$"
_WORDS = r"^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4}),?\s+(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:\.\d+)?)?\s*(?:([ap])\.?m\.?)?\s*" + _ZONE + "$"
_CLOCK = r"^(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?\s*:?\s*(?:([ap])\.?m\.?)?\s*:?\s*" + _ZONE + "$"
_MILITARY = r"^(\d{2})(\d{2})h$"
_EPOCH_DAY = date(1970, 1, 1).toordinal()
_EPOCH = r"-?\d{9,14}"


#: Years whose changes are listed. Before them a zone's first offset holds; after them, rules recur with the calendar,
#: which is the same every 400 years to the day of the week.
FIRST_YEAR, LAST_YEAR = 1800, 2440
CYCLE_YEARS, CYCLE_S = 400, 146_097 * DAY


@lru_cache(maxsize=64)
def offset_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(utc_from, utc_to, offset) of a zone, from the zone database; the ends are open."""
    rules = ZoneInfo(zone)
    at = lambda s: int(datetime.fromtimestamp(s, timezone.utc).astimezone(rules).utcoffset().total_seconds())
    low = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    high = int(datetime(LAST_YEAR + 1, 12, 31, tzinfo=timezone.utc).timestamp())
    changes, before = [], at(low)
    for day in range(low + DAY, high, DAY):
        after = at(day)
        if after != before:
            a, b = day - DAY, day
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if at(mid) != before else (mid, b)
            changes.append((b, after))
            before = after
    starts = [(-(1 << 60), at(low)), *changes]
    return tuple((s, starts[i + 1][0] if i + 1 < len(starts) else 1 << 60, o) for i, (s, o) in enumerate(starts))


def interval_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """One row per zone and local year: ``tz_name, tz_year, tz_intervals`` (array of utc_from, local_from, local_to, offset_s).

    Each interval is exploded to the local years it touches, and a few days around them, so that an as-of lookup needs
    one equi-join row. The table has zones x 641 rows whatever the data, so it may be broadcast.
    """
    rows = []
    for zone in zones:
        spans = [(a, a + o, b + o, o) for a, b, o in offset_intervals(zone)]
        first = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            low = int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) - 6 * DAY
            high = int(datetime(year + 1, 1, 1, tzinfo=timezone.utc).timestamp()) + 6 * DAY
            while spans[first][2] <= low:
                first += 1
            mine = []
            for span in spans[first:]:
                if span[1] >= high:
                    break
                mine.append(span)
            rows.append((zone, year, mine))
    return spark.createDataFrame(rows, "tz_name string, tz_year int, tz_intervals array<struct<utc_from:bigint,local_from:bigint,local_to:bigint,offset_s:int>>")


def _year(second: Column) -> Column:
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / DAY).cast("int")))


def _cycles(year: Column) -> Column:
    """How many times 400 years a year lies beyond those listed."""
    return F.greatest(F.ceil((year - LAST_YEAR) / CYCLE_YEARS), F.lit(0))


def with_intervals(df: DataFrame, second: str, zone: str, zones: list[str]) -> DataFrame:
    """Add ``tz_shift`` and ``tz_intervals``: the offset intervals of a zone around a second, which holds once the shift is taken off it."""
    spans = F.broadcast(interval_table(df.sparkSession, zones))
    year = _year(F.col(second))
    keyed = df.withColumns({"tz_key_year": F.greatest(year - _cycles(year) * CYCLE_YEARS, F.lit(FIRST_YEAR)), "tz_shift": _cycles(year) * CYCLE_S})
    return keyed.join(spans, (F.col(zone) == F.col("tz_name")) & (F.col("tz_key_year") == F.col("tz_year")), "left").drop("tz_key_year", "tz_name", "tz_year")


def showing(local: Column) -> Column:
    """The instants that show a local reading, by the intervals that hold it: none if it is skipped, two if it occurs twice."""
    return F.transform(F.filter("tz_intervals", lambda i: (i["local_from"] <= local) & (local < i["local_to"])), lambda i: local - i["offset_s"])


def resolve_local(df: DataFrame, local_s: str, zone: str, out: str, zones: list[str]) -> DataFrame:
    """Add ``out``: the UTC second of a local reading (seconds since 1970 as if local time were UTC) in a named zone.

    One matching interval gives the offset; of two (a reading that occurs twice) the earlier instant is taken; with
    none (a skipped reading) the offset in force before the change holds. Null readings give null.
    """
    joined = with_intervals(df, local_s, zone, zones)
    local = F.col(local_s) - F.col("tz_shift")
    shown = showing(local)
    before = F.filter("tz_intervals", lambda i: i["local_to"] <= local)
    utc = F.when(F.size(shown) >= 1, F.array_min(shown)).otherwise(local - F.element_at(before, -1)["offset_s"])
    return joined.withColumn(out, utc + F.col("tz_shift")).drop("tz_shift", "tz_intervals")


#: Days from a start's on whose readings are matched for each clock text, and most instants that show one on them.
DAYS = 3
CANDIDATES = 4
NEVER = 1 << 62


def with_candidates(df: DataFrame, start_s: str, clock_s: str, zone: str, zones: list[str]) -> DataFrame:
    """Add ``c0`` to ``c3``: in order the instants that show a clock reading on the days from a start's local day on; NEVER beyond."""
    joined = with_intervals(df, start_s, zone, zones)
    start = F.col(start_s) - F.col("tz_shift")
    home = F.element_at(F.filter("tz_intervals", lambda i: i["utc_from"] <= start), -1)["offset_s"]
    midnight = F.floor((start + home) / DAY) * DAY
    shown = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DAYS - 1)), lambda k: showing(midnight + k * DAY + F.col(clock_s)))))
    found = joined.withColumn("tz_shown", shown)
    return found.select("*", *(F.coalesce(F.get("tz_shown", F.lit(i)) + F.col("tz_shift"), F.lit(NEVER)).alias(f"c{i}") for i in range(CANDIDATES))).drop("tz_shift", "tz_intervals", "tz_shown")


_FORMS = tuple(
    (re.compile(pattern), order)
    for pattern, order in ((_ISO, "ymdHMSz"), (_WORDS, "dmyHMSpz"), (_SLASH, "dmyHMSpz"), (_BASIC, "ymdHMSz"), (_CLOCK, "HMSpz"), (_MILITARY, "HM"))
)


def _zone_offset(zone: str | None) -> int | None:
    if not zone:
        return None
    if zone in NAMED_OFFSETS:
        return NAMED_OFFSETS[zone]
    digits = zone[-6:].strip("utcgm+-").replace(":", "")
    return (-1 if "-" in zone else 1) * (int(digits[:2]) * 3600 + int(digits[2:]) * 60)


def parse_instant_text(text: str | None) -> tuple[str, int, int | None] | None:
    """(kind, value, offset) of one text, or None if it names no valid time.

    kind 'utc': value is the UTC second. 'local': value is the local reading in seconds, no zone named.
    'clock': value is the second of the day, offset the named zone's or None.
    """
    t = " ".join(text.lower().split()) if text else ""
    if re.fullmatch(_EPOCH, t):
        n = int(t)
        return ("utc", n // 1000 if abs(n) >= 100_000_000_000 else n, None) if abs(n) >= 100_000_000 else None
    for pattern, order in _FORMS:
        if m := pattern.match(t):
            got = dict(zip(order, m.groups(), strict=True))
            hour, minute, second, half, offset = int(got["H"]), int(got["M"]), int(got.get("S") or 0), got.get("p"), _zone_offset(got.get("z"))
            if minute > 59 or second > 59 or hour > (12 if half else 23):
                return None
            if half:
                hour = hour % 12 + 12 * (half == "p")
            if "y" not in got:
                return "clock", (0 if hour == 12 and not half else hour) * 3600 + minute * 60 + second, offset
            month = int(got["m"]) if got["m"].isdigit() else MONTHS.split().index(got["m"]) + 1 if got["m"] in MONTHS.split() else 0
            try:
                day = date(int(got["y"]), month, int(got["d"])).toordinal() - _EPOCH_DAY
            except ValueError:
                return None
            local = day * DAY + hour * 3600 + minute * 60 + second
            return ("local", local, None) if offset is None else ("utc", local - offset, None)
    return None


@F.pandas_udf(T.StructType([T.StructField("ts_kind", T.StringType()), T.StructField("ts_value", T.LongType()), T.StructField("ts_offset_s", T.LongType())]))
def _parse(texts: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(texts)
    parsed = [parse_instant_text(x) or (None, None, None) for x in distinct]
    frame = pd.DataFrame([*parsed, (None, None, None)], columns=["ts_kind", "ts_value", "ts_offset_s"]).astype({"ts_value": "Int64", "ts_offset_s": "Int64"})
    return frame.iloc[codes].reset_index(drop=True)  # code -1, null, takes the last row


def parse_instant_texts(df: DataFrame, text: str) -> DataFrame:
    """Add ``ts_kind, ts_value, ts_offset_s`` for a column of texts, as ``parse_instant_text``.

    An Arrow function over each batch's distinct texts: built-in regular expressions for the same formats were measured
    at 20 times the CPU time, as their plan is too large for one compiled method.
    """
    return df.withColumn("ts_parsed", _parse(F.col(text))).select("*", "ts_parsed.*").drop("ts_parsed")


def start_instants(episodes: DataFrame, key: str = "pid", text: str = "broadcast_date", zone: str = HOME) -> DataFrame:
    """``key, start_s``: the readable full timestamps of a table. A clock text alone is not a start."""
    parsed = parse_instant_texts(episodes.select(key, text), text).where("ts_kind <> 'clock'")
    parsed = parsed.select(key, F.col("ts_kind").alias("kind"), F.col("ts_value").alias("value"), F.lit(zone).alias("home_zone"))
    placed = resolve_local(parsed, "value", "home_zone", "home_utc", [zone])
    utc = F.when(F.col("kind") == "utc", F.col("value")).otherwise(F.col("home_utc"))
    return placed.select(key, utc.alias("start_s")).where("start_s is not null")


class _Clock:
    """The earliest instant from a bound on that shows a reading: for readings in a named offset, and nights of more days than were matched."""

    def __init__(self, spans: tuple[tuple[int, int, int], ...]):
        self.starts = [a for a, _, _ in spans]
        self.spans = spans
        self.listed = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())

    def span(self, t: int) -> int:
        return bisect_right(self.starts, t) - 1

    def next(self, bound: int, reading: int, offset: int | None) -> int:
        if offset is not None:
            return bound + (reading - offset - bound) % DAY
        shift = max(0, -(-(bound - self.listed) // CYCLE_S)) * CYCLE_S
        bound -= shift
        i = self.span(bound)
        while True:
            _, end, home = self.spans[i]
            t = bound + (reading - home - bound) % DAY
            if t < end:
                return t + shift
            bound, i = end, i + 1


_SUMMARY = "part int, first_group string, last_group string, segments bigint, first_t bigint, first_value bigint, first_offset bigint, head_reset boolean, head_home boolean, start_s bigint, last_t bigint"
_SCAN_OUT = "rec_id bigint, scan_group string, utc_s bigint, start_s bigint"


def _chain(summaries: dict[int, Row], clock: _Clock, known: dict[int, int]) -> tuple[dict[int, int], set[int]]:
    """(carries, to scan): the instant each partition takes over from its night's rows before it.

    ``known``: last instants of partitions already scanned with their carry. A partition whose rows the carry moves over a
    change of the clocks must be scanned with it; what hangs on that one waits.
    """
    carries: dict[int, int] = {}
    again: set[int] = set()
    before = carry = None
    for part, row in sorted(summaries.items()):
        out = row["last_t"]
        if before is not None and row["first_group"] == before:
            if carry is None:
                out = None
            else:
                carries[part] = carry
                if row["segments"] == 1 and not row["head_reset"]:
                    shifted = clock.next(max(row["start_s"], carry), row["first_value"], row["first_offset"])
                    shift = shifted - row["first_t"]
                    if shift and row["head_home"] and len({clock.span(t) for t in (row["first_t"], out, shifted, out + shift)}) > 1:
                        if part not in known:
                            again.add(part)
                        out = known.get(part)
                    else:
                        out += shift
            if row["segments"] > 1:  # the next partition goes on with another night
                out = row["last_t"]
        before, carry = row["last_group"], out
    return carries, again


def clock_instants(readings: DataFrame, zone: str = HOME) -> DataFrame:
    """Instants of clock texts in sequence.

    ``readings``: ``scan_group, scan_pos, rec_id, start_s, value, offset_s, is_full`` and ``c0`` to ``c3`` of
    ``with_candidates`` - readable rows only. In each group, ordered by position then id, a reading stands for the
    earliest instant showing it from the group's start and the previous row's instant on; a full timestamp stands for
    itself.

    Rows are range-partitioned by (group, position, id), so a group of any size is split over tasks. A first pass
    summarises each partition in one row; the carries between partitions are chained from these few rows; the second
    pass scans all partitions at once with their carries. Where a carry moves a partition's rows over a change of the
    clocks, that partition is scanned with its carry before the chain goes on; such partitions of all nights are scanned
    together, and nothing else is read. Memory is one Arrow batch a task.
    """
    spark = readings.sparkSession
    spans = offset_intervals(zone)
    order = ["scan_group", "scan_pos", "rec_id"]
    laid = pinned(readings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("scan_part", F.spark_partition_id()))

    def scan(carries: dict[int, int], summarise: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            clock, group, last = _Clock(spans), None, None
            part = first_group = first = None
            segments, head_reset, head_home, start = 0, False, False, None
            for pdf in batches:
                out = []
                if part is None and len(pdf):
                    part = int(pdf.scan_part.iloc[0])
                shown = zip(*(pdf[f"c{i}"].tolist() for i in range(CANDIDATES)), strict=True)
                for g, s, v, o, full, instants in zip(pdf.scan_group.tolist(), pdf.start_s.tolist(), pdf.value.tolist(), pdf.offset_s.tolist(), pdf.is_full.tolist(), shown, strict=True):
                    if g != group or segments == 0:
                        group, segments, start = g, segments + 1, s
                        last = s
                        if segments == 1:
                            first_group = g
                            if part in carries:
                                last = carries[part]
                    if full:
                        last = int(v)
                        head_reset |= segments == 1
                        if first is None:
                            first = (last, -1, None)
                    else:
                        offset = None if o != o or o is None else int(o)
                        bound = max(s, last)
                        last = NEVER
                        if offset is None and bound <= instants[-1]:
                            last = next((t for t in instants if t >= bound), NEVER)
                        if last == NEVER:
                            last = clock.next(bound, int(v), offset)
                        head_home |= offset is None and segments == 1
                        if first is None:
                            first = (last, int(v), offset)
                    out.append(last)
                if not summarise:
                    yield pd.DataFrame({"rec_id": pdf.rec_id, "scan_group": pdf.scan_group, "utc_s": out, "start_s": pdf.start_s})
            if summarise and segments:
                yield pd.DataFrame([{"part": part, "first_group": first_group, "last_group": group, "segments": segments, "first_t": first[0], "first_value": first[1], "first_offset": first[2], "head_reset": head_reset, "head_home": head_home, "start_s": start, "last_t": last}])

        return run

    summaries = {row["part"]: row for row in laid.mapInPandas(scan({}, True), _SUMMARY).collect()}  # one row a partition
    clock, known = _Clock(spans), {}
    carries, again = _chain(summaries, clock, known)
    while again:
        scanned = laid.mapInPandas(scan({p: carries[p] for p in again}, True), _SUMMARY).rdd
        known |= {row["part"]: row["last_t"] for row in spark.sparkContext.runJob(scanned, list, sorted(again))}
        carries, again = _chain(summaries, clock, known)
    return laid.mapInPandas(scan(carries, False), _SCAN_OUT)


def track_instants(tracks: DataFrame, episodes: DataFrame, zone: str = HOME, undated: bool = False) -> DataFrame:
    """``rec_id, scan_group, utc_s, start_s``: one row per readable track of an episode with a readable start.

    With ``undated``, also of the other episodes: their clocks begin a day before the first full timestamp, else anywhere.
    """
    starts = start_instants(episodes.select("pid", "broadcast_date"), zone=zone)
    parsed = parse_instant_texts(tracks.select("id", "episode_pid", "position", "time_str"), "time_str").where("ts_kind is not null and episode_pid is not null")
    flat = parsed.select(F.col("id").alias("rec_id"), F.col("episode_pid").alias("scan_group"), F.col("position").alias("scan_pos"), F.col("ts_kind").alias("kind"), F.col("ts_value").alias("value"), F.col("ts_offset_s").alias("offset_s"))
    joined = flat.join(starts.withColumnRenamed("pid", "scan_group"), "scan_group", "left" if undated else "inner")
    placed = resolve_local(joined.withColumn("home_zone", F.lit(zone)), "value", "home_zone", "home_utc", [zone])
    readings = placed.select("scan_group", "scan_pos", "rec_id", "start_s", F.when(F.col("kind") == "local", F.col("home_utc")).otherwise(F.col("value")).alias("value"), "offset_s", (F.col("kind") != "clock").alias("is_full"))
    readings = readings.where("value is not null").withColumn("home_zone", F.lit(zone))
    if undated:
        full = F.min(F.when(F.col("is_full"), F.col("value"))).over(Window.partitionBy("scan_group"))
        readings = readings.withColumn("start_s", F.coalesce("start_s", full - DAY, F.lit(UNDATED_S)))
    return clock_instants(with_candidates(readings, "start_s", "value", "home_zone", [zone]).drop("home_zone"), zone)


def found_instants(episodes: DataFrame, tracks: DataFrame) -> DataFrame:
    """``src, rec_key, utc_s`` of all readable episode starts and track clock texts."""
    starts = start_instants(episodes).select(F.lit("episodes").alias("src"), F.col("pid").alias("rec_key"), F.col("start_s").alias("utc_s"))
    clocks = track_instants(tracks, episodes).select(F.lit("tracks").alias("src"), F.col("rec_id").cast("string").alias("rec_key"), "utc_s")
    return starts.unionByName(clocks)
