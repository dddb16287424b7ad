"""Timestamp texts to instants."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aubade.operators import instants as I
from aubade.operators.instants import DAY, _Clock, offset_intervals, parse_instant_text
from tests.conftest import rows

EPISODES = "pid string, broadcast_date string, start_s string, tz_name string"
TRACKS = "id bigint, episode_pid string, position bigint, time_str string, utc_s string"


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("2008-01-27T01:30:00+01:00", "utc", utc(2008, 1, 27, 0, 30)), ("20080719T003000+0100", "utc", utc(2008, 7, 18, 23, 30)), ("Fri, 04 Apr 2008 01:30:00 BST", "utc", utc(2008, 4, 4, 0, 30)),
        ("2008-06-27 03:00 CEST", "utc", utc(2008, 6, 27, 1)), ("1200184200", "utc", 1200184200), ("1209943800000", "utc", 1209943800), ("2009-05-04T23:30:00.999999Z", "utc", utc(2009, 5, 4, 23, 30)),
        ("14/01/2008 00:30", "local", utc(2008, 1, 14, 0, 30)), ("16 Jan 2008, 12:30 AM", "local", utc(2008, 1, 16, 0, 30)), ("7 March 2009 12.30am", "local", utc(2009, 3, 7, 0, 30)),
        ("12:33", "clock", 33 * 60), ("12.33", "clock", 33 * 60), ("12:31 PM", "clock", 12 * 3600 + 31 * 60), ("1:48 AM:", "clock", 6480), ("1:51: AM", "clock", 6660), ("0040h", "clock", 2400), ("2:25 a.m.", "clock", 8700), ("3:08AM ", "clock", 11280),
    ],
)
def test_forms(text, kind, value):
    assert parse_instant_text(text)[:2] == (kind, value)


@pytest.mark.parametrize("text", [None, "", "   ", "TBC", "--:--", "later", "2015-02-30T25:61:00", "2015-02-30T10:00", "0000-00-00", "25:00", "13:00 AM", "7:60", "x" * 100_000, "12"])
def test_unreadable(text):
    assert parse_instant_text(text) is None


def test_zone_of_a_clock_text():
    assert parse_instant_text("03:36 BST") == ("clock", 12960, 3600)
    assert parse_instant_text("03:04-05:00") == ("clock", 11040, -18000)
    assert parse_instant_text("00:36Z") == ("clock", 2160, 0)
    assert parse_instant_text("00:36 UTC+02:00") == ("clock", 2160, 7200) and parse_instant_text("0:36 EEST") == ("clock", 2160, 10800)


def test_local_readings(spark):
    frame = spark.createDataFrame([(1, utc(2008, 10, 26, 1, 30)), (2, utc(2008, 3, 30, 1, 30)), (3, utc(2008, 7, 1)), (4, None)], "k int, s bigint")
    out = I.resolve_local(frame.withColumn("z", F.lit("Europe/London")), "s", "z", "u", ["Europe/London"])
    assert rows(out.select("k", "u")) == [(1, utc(2008, 10, 26, 0, 30)), (2, utc(2008, 3, 30, 1, 30)), (3, utc(2008, 6, 30, 23)), (4, None)]


@given(st.integers(utc(2000, 1, 1), utc(2030, 1, 1)), st.integers(0, DAY - 60))
def test_next_reading_is_the_first(bound, reading):
    t = _Clock(offset_intervals("Europe/London")).next(bound, reading, None)
    local = datetime.fromtimestamp(t, ZoneInfo("Europe/London"))
    assert t >= bound and local.hour * 3600 + local.minute * 60 + local.second == reading
    for back in (DAY - 3600, DAY, DAY + 3600, 3600):  # no earlier showing
        s = t - back
        seen = datetime.fromtimestamp(s, ZoneInfo("Europe/London"))
        assert s < bound or seen.hour * 3600 + seen.minute * 60 + seen.second != reading


def test_sequence_over_midnight_and_repeats(spark):
    episodes = spark.createDataFrame([("e", "2008-01-05T23:30:00Z", "x", "y"), ("f", None, "x", "y"), ("g", "", "x", "y")], EPISODES)
    tracks = spark.createDataFrame([(1, "e", 0, "23:40", None), (2, "e", 1, "00:10", None), (3, "e", 1, "00:10", None), (4, "e", 2, "later", None), (5, "e", 3, "00:05", None), (6, "f", 0, "00:05", None), (7, None, 0, "00:05", None), (8, "e", 4, "2008-01-05T23:50:00Z", None), (9, "e", 5, "23:55", None), (10, "none", 0, "1:00", None)], TRACKS)
    got = {r.rec_key: r.utc_s for r in I.found_instants(episodes, tracks).collect() if r.src == "tracks"}
    assert got == {"1": utc(2008, 1, 5, 23, 40), "2": utc(2008, 1, 6, 0, 10), "3": utc(2008, 1, 6, 0, 10), "5": utc(2008, 1, 7, 0, 5), "8": utc(2008, 1, 5, 23, 50), "9": utc(2008, 1, 5, 23, 55)}


def test_a_split_group_equals_a_sequential_scan(spark):
    """One night over many partitions, across the end of summer time."""
    start = utc(2019, 10, 25, 22)
    clock = _Clock(offset_intervals("Europe/London"))
    readings, last, want = [], start, {}
    for i in range(400):
        value, offset, full = (i * 4567) % DAY // 60 * 60, (None, 0, 3600)[i % 3], i == 150
        last = start + 5000 if full else clock.next(max(start, last), value, offset)
        want[i] = last
        readings.append(("hot", i, i, start, start + 5000 if full else value, None if full else offset, full))
    frame = spark.createDataFrame(readings, "scan_group string, scan_pos bigint, rec_id bigint, start_s bigint, value bigint, offset_s bigint, is_full boolean")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = I.with_candidates(frame.withColumn("z", F.lit("Europe/London")), "start_s", "value", "z", ["Europe/London"])
        got = {r.rec_id: r.utc_s for r in I.clock_instants(laid).collect()}
        # Partitions have other numbers in a union.
        both = laid.limit(0).select("rec_id").repartition(5).unionByName(I.clock_instants(laid).select("rec_id")).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want and both == len(want)


@pytest.mark.parametrize(("start", "step"), [(utc(2019, 3, 1), 3571), (utc(2019, 10, 20, 22), 86_000), (utc(2460, 3, 20), 40_007), (utc(1750, 1, 1), 9_001)])
def test_nights_of_many_days_over_changes(spark, start, step):
    """Several nights over many partitions, each longer than the days matched, in years on and off the list."""
    clock, readings, want = _Clock(offset_intervals("Europe/London")), [], {}
    for n in range(3):
        last = start + n * 1000
        for i in range(200):
            value, rec = ((i + n) * step) % DAY // 60 * 60, 1000 * n + i
            last = clock.next(max(start + n * 1000, last), value, None)
            want[rec] = last
            readings.append((f"night {n}", i, rec, start + n * 1000, value, None, False))
    frame = spark.createDataFrame(readings, "scan_group string, scan_pos bigint, rec_id bigint, start_s bigint, value bigint, offset_s bigint, is_full boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = I.with_candidates(frame.withColumn("z", F.lit("Europe/London")), "start_s", "value", "z", ["Europe/London"])
        assert {r.rec_id: r.utc_s for r in I.clock_instants(laid).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_years_on_and_off_the_list(spark):
    texts = ["1850-05-01 10:00", "2250-05-01 10:00", "2250-01-01 10:00", "1700-01-02 03:04", "0001-01-01 00:00", "9999-07-31 12:00", "2441-07-01 00:00"]
    episodes = spark.createDataFrame([(t, t) for t in texts], "pid string, broadcast_date string")
    got = {r.pid: r.start_s for r in I.start_instants(episodes).collect()}
    zone = ZoneInfo("Europe/London")
    assert got == {t: round(datetime.fromisoformat(t).replace(tzinfo=zone).timestamp()) for t in texts}


def test_candidates_are_all_instants_that_show_a_reading(spark):
    zone = "Europe/London"
    starts = [utc(2019, 10, 26, 12), utc(2019, 3, 30, 23), utc(2019, 7, 1), utc(2300, 10, 1)]
    frame = spark.createDataFrame([(s, v, zone) for s in starts for v in range(0, DAY, 1800)], "s bigint, v bigint, z string")
    for r in I.with_candidates(frame, "s", "v", "z", [zone]).collect():
        first = datetime.fromtimestamp(r.s, ZoneInfo(zone)).date().toordinal()
        shown = []
        for t in range(r.s - 2 * DAY, r.s + 5 * DAY, 1800):
            local = datetime.fromtimestamp(t, ZoneInfo(zone))
            if local.hour * 3600 + local.minute * 60 == r.v and first <= local.date().toordinal() < first + I.DAYS:
                shown.append(t)
        assert [c for c in (r.c0, r.c1, r.c2, r.c3) if c != I.NEVER] == shown


def test_empty_tables(spark):
    assert I.found_instants(spark.createDataFrame([], EPISODES), spark.createDataFrame([], TRACKS)).count() == 0
