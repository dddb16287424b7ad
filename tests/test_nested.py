"""Nested JSON to flat tables."""

import json

import pytest

from aubade.operators import nested as N
from tests.conftest import rows

EPISODES = "pid string, raw_json string, segments_raw_json string, link string, payload string"
SEGMENTS = "id bigint, contributions_json string, child_no string"


def links(spark, episodes=(), segments=()):
    e = spark.createDataFrame([(*x, "l", "p") for x in episodes], EPISODES)
    s = spark.createDataFrame([(*x, "c") for x in segments], SEGMENTS)
    return rows(N.found_links(e, s))


def test_events_at_any_depth(spark):
    text = json.dumps({"segment_events": [{"pid": "a", "segment": {"contributions": {"name": "N"}}}, None, {"pid": "b", "segment": None, "segment_events": {"pid": "c", "segment": {"contributions": [{"role": "r"}, 3, {"name": None}]}}}]})
    assert links(spark, [("e", None, text)]) == [("credit", "a", 1, "N"), ("credit", "c", 1, ""), ("credit", "c", 3, ""), ("event", "b", 1, "c"), ("event", "e", 1, "a"), ("event", "e", 3, "b")]


def test_programme(spark):
    text = json.dumps({"programme": {"versions": {"pid": "v"}, "categories": [{"id": "x"}, {"key": "no id"}], "parent": {"programme": {"pid": "p1", "parent": {"programme": {"pid": "p2", "parent": None}}}}}})
    assert links(spark, [("e", text, None)]) == [("ancestor", "e", 1, "p1"), ("ancestor", "e", 2, "p2"), ("category", "e", 1, "x"), ("category", "e", 2, None), ("version", "e", 1, "v")]


def test_broken_texts_give_nothing(spark):
    whole = '{"segment_events":[{"pid":"a"}]}'
    bad = [None, "", " ", "[]", "3", "null", '"x"', whole[:-1], whole + "x", '{"segment_events":NaN}', "[" * 100_000]
    assert links(spark, [(str(i), b, b) for i, b in enumerate(bad)], [(i, b) for i, b in enumerate(bad)]) == []


def test_credits_of_rows_repeat_and_keep_places(spark):
    assert links(spark, segments=[(1, '[{"name":"A"},{"name":"A"}]'), (1, '{"name":"B"}'), (None, '[{"name":"C"}]')]) == [("row_credit", None, 1, "C"), ("row_credit", "1", 1, "A"), ("row_credit", "1", 1, "B"), ("row_credit", "1", 2, "A")]


def test_very_long_text(spark):
    text = json.dumps({"segment_events": [{"pid": f"p{i}"} for i in range(50_000)]})
    assert len(links(spark, [("e", None, text)])) == 50_000


def test_any_nesting(spark):
    deep = 30_000
    event = lambda i: f'"segment_events": {{"pid": "p{i}", "segment": {{"contributions": {{"name": "n{i}"}}}}'
    text = "{" + "".join(event(i) + ", " for i in range(deep)) + event(deep) + "}" + "}" * (deep + 1)
    assert len(links(spark, [("e", None, text), ("f", None, text[:-1])])) == 2 * (deep + 1)
    chain = '{"programme": {"pid": "a", "parent": ' * deep + "null" + "}}" * deep
    assert len(links(spark, [("e", chain, None)])) == deep - 1
    value = json.dumps({"programme": {"versions": [{"pid": "v", "deep": "X"}]}}).replace('"X"', "[" * deep + "{}" + "]" * deep)
    e = spark.createDataFrame([("e", value, None, "", "")], EPISODES)
    assert N.archive_links(e, spark.createDataFrame([], SEGMENTS)).first().payload.count("[") == deep


def test_the_reader_by_loops_reads_as_the_other():
    good = ['{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {}, "c": [], "a": {"d": [[], {"e": " "}]}}', " [ ] ", "0", '"x"', '[1 , {"a" : "b"} ]', "-0.0"]
    for text in good:
        assert N._read_by_loop(text) == json.loads(text)
    bad = ["", " ", "{", "[1,]", '{"a"}', '{"a":1,}', "{a:1}", "[1 2]", "01", "tru", '"x', "[1]]", "NaN", "[NaN]", "]", '{"a":1]', "1.", "+1", "[1}"]
    for text in bad:
        with pytest.raises(ValueError):
            N._read_by_loop(text)


def test_tables_by_tag(spark, tmp_path):
    text = json.dumps({"segment_events": [{"pid": "a", "version_offset": 7, "segment": {"track_title": "T", "contributions": [{"name": "N", "role": "R"}]}}]})
    e = spark.createDataFrame([("e", None, text, "", "")], EPISODES)
    N.write_tables(N.archive_links(e, spark.createDataFrame([], SEGMENTS)), str(tmp_path / "t"))
    event = N.read_table(spark, str(tmp_path / "t"), "event").first()
    assert (event.parent_key, event.version_offset, event.segment.track_title) == ("e", 7, "T")
    assert N.read_table(spark, str(tmp_path / "t"), "credit").first().role == "R"
