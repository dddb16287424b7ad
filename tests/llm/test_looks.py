"""One look of a text."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aubade.llm.looks import clean, clean_form, comparison_key, found_unclean, match_key
from tests.conftest import rows


@pytest.mark.parametrize(
    ("dirty", "want"),
    [
        ("Étude", "Étude"), ("Ｓymphony　No． ５", "Symphony No. 5"), ("Fan​ta­sia﻿", "Fantasia"), ("G mіnоr", "G minor"), ("Μass", "Mass"), ("ﬂat", "flat"), ("A B\tC", "A B C"),
        ("Вечер", "Вечер"), ("Вeчeр", "Вечер"), ("‎Νυχτερινό‏", "Νυχτερινό"), ("Bĕla", "Bĕla"),
    ],
)
def test_clean_form(dirty, want):
    assert clean_form(dirty) == want


@pytest.mark.parametrize("text", ["", " two  blanks ", "“quoted” – dash", "Вечерний звон", "Το παλιό γεφύρι", "Žár, Łódź", "d'été", "京都", "A flat major"])
def test_clean_texts_stay(text):
    assert clean_form(text) == text


@given(st.text(max_size=60))
def test_clean_form_is_stable_and_composed(text):
    once = clean_form(text)
    assert clean_form(once) == once and unicodedata.is_normalized("NFKC", once)


def test_keys_compare_without_case_and_blanks():
    assert match_key("ＳＴＲＡSSE  1") == match_key("straße 1")


def test_columns(spark):
    df = spark.createDataFrame([(1, "É"), (2, None), (3, "plain"), (3, "É"), (4, "a​" * 50_000)], "id bigint, title string")
    assert [r[0] for r in df.select(clean(F.col("title"))).where("id < 4").collect()] == ["É", None, "plain", "É"]
    assert df.select(comparison_key(F.col("title"))).first()[0] == "é"
    segments = spark.createDataFrame([(9, "ok", "Jіm", "x")], "id bigint, track_title string, composer_name string, field string")
    assert rows(found_unclean({"tracks": df, "segment_events": segments})) == [("segment_events.composer_name", 9), ("tracks.title", 1), ("tracks.title", 3), ("tracks.title", 4)]
    assert found_unclean({"tracks": df.limit(0), "segment_events": segments.limit(0)}).count() == 0


def test_final_line_ends_are_not_plain(spark):
    texts = ["abc\n", "abc\r\n", "abc\u0085", "abc\u2028", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    assert [r[0] for r in df.orderBy("id").select(clean(F.col("t"))).collect()] == [clean_form(t) for t in texts]
    empty = df.limit(0).select("id", F.col("t").alias("track_title"), F.col("t").alias("composer_name"))
    found = found_unclean({"tracks": df.withColumnRenamed("t", "title"), "segment_events": empty}).collect()
    assert sorted(r.row_id for r in found) == [i for i, t in enumerate(texts) if clean_form(t) != t] == [0, 1, 2, 3]
