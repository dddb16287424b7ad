"""Packed names to rows."""

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from aubade.operators import packed as P
from tests.conftest import rows


def names(text):
    return P.split_texts(pa.array([text], pa.string())).to_pylist()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A B (tenor), C D (soprano) | E F", ["A B", "C D", "E F"]), ("A B, violin & viola; C D, organ", ["A B", "C D"]), ("conductor: A B; flute/piccolo: C D", ["A B", "C D"]),
        ("Trio Zininurin / Nova, A B (conductor)", ["Trio Zininurin / Nova", "A B"]), ("X Philharmonic / Ribukorin, Rebecca (conductor)", ["X Philharmonic", "Ribukorin, Rebecca"]),
        ("Trio Bitoletti / Nova,  Befolidrez (conductor)", ["Trio Bitoletti / Nova", "Befolidrez"]), ("Dora-Nenifard, Dmitri Rebecca Suspasky (arr.)", ["Dora-Nenifard", "Dmitri Rebecca Suspasky"]),
        ("Vusomesky, Voices & Viols and A B (conductor)", ["Vusomesky, Voices & Viols", "A B"]), ("Chorus and Orchestra of X Opera, A B [conductor],", ["Chorus and Orchestra of X Opera", "A B"]),
        ('"de Begosurin, Thomas" (violin) & “Radio Choir, Rusivatti”', ["de Begosurin, Thomas", "Radio Choir, Rusivatti"]), ("Baroque Ensemble, Rusivatti / A B", ["Baroque Ensemble, Rusivatti", "A B"]),
        ("Sonumizik, Katharina Nikolaus (1855-1923); arr. Q R (c.1700–1750)", ["Sonumizik, Katharina Nikolaus", "Q R"]), ("Traditional, A B (1900-1950)", ["Traditional", "A B"]), ("A B\nC D (text)", ["A B", "C D"]), ("A;; B;", ["A", "B"]),
        ("A B (organ; continuo), C D (piano, harpsichord)", ["A B", "C D"]), ("violin & viola: A B; piano: C D", ["A B", "C D"]),
        ("violin, viola, cello, flute, oboe, organ & harp: A B; piano: C D", ["A B", "C D"]), ("Lund, Anna Maria Eva Sofia Clara (piano); C D", ["Lund, Anna Maria Eva Sofia Clara", "C D"]),
    ],
)
def test_names(text, want):
    assert names(text) == want


@pytest.mark.parametrize("text", [None, "", "  ", ",;|", "conductor", "(1700-1750)"])
def test_nothing(text):
    assert names(text) == []


def test_unbalanced_signs_are_ordinary():
    assert names('A "B; C') == ['A "B', "C"]
    assert names("A (B; C") == ["A (B", "C"]


def test_long_text():
    assert len(names("; ".join(f"Anna Name{i}" for i in range(20_000)))) == 20_000


@given(st.lists(st.text(alphabet="abcö ()[]\"“”,;|/&\n", max_size=30), max_size=8))
def test_a_batch_equals_its_texts_one_by_one(texts):
    assert P.split_texts(pa.array(texts, pa.string())).to_pylist() == [names(t) for t in texts]
    assert P.split_texts(pa.array(texts, pa.string()), 2).to_pylist() == [n if len(n := names(t)) > 1 else [] for t in texts]


def test_rows_keep_parent_and_place(spark):
    df = spark.createDataFrame([(1, "A B; C D", None, "x"), (2, None, "", "x"), (1, "A B; C D", "E F", "x"), (3, "", "G H | I J", "x")], "id bigint, performers string, composer_line string, item_text string")
    want = [("composer_line", 3, 1, "G H"), ("composer_line", 3, 2, "I J")] + [("performers", 1, 1, "A B")] * 2 + [("performers", 1, 2, "C D")] * 2
    assert rows(P.found_items(df)) == want
    assert ("composer_line", 1, 1, "E F") in rows(P.unpacked(df, "id", ("composer_line",), least=1))
    assert P.found_items(df.limit(0)).count() == 0
