"""One consistent form for texts that look alike but differ in their characters.

Clean form: default-ignorable characters removed, every blank an ordinary space, compatibility composition (NFKC), and
the letters of each word in one script. The comparison key is the clean form after full case folding, blanks squeezed.
Each distinct value of an Arrow batch is worked once; plain ASCII values skip Python.

Defined results: null stays null, an empty text is clean; curly quotes, dashes, doubled and outer blanks and words
wholly in one script are clean; a word whose letters fit no single script keeps those without a look-alike; texts of any
length are read whole; repeated rows stay repeated; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that have no look of their own (default-ignorable), as ranges.
_IGNORABLE = "­͏؜ᅟ-ᅠ឴-឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
#: Letters that look alike, each line in one order of scripts.
_LATIN_CYRILLIC = ("ABCEHIJKMOPSTXYaceijopsxyhdqwl", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝӏ")
_LATIN_GREEK = ("ABEZHIKMNOPTYXovaipukxj", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχϳ")
_CYRILLIC_GREEK = ("АВЕНІКМОРТХаорх", "ΑΒΕΗΙΚΜΟΡΤΧαορχ")
_LATIN_ARMENIAN = ("OSLUghounqpf", "ՕՏԼՍցհօսոզքֆ")
_LATIN_CHEROKEE = ("ABCDEGHIJKLMPRSTVWYZ", "ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᎩᏃ")
_LATIN_LISU = ("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ")

_DROP = re.compile(f"[{_IGNORABLE}]")
_BLANK = re.compile(r"[\s⠀]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_PLAIN = r"\A[\x20-\x7e]*\z"


def _alike() -> dict[tuple[str, str], dict[str, str]]:
    out: dict[tuple[str, str], dict[str, str]] = {}
    tables = {("latin", "cyrillic"): _LATIN_CYRILLIC, ("latin", "greek"): _LATIN_GREEK, ("cyrillic", "greek"): _CYRILLIC_GREEK, ("latin", "armenian"): _LATIN_ARMENIAN, ("latin", "cherokee"): _LATIN_CHEROKEE, ("latin", "lisu"): _LATIN_LISU}
    for (a, b), (left, right) in tables.items():
        out[a, b] = dict(zip(left, right, strict=True))
        out[b, a] = dict(zip(right, left, strict=True))
    return out


_ALIKE = _alike()
SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "cherokee", "lisu")


@lru_cache(maxsize=4096)
def script_of(letter: str) -> str | None:
    """One of SCRIPTS; None for other scripts and signs."""
    if letter < "\u0080":
        return "latin" if letter.isalpha() else None
    name = unicodedata.name(letter, "").split(" ")[0].lower()
    return name if name in SCRIPTS else None


def _one_script(word: str) -> str:
    """The word with look-alikes brought into the script that the rest of it is in."""
    parts = unicodedata.normalize("NFD", word)
    letters = [(c, script_of(c)) for c in parts]
    used = {s for _, s in letters if s}
    if len(used) < 2:
        return word
    foreign = lambda to: [c for c, s in letters if s and s != to]
    missing = {to: sum(c not in _ALIKE.get((script_of(c), to), {}) for c in foreign(to)) for to in used}
    target = min(SCRIPTS, key=lambda to: (missing.get(to, 1 << 30), len(foreign(to)), SCRIPTS.index(to)))
    return "".join(c if not s or s == target else _ALIKE.get((s, target), {}).get(c, c) for c, s in letters)


def clean_form(text: str) -> str:
    """The clean form of one text."""
    if text.isascii() and text.isprintable():
        return text
    bare = unicodedata.normalize("NFKC", _BLANK.sub(" ", _DROP.sub("", text)))
    bare = _BLANK.sub(" ", bare)
    return bare if bare.isascii() else unicodedata.normalize("NFKC", _WORD.sub(lambda m: _one_script(m.group()), bare))


def match_key(text: str) -> str:
    """The comparison key of one text: clean, fully case-folded, blanks squeezed."""
    return " ".join(unicodedata.normalize("NFKC", clean_form(text).casefold()).split())


@lru_cache(maxsize=1 << 15)
def _remembered(text: str, work: Callable[[str], str]) -> str:
    return work(text)


def _per_distinct(values: pd.Series, work: Callable[[str], str]) -> pd.Series:
    """Each distinct value of a batch once; a worker remembers short ones from batch to batch."""
    codes, distinct = pd.factorize(values)
    done = pd.Series([*(_remembered(x, work) if len(x) <= 200 else work(x) for x in distinct), None], dtype=object)
    return done.iloc[codes].reset_index(drop=True)


@F.pandas_udf(T.StringType())
def _clean(values: pd.Series) -> pd.Series:
    return _per_distinct(values, clean_form)


@F.pandas_udf(T.StringType())
def _key(values: pd.Series) -> pd.Series:
    return _per_distinct(values, match_key)


def clean(text: Column) -> Column:
    """Clean form of a text column."""
    return F.when(text.rlike(_PLAIN), text).otherwise(_clean(text))


def comparison_key(text: Column) -> Column:
    """Comparison key of a text column."""
    return _key(text)


FIELDS = (("tracks", "title"), ("segment_events", "track_title"), ("segment_events", "composer_name"))


def found_unclean(tables: dict[str, DataFrame]) -> DataFrame:
    """``field, row_id`` of each value that differs from its clean form."""
    out = None
    for table, column in FIELDS:
        odd = tables[table].select("id", column).where(F.col(column).isNotNull() & ~F.col(column).rlike(_PLAIN))
        part = odd.where(_clean(F.col(column)) != F.col(column)).select(F.lit(f"{table}.{column}").alias("field"), F.col("id").alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out
