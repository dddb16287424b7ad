"""Canonical text forms as native column expressions: they stay in generated code and need no Python worker."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decomposition doesn't reach, and their spellings in ASCII.
SPECIAL_LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ı": "i", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H"}
SPECIAL_PAIRS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Signs of full width, and blanks of all kinds, and what they are in ASCII.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))).ljust(len(WIDE))


def _fold_table() -> tuple[str, str]:
    """One-to-one folds of accented letters, from the character database: Latin ones to ASCII, those of other scripts to their bare letter."""
    source, target = [], []
    for code in (*range(0x80, 0x590), *range(0x1E00, 0x2000)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD" if code < 0x250 else "NFD", c) if not unicodedata.combining(x))
        if c not in SPECIAL_LETTERS and c not in SPECIAL_PAIRS and len(plain) == 1 and plain != c and plain.isalpha():
            source.append(c)
            target.append(plain)
    return "".join([*source, *SPECIAL_LETTERS]) + WIDE, "".join([*target, *SPECIAL_LETTERS.values()]) + NARROW


_FROM, _TO = _fold_table()


def ascii_fold(text: Column) -> Column:
    """Letters without accents, Latin ones in ASCII; combining marks removed."""
    out = F.translate(text, _FROM, _TO)
    for pair, plain in SPECIAL_PAIRS.items():
        out = F.replace(out, F.lit(pair), F.lit(plain))
    return F.regexp_replace(F.translate(out, "‐‑–—’‘", "----''"), r"\p{M}", "")


def plain_key(text: Column) -> Column:
    """Folded, lower case, letters and digits of all scripts and single blanks only; the key of names (core of C3)."""
    kept = F.regexp_replace(F.lower(ascii_fold(text)), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def _code_page() -> tuple[str, str]:
    """The signs that cp1252 has at 0x80 to 0x9F, and the characters of these numbers."""
    signs = [(bytes([b]).decode("cp1252", "ignore"), chr(b)) for b in range(0x80, 0xA0)]
    return "".join(s for s, _ in signs if s), "".join(c for s, c in signs if s)


CP1252_SIGNS, CP1252_CODES = _code_page()


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 or cp1252 read right, where its bytes are UTF-8 and printable."""
    narrow = F.translate(text, CP1252_SIGNS, CP1252_CODES)
    # The pattern keeps encode() to the characters it has.
    whole = F.when(narrow.rlike(r"\A[\x00-\xff]*[\x80-\xff][\x00-\xff]*\z"), narrow)
    read = F.encode(whole, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(read) & ~read.rlike(r"\p{C}"), read).otherwise(text)


#: What a title's key drops or evens out, in order, as (pattern, replacement).
CANONICAL_STEPS = (
    (r"[(\[]\s*\d{4}(?:\s*[-/]\s*\d{1,4})?\s*[)\]]", " "),
    (r"[(\[]\s*(?:appl|applause|encore|(?:the\s+)?proms\s+\d{4})\s*[)\]]", " "),
    ("&", " and "),
    (r"\s[-?]+\s", " "),
    ('"', ""),
    (r"(^|[^a-z0-9])'+", r"\1"),
    (r"'+([^a-z0-9]|$)", r"\1"),
    (r"\b(op|nos|no)\.?\s*(\d)", r"\1 \2"),
    (r"[.,;:()\[\]]", ""),
    (r"\s+", " "),
)
#: Quotes of all kinds, single ones and double ones.
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛`´", "“”„‟"


def canonical_key(text: Column) -> Column:
    """Key of titles and composers (C3): years and notes on the airing dropped, ampersand spelled out, opus and number marks
    spaced, separating dashes and outer quotes dropped, minor punctuation too; hyphens and apostrophes within words stay."""
    t = F.translate(F.lower(ascii_fold(repaired(text))), SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    for pattern, to in CANONICAL_STEPS:
        t = F.regexp_replace(t, pattern, re.sub(r"\\(\d)", r"$\1", to))
    return F.trim(t)


#: Number words and their digits; words for 'and'.
NUMBER_WORDS = {w: str(i) for i, w in enumerate("two three four five six seven eight nine ten eleven twelve".split(), 2)}
AND_WORDS = ("et", "und")


def token_key(canon: Column) -> Column:
    """The words of a canonical key in order, with joining signs, 'major', number words and words for 'and' evened out (C14; token path of C19)."""
    t = F.translate(F.translate(canon, "-", " "), "'", "")
    t = F.regexp_replace(t, r"\b(in [a-g](?: (?:flat|sharp))?) major\b", "$1")
    same = F.create_map(*(F.lit(x) for pair in (*NUMBER_WORDS.items(), *((w, "and") for w in AND_WORDS)) for x in pair))
    words = F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.array_join(F.array_sort(words), " ")


def normal_composer(text: Column) -> Column:
    """Without a trailing bracket and enclosing single quotes (C4)."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", "")), r"^'(.*)'$", "$1")


def strip_arranger(composer: Column, line: Column) -> Column:
    """A composer cut at the first comma where its line ends as an arranger's."""
    head = F.trim(F.substring_index(composer, ",", 1))
    return F.when(line.rlike(r"(?i)\(arranger\)\s*$") & (head != ""), head).otherwise(composer)


def composer_key(composer: Column, line: Column | None = None) -> Column:
    """The grouping key of a composer: the arranger cut off, the bracket too, then canonical."""
    return F.coalesce(canonical_key(normal_composer(composer if line is None else strip_arranger(composer, line))), F.lit(""))


def work_key(title: Column) -> Column:
    """The native grouping key of a title: the sorted words of its canonical key."""
    return F.coalesce(token_key(canonical_key(title)), F.lit(""))


def surname(name: Column) -> Column:
    """Last word of a name's key, generations and 'the elder' left off; anonymous and traditional are one word each."""
    key = F.trim(F.regexp_replace(plain_key(name), r" (?:jr|sr|i|ii|iii|the elder|the younger)$", ""))
    return F.when(key.rlike("^anon"), "anonymous").when(key.rlike("^trad"), "traditional").otherwise(F.element_at(F.split(key, " "), -1))


def catalogue_refs(title: Column) -> Column:
    """Catalogue numbers as 'bwv12', sorted and distinct; KV reads K, leading zeros dropped."""
    found = F.regexp_extract_all(F.lower(ascii_fold(title)), F.lit(r"\b((?:bwv|hwv|rv|kv|k|d|twv|wq|woo|hob|s|bb|op) ?\.? ?0*\d+)"), F.lit(1))
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ .]", ""), r"^([a-z]+?)v?0*(\d+)$", "$1$2"))
    keep_v = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ .]", ""), r"^([a-z]+)0*(\d+)$", "$1$2"))
    named = F.transform(F.arrays_zip(tidy.alias("t"), keep_v.alias("v")), lambda z: F.when(z["v"].rlike("^kv"), z["t"]).otherwise(z["v"]))
    return F.array_sort(F.array_distinct(named))


def catalogue_ref(title: Column) -> Column:
    """First catalogue number or null."""
    refs = catalogue_refs(title)
    return F.when(F.size(refs) > 0, refs[0])


def key_signatures(title: Column) -> Column:
    """Keys such as 'f sharp minor' named in a title, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\bin ([a-g](?: flat| sharp)? (?:major|minor))\b"), F.lit(1))))


def opus_numbers(title: Column) -> Column:
    """Opus numbers as text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\bop\.? ?(\d+)"), F.lit(1))))


def work_numbers(title: Column) -> Column:
    """Numbers after 'no', distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\bno\.? ?(\d+)"), F.lit(1))))


#: Words that say little about which work a title names.
GENERIC_WORDS = ["a", "and", "for", "from", "in", "major", "minor", "no", "of", "on", "op", "the", "to", "with"]


def tokens_of(canon: Column) -> Column:
    """Distinct words of a canonical key without generic words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(canon, " "), lambda w: (w != "") & ~w.isin(GENERIC_WORDS))))


def significant_tokens(title: Column) -> Column:
    """``tokens_of`` of a title's canonical key."""
    return tokens_of(canonical_key(title))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Shared share of two sets; ``empty`` is the value of two empty sets (C24 has both conventions)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def slug(text: Column, longest: int = 60) -> Column:
    """URL part: key with hyphens, cut; a hash where nothing is left."""
    base = F.regexp_replace(F.substring(plain_key(text), 1, longest), " ", "-")
    return F.when(base == "", F.concat(F.lit("x-"), F.substring(F.sha1(text), 1, 8))).otherwise(F.regexp_replace(base, "-+$", ""))


def candidate_id(a: Column, b: Column) -> Column:
    """Stable id of an unordered pair."""
    return F.substring(F.sha1(F.concat(F.least(a, b), F.lit("\0"), F.greatest(a, b))), 1, 8)


def life_years(line: Column) -> tuple[Column, Column]:
    """Birth and death as bare four-digit years in brackets; marked or open years give null."""
    span = r"[(\[](\d{4})\s*[-–]\s*(\d{4})[)\]]"
    return F.regexp_extract(line, span, 1).try_cast("int"), F.regexp_extract(line, span, 2).try_cast("int")


def hrefs(html: Column) -> Column:
    """Link targets of an HTML text."""
    return F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']+)[\"']"), F.lit(1))


def duration_text(seconds: Column) -> Column:
    """'1:02:03' or '2:03' (C34)."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
