"""Several names packed in one text to one row per name.

The delimiter scan runs on the bytes of an Arrow string column: quote parity, bracket depth and delimiter masks are
computed for a whole batch at once, child offsets derived from them. A second step, per distinct text, joins pieces
that belong to one name (surname-first names, ensembles with signs in their names) and takes off roles, years, notes
and quotes. The names come out as a list array, flattened with the parents' ordinals.

Defined results: null, empty and blank texts give no item; empty items don't count; an unbalanced quote or bracket is
an ordinary sign; a text with fewer than ``least`` items gives no rows; repeated rows stay repeated; texts are read
whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words for what a contributor does.
ROLES = frozenset(
    "accordion alto arr arranged arranger bandoneon baritone bass bass-baritone bassoon celesta cello choirmaster clarinet clavichord composer conductor continuo contralto cor cornet counter-tenor countertenor director double dulcian ed editor flute fortepiano gamba guitar harp harpsichord horn leader libretto lute lyricist mandolin mezzo mezzo-soprano narrator oboe orch orchestrator organ percussion piano piccolo reader realised recorder saxophone singer soprano speaker tenor text theorbo timpani trans transcribed translator treble trombone trumpet tuba viol viola violin vocals voice words anglais da basso d'amore".split()
)
#: Words for kinds of ensembles; those that may open a name by themselves; parts of one ensemble.
KINDS = frozenset("academy band baroque brass chamber choir choral chorus collegium consort ensemble national octet opera orchestra philharmonia philharmonic players quartet quintet radio sextet sinfonia singers soloists string strings symphony trio duo viols voices winds".split())
KINDS_SHORT = frozenset("ens ens. orch. orch phil phil. chamb. chamb symph. symph str. str qt. qt qrt. co so sq ch. rad. bar. ro rc be".split())
LEADING = ("trio", "duo", "quartet", "quintet", "ensemble")
PARTS = frozenset("voices viols winds brass chorus choir orchestra strings soloists singers players percussion timpani".split())
PARTICLES = frozenset("van von de der den di da del della du la le ten ter zu zur af av".split())
NOBODY = frozenset("traditional trad trad. anonymous anon anon. various unknown".split())

STRONG, COMMA, SLASH, AMP, AND = 1, 2, 3, 4, 5

_NOTE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_PREFIX = re.compile(r"^[a-z][a-z'/-]*+(?:(?: ?[&,;/] ?| and | )[a-z][a-z'/-]*+)*+ ?[:.] *(?=\S)")
_QUOTES = re.compile(r'^["“”„«»](.*?)["“”«»]$', re.S)
_ROLE_SPLIT = re.compile(r"[\s,;&/]+")


def scan_pieces(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(row, start, end, delimiter before) of the pieces between delimiters outside quotes and brackets, and the bytes."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - (offsets[0] if n else 0)
    size = len(data)
    row = np.repeat(np.arange(n), np.diff(offsets))
    pad = np.concatenate([data, np.zeros(8, np.uint8)])

    def depth(step: np.ndarray, parity: bool = False) -> np.ndarray:
        """Whether each byte lies inside; rows in which the signs don't balance have no inside."""
        total = np.concatenate([[0], np.cumsum(step)])
        inside = total[1:] - total[offsets[:-1]][row]
        ends = total[offsets[1:]] - total[offsets[:-1]]
        if parity:
            return (inside % 2 == 1) & (ends % 2 == 0)[row]
        sound = ends == 0
        np.logical_and.at(sound, row, inside >= 0)
        return (inside > 0) & sound[row]

    masked = depth((data == ord('"')).astype(np.int64), parity=True)
    curly = (pad[:size] == 0xE2) & (pad[1 : size + 1] == 0x80)  # three bytes of one sign, so of one row
    masked |= depth((curly & (pad[2 : size + 2] == 0x9C)).astype(np.int64) - (curly & (pad[2 : size + 2] == 0x9D)))
    for left, right in ("()", "[]"):
        masked |= depth((data == ord(left)).astype(np.int64) - (data == ord(right)))

    blank = np.isin(pad, np.frombuffer(b" \t\n", np.uint8)) | (pad == 0)
    rows_padded = np.concatenate([row, np.full(8, -1)])
    # The edges of a row count as blanks.
    ends_after = lambda k: blank[k : size + k] | (rows_padded[k : size + k] != row)
    after, before = ends_after(1), np.concatenate([[True], blank[: max(size - 1, 0)] | (row[1:] != row[:-1])])[:size]
    kind = np.zeros(size, np.int8)
    kind[np.isin(data, np.frombuffer(b"\n|;", np.uint8))] = STRONG
    kind[data == ord(",")] = COMMA
    kind[(data == ord("/")) & (after | before)] = SLASH
    kind[(data == ord("&")) & after & before] = AMP
    word = (pad[:size] == ord("a")) & (pad[1 : size + 1] == ord("n")) & (pad[2 : size + 2] == ord("d")) & before & ends_after(3) & (rows_padded[2 : size + 2] == row)
    kind[word] = AND
    kind[masked] = 0
    at = np.flatnonzero(kind)
    starts = np.concatenate([offsets[:-1], at + np.where(kind[at] == AND, 3, 1)])
    rows = np.concatenate([np.arange(n), row[at]])
    kinds = np.concatenate([np.zeros(n, np.int8), kind[at]])
    order = np.lexsort((starts, rows))
    starts, rows, kinds = starts[order], rows[order], kinds[order]
    ends = np.empty_like(starts)
    last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
    ends[last] = offsets[1:]
    inner = np.flatnonzero(~last)
    ends[inner] = starts[inner + 1] - np.where(kinds[inner + 1] == AND, 3, 1)
    return rows, starts, ends, kinds, data.tobytes()


def _near(word: str, known: frozenset[str] | tuple[str, ...]) -> bool:
    """Whether a word is known, or one letter dropped, doubled, changed or swapped away from a known one of five letters or more."""
    if word in known:
        return True
    if len(word) < 4:
        return False
    for k in known:
        if len(k) >= 4 and abs(len(k) - len(word)) <= 1 and (k[0] == word[0] or k[1] == word[1]):
            i = next((i for i, (a, b) in enumerate(zip(k, word, strict=False)) if a != b), min(len(k), len(word)))
            if k[i + 1 :] == word[i:] or k[i:] == word[i + 1 :] or k[i + 1 :] == word[i + 1 :] or (k[i + 2 :] == word[i + 2 :] and k[i : i + 2] == word[i : i + 2][::-1]):
                return True
    return False


@lru_cache(maxsize=1 << 16)
def _is_part(word: str) -> bool:
    return _near(word.strip(".,").lower(), PARTS)


@lru_cache(maxsize=1 << 16)
def is_kind(word: str) -> bool:
    """Whether a word names a kind of ensemble, spelled right, abbreviated or mistyped."""
    w = word.strip(".,").lower()
    return w in KINDS or word.lower() in KINDS_SHORT and (word[:1].isupper()) or _near(w, KINDS)


@lru_cache(maxsize=1 << 16)
def is_role(text: str) -> bool:
    """Whether a text holds nothing but roles: known role words, or no capital letter and no particle."""
    words = [w.strip(".:") for w in _ROLE_SPLIT.split(text.strip()) if w.strip(".:")]
    words = [w for w in words if w != "and"]
    if not words:
        return False
    if all(w.lower() in ROLES for w in words):
        return True
    return text[:1].isalpha() and text == text.lower() and not any(w in PARTICLES for w in words) and not any(c.isdigit() for c in text) and text.isascii()


class _Piece:
    __slots__ = ("raw", "name", "noted", "prefixed", "start", "end", "delim", "words")

    def __init__(self, raw: str, start: int, end: int, delim: int):
        self.raw, self.start, self.end, self.delim = raw, start, end, delim
        body = _NOTE.sub(" ", raw).strip()
        prefix = _PREFIX.match(body)
        self.prefixed = bool(prefix)
        self.noted = bool(_NOTE.search(raw)) or '"' in raw or "”" in raw
        self.name = body[prefix.end() :].strip() if prefix else body
        self.words = self.name.split()


def _surname_like(p: _Piece) -> bool:
    core = [w for w in p.words if w.lower() not in PARTICLES]
    return not p.noted and len(core) == 1 and core[0][:1].isalpha() and core[0].lower() not in NOBODY and not is_kind(core[0])


def _given_like(p: _Piece) -> bool:
    return bool(p.words) and not p.prefixed and '"' not in p.raw and "“" not in p.raw and all(w[:1].isupper() or w[:1].isdigit() is False and not w[:1].islower() for w in p.words) and not any(is_kind(w) for w in p.words) and p.words[0].lower() not in NOBODY


def _joins(item: list[_Piece], p: _Piece, following: _Piece | None) -> bool:
    """Whether a piece continues the name before it."""
    prev = item[-1]
    if prev.noted:
        return False
    if p.delim == COMMA:
        if len(p.words) == 1 and _is_part(p.words[0]) and following is not None and following.delim in (AMP, AND) and following.words and _is_part(following.words[0]):
            return True
        if len(item) == 1 and all(is_kind(w) for w in prev.words) and 1 <= len(p.words) <= 2 and not any(is_kind(w) for w in p.words) and not p.prefixed:
            return True
        return len(item) == 1 and _surname_like(prev) and _given_like(p) and not ("-" in prev.name and len(p.words) > 2)
    if p.delim in (AMP, AND):
        return len(prev.words) == 1 and _is_part(prev.words[0]) and bool(p.words) and _is_part(p.words[0])
    if p.delim == SLASH:
        return len(prev.words) == 2 and _near(prev.words[0].lower(), LEADING) and len(p.words) == 1 and not p.noted
    return False


def names_of(text: str, bounds: list[tuple[int, int, int]]) -> list[str]:
    """The names in one text, given (start, end, delimiter before) of its pieces in characters."""
    pieces, strongest = [], 0
    for start, end, delim in bounds:
        raw = text[start:end].strip()
        strongest = delim if not strongest or delim == STRONG else strongest
        if raw:
            pieces.append(_Piece(raw, start, end, strongest))
            strongest = 0
    items: list[list[_Piece]] = []
    for i, p in enumerate(pieces):
        following = pieces[i + 1] if i + 1 < len(pieces) else None
        if not p.words or is_role(p.raw):
            continue  # a role or a note of its own, before or after a name
        if items and p.delim != STRONG and items[-1][-1] is pieces[i - 1] and _joins(items[-1], p, following):
            items[-1].append(p)
        else:
            items.append([p])
    out = []
    for item in items:
        name = _NOTE.sub(" ", text[item[0].start : item[-1].end]).strip()
        prefix = _PREFIX.match(name)
        if prefix:
            name = name[prefix.end() :].strip()
        quoted = _QUOTES.match(name)
        name = (quoted.group(1) if quoted else name).strip().strip(",;").strip()
        if name:
            out.append(name)
    return out


def split_texts(texts: pa.StringArray, least: int = 1) -> pa.ListArray:
    """The names in each of the texts, as a list array; nulls, and texts of fewer than ``least`` names, give none."""
    filled = pc.fill_null(texts, "")
    rows, starts, ends, kinds, data = scan_pieces(filled)
    items: list[str] = []
    sizes = np.zeros(len(filled), np.int32)
    cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))[: len(rows)] if len(rows) else np.zeros(0, np.int64)
    limits = np.append(cuts[1:], len(rows)) if len(rows) else cuts
    # A text with fewer pieces than wanted can't have as many names.
    some = np.flatnonzero((limits - cuts >= least) & (ends[limits - 1] > starts[cuts])) if len(rows) else cuts
    starts, ends, kinds = starts.tolist(), ends.tolist(), kinds.tolist()
    for r, a, b in zip(some.tolist(), cuts[some].tolist(), limits[some].tolist(), strict=True):
        base = starts[a]
        whole = data[base : ends[b - 1]]
        text = whole.decode()
        if len(text) == len(whole):
            bounds = [(starts[i] - base, ends[i] - base, kinds[i]) for i in range(a, b)]
        else:  # byte places to character places
            bounds, at, chars = [], 0, 0
            for i in range(a, b):
                chars += len(whole[at : starts[i] - base].decode())
                size = len(whole[starts[i] - base : ends[i] - base].decode())
                bounds.append((chars, chars + size, kinds[i]))
                chars, at = chars + size, ends[i] - base
        names = names_of(text, bounds)
        if len(names) >= least:
            items += names
            sizes[r] = len(names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(items, pa.string()))


ITEM_SCHEMA = "field string, track_id bigint, item_no bigint, item_text string"


def unpacked(df: DataFrame, key: str, fields: tuple[str, ...], least: int = 2) -> DataFrame:
    """``field, track_id, item_no, item_text``: the names of each field's values that hold at least ``least`` items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for k, field in enumerate(fields, 1):
                coded = batch.column(k).dictionary_encode()
                children = split_texts(coded.dictionary.cast(pa.string()), least).take(coded.indices)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(children), 0))
                parents = pa.array(np.repeat(np.arange(len(children)), sizes))
                items = children.flatten()
                places = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                if len(items):
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(items)), keys.take(parents), pa.array(places, pa.int64()), items], ["field", "track_id", "item_no", "item_text"])

    return df.select(key, *fields).mapInArrow(run, ITEM_SCHEMA)


def found_items(tracks: DataFrame) -> DataFrame:
    """One row per name of every packed performers and composer_line value."""
    return unpacked(tracks, "id", ("performers", "composer_line"))
