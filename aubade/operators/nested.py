"""Deeply nested JSON texts to flat related tables in one pass.

A depth-first visitor reads each text once and emits tagged rows: the table's tag, the parent's key, the child's
place and key, and the child itself as payload. The tagged rows can be written partitioned by tag; ``read_table``
applies the schema of one tag. Texts nested too deep for the platform's reader are read, and written, by loops.

Defined results: null, empty and incomplete texts give no rows, as do texts of other JSON than objects and arrays; a
bare object counts as a list of one; elements that aren't objects keep their place but give no row; an absent or null
name is ''; absent ids come out as null; repeated rows and objects stay repeated; texts of any length and nesting are
read whole; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_SCHEMA = "link string, parent_key string, child_no bigint, child_key string, payload string"
_ARROW = pa.schema([("link", pa.string()), ("parent_key", pa.string()), ("child_no", pa.int64()), ("child_key", pa.string()), ("payload", pa.string())])

#: The payload's fields of each tag.
PAYLOAD_SCHEMAS = {
    "event": "pid string, position bigint, version_offset bigint, segment struct<type:string,pid:string,track_title:string,title:string,duration:bigint,record_id:string,record_label:string,primary_contributor:struct<name:string,pid:string,musicbrainz_gid:string>>",
    "credit": "name string, role string, pid string, musicbrainz_gid string",
    "row_credit": "name string, role string, pid string, musicbrainz_gid string",
    "version": "pid string, duration bigint, types array<string>",
    "category": "id string, key string, broader struct<category:struct<id:string>>",
    "ancestor": "pid string, type string",
}

Emit = Callable[[str, str | None, int, str | None, dict], None]


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


_SIGN = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null")


def _read_by_loop(text: str) -> object:
    """The value of a JSON text of any nesting: containers that are open lie on a list instead of the call stack."""
    skip = lambda i: _SIGN.match(text, i).end()
    open_: list[tuple[dict | list, str | None]] = []  # each container, and the name its next value gets
    i = skip(0)
    while True:
        # A value begins.
        sign = text[i : i + 1]
        if sign and sign in "{[":
            value: object = {} if sign == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if sign == "{" else "]"):
                i += 1
            else:
                name = None
                if sign == "{":
                    name, i = _name(text, i, skip)
                open_.append((value, name))
                continue
        elif sign == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _SCALAR.match(text, i):
            value, i = json.loads(m.group()), m.end()
        else:
            raise ValueError(f"no value at {i}")
        # It ends, and with it the containers that close after it.
        while True:
            i = skip(i)
            if not open_:
                if i < len(text):
                    raise ValueError(f"more text at {i}")
                return value
            owner, name = open_.pop()
            if isinstance(owner, dict):
                owner[name] = value
            else:
                owner.append(value)
            sign = text[i : i + 1]
            if sign == ",":
                i, name = skip(i + 1), None
                if isinstance(owner, dict):
                    name, i = _name(text, i, skip)
                open_.append((owner, name))
                break
            if sign != ("}" if isinstance(owner, dict) else "]"):
                raise ValueError(f"no end at {i}")
            value, i = owner, i + 1


def _name(text: str, i: int, skip: Callable[[int], int]) -> tuple[str, int]:
    """A member's name, and where its value begins."""
    if text[i : i + 1] != '"':
        raise ValueError(f"no name at {i}")
    name, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no value of {name!r}")
    return name, skip(i + 1)


def _read(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _read_by_loop(text)


def _write(value: object, ascii_only: bool = True) -> str:
    """The JSON text of a value of any nesting."""
    try:
        return json.dumps(value, ensure_ascii=ascii_only)
    except RecursionError:
        out, left = [], [value]
        while left:
            node = left.pop()
            if isinstance(node, _Literal):
                out.append(node.text)
                continue
            if isinstance(node, (dict, list)) and node:
                parts: list = []
                for k, v in node.items() if isinstance(node, dict) else ((None, v) for v in node):
                    parts += [_Literal(", " if parts else "{" if isinstance(node, dict) else "["), *([_Literal(json.dumps(k, ensure_ascii=ascii_only) + ": ")] if isinstance(node, dict) else []), v]
                left += reversed([*parts, _Literal("}" if isinstance(node, dict) else "]")])
            else:
                out.append(json.dumps(node, ensure_ascii=ascii_only))
        return "".join(out)


class _Literal:
    """Text between values that are still to be written."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _write(value)


def _children(value: object) -> Iterator[tuple[int, dict]]:
    """The objects of an array with their 1-based places; a bare object is a list of one."""
    for no, child in enumerate(value if isinstance(value, list) else [value], 1):
        if isinstance(child, dict):
            yield no, child


def visit_segments(key: str | None, root: object, emit: Emit) -> None:
    """Events at any depth and the contributions of their segments."""
    stack = [(root, key)]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, list):
            stack.extend((x, owner) for x in reversed(node))
        elif isinstance(node, dict):
            later = []
            for name, value in node.items():
                if name == "segment_events":
                    for no, event in _children(value):
                        pid = _text(event.get("pid"))
                        emit("event", owner, no, pid, event)
                        segment = event.get("segment")
                        if isinstance(segment, dict):
                            for place, credit in _children(segment.get("contributions")):
                                emit("credit", pid, place, _text(credit.get("name")) or "", credit)
                        later.append((event, pid))
                elif isinstance(value, (dict, list)):
                    later.append((value, owner))
            stack.extend(reversed(later))


def visit_programme(key: str | None, root: object, emit: Emit) -> None:
    """Versions, categories and the chain of parents of a programme."""
    programme = root.get("programme") if isinstance(root, dict) else None
    if not isinstance(programme, dict):
        return
    for tag, name, own in (("version", "versions", "pid"), ("category", "categories", "id")):
        for no, child in _children(programme.get(name)):
            emit(tag, key, no, _text(child.get(own)), child)
    no, node = 0, programme
    while isinstance(node := node.get("parent"), dict) and isinstance(node := node.get("programme"), dict):
        no += 1
        emit("ancestor", key, no, _text(node.get("pid")), node)


def visit_credits(key: str | None, root: object, emit: Emit) -> None:
    """The contributors of one row."""
    for no, credit in _children(root):
        emit("row_credit", key, no, _text(credit.get("name")) or "", credit)


#: The payload fields that repeat a child table's rows, left out of the parent's payload.
_NESTED_FIELDS = {"segment_events", "contributions", "parent"}


def _payload(node: dict) -> str:
    return _write({k: ({a: b for a, b in v.items() if a not in _NESTED_FIELDS} if isinstance(v, dict) else v) for k, v in node.items() if k not in _NESTED_FIELDS}, False)


Visitor = Callable[[str | None, object, Emit], None]


def tagged_rows(df: DataFrame, key: str, visitors: dict[str, Visitor], payload: bool = True) -> DataFrame:
    """Visit the texts of each row once: ``link, parent_key, child_no, child_key`` and, if wanted, ``payload`` (JSON).

    ``visitors``: by column of texts. All columns of a table are visited in one scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])

            def emit(link: str, parent: str | None, no: int, child: str | None, node: dict) -> None:
                for column, value in zip(rows, (link, parent, no, child, _payload(node) if payload else None), strict=True):
                    column.append(value)

            for row, k in enumerate(batch.column(0).to_pylist()):
                for place, visitor in enumerate(visitors.values(), 1):
                    text = batch.column(place)[row].as_py()
                    if text is None:
                        continue
                    try:
                        root = _read(text)
                    except ValueError:
                        continue
                    visitor(k, root, emit)
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)
                    for column in rows:
                        column.clear()
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)

    some = F.lit(False)
    for column in visitors:
        some = some | F.col(column).isNotNull()
    return df.select(F.col(key).cast("string"), *visitors).where(some).mapInArrow(run, LINK_SCHEMA)


def archive_links(episodes: DataFrame, segment_events: DataFrame, payload: bool = True) -> DataFrame:
    """All tagged rows of the archive's three JSON columns; each table is scanned once."""
    nights = tagged_rows(episodes, "pid", {"segments_raw_json": visit_segments, "raw_json": visit_programme}, payload)
    return nights.unionByName(tagged_rows(segment_events, "id", {"contributions_json": visit_credits}, payload))


def found_links(episodes: DataFrame, segment_events: DataFrame) -> DataFrame:
    """``link, parent_key, child_no, child_key`` of every child object."""
    return archive_links(episodes, segment_events, payload=False).drop("payload")


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write the flat tables, one folder per tag."""
    tagged.write.mode("overwrite").partitionBy("link").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One flat table with its parent's key and the tag's schema applied."""
    rows = spark.read.parquet(path).where(F.col("link") == tag)
    return rows.select("parent_key", "child_no", "child_key", F.from_json("payload", PAYLOAD_SCHEMAS[tag]).alias("p")).select("parent_key", "child_no", "child_key", "p.*")
