"""Pages of stuffed keywords, link lists and product tags.

Each text is dealt into blocks: its sentences, and its other lines, each cut into stretches of about equal length. A
block is reduced to its words (case folded, digits alike, signs as blanks, each line once) and compressed; its ratio over
the median ratio of blocks of its language, style and length tells how redundant it is. A redundant block is flagged if
it holds few sentence ends for its length, an extremely redundant one at once, since keywords can be stuffed into
sentences. A page is reported if flagged blocks hold more than three quarters of its text. No list of words and no
pattern of links or tags takes part.

Defined results: null and blank texts are not reported; repeated rows are reported each; null and unknown languages
share the norm of all languages; texts of any length are read whole; empty tables give no rows; only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aubade.session import pinned

#: Fixed value: languages that have a norm of their own.
LANGUAGES = ("en", "de", "fr", "pl")
_CLOSING = frozenset(".!?…")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
#: The end of a sentence: a word, its closing sign, and a capital letter, quote or the line's end after it.
_ENDS = re.compile(r"[^\W\d_]{2}[.!?…]+(?=[\"”’)»]*(?:\s+[\"“‘(«]*[^\W\d_a-z]|\s*$))", re.M)

#: Characters of a block; a line up to LINE characters is one part, a longer one is cut at sentences and blanks.
BLOCK_CHARS, LINE = 800, 120
#: A block whose repeated lines hold more than this share of it is compressed with them.
REPEATED = 0.75
#: Ratio over the norm below which a block is extremely redundant, and below which it is redundant; both higher by
#: SHORT_MORE for blocks of fewer than SHORT bytes, which compress less evenly.
EXTREME, REDUNDANT, SHORT, SHORT_MORE = 0.71, 0.86, 350, 0.06
#: Fewest sentence ends in a hundred characters of writing.
FEW_ENDS = 0.3
#: A language's norm counts from so many texts on, and is at least this share of the norm of all languages; that is at
#: least a share of the norm of both styles, the larger one where few texts have its style and length. So a corner full of
#: stuffing isn't its own norm.
LEAST_TEXTS, LEAST_NORM, LEAST_STYLE = 20, 0.95, 0.88
#: From one length bucket to the next, half an octave, the ratio of writing falls by less than a tenth: so the norm of
#: shorter blocks bounds that of lengths of which there are few texts.
FALL = 0.9
BLOCK_SCHEMA = "doc_id bigint, lang_key string, style string, bucket int, bytes bigint, chars bigint, ratio double, ends double"


class _Reduced(dict):
    """Code points to what counts of them: letters folded by the caller, digits alike, line ends kept, others blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c if c == "\n" or c.isalpha() else "0" if c.isdigit() else " "
        return out


_REDUCED = _Reduced()


def _parts(text: str) -> Iterator[str]:
    """Lines, long ones by sentences, very long ones at blanks."""
    half = BLOCK_CHARS // 2
    for line in text.split("\n"):
        for part in _SENTENCES.split(line) if len(line) > LINE else (line,):
            start = 0
            while len(part) - start > half:
                cut = part.rfind(" ", start + half // 2, start + half)
                cut = cut if cut > 0 else start + half
                yield part[start:cut]
                start = cut
            if part[start:].strip():
                yield part[start:]


def blocks_of(text: str) -> Iterator[tuple[str, str]]:
    """(style, block): parts that close like sentences ('S') and others ('K'), each style in blocks of about one length."""
    styles: dict[str, list[str]] = {"S": [], "K": []}
    for part in _parts(text):
        styles["S" if part.rstrip()[-1:] in _CLOSING else "K"].append(part)
    for style, parts in styles.items():
        total = sum(map(len, parts))
        each, block, size = total / max(1, round(total / BLOCK_CHARS)), [], 0
        for part in parts:
            block.append(part)
            size += len(part)
            if size >= each:
                yield style, "\n".join(block)
                block, size = [], 0
        if block:
            yield style, "\n".join(block)


def measure(block: str) -> tuple[int, int, float, float]:
    """(length bucket, bytes compressed, compression ratio, sentence ends in a hundred characters)."""
    lines = [" ".join(x.split()) for x in block.casefold().translate(_REDUCED).split("\n")]
    whole, once = "\n".join(lines).encode(), "\n".join(dict.fromkeys(lines)).encode()
    data = (whole if len(once) < (1 - REPEATED) * len(whole) else once) or b" "
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -12, 6)
    size = len(squeeze.compress(data)) + len(squeeze.flush())
    return min(40, int(2 * log2(len(data)))), len(data), size / len(data), 100 * len(_ENDS.findall(block)) / len(block)


def block_measures(documents: DataFrame) -> DataFrame:
    """One row of figures for each block of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                known = (lang or "").lower()[:2]
                for style, block in blocks_of(text.as_py()):
                    bucket, size, ratio, ends = measure(block)
                    rows.append((doc, known if known in LANGUAGES else "other", style, bucket, size, len(block), ratio, ends))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    return documents.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).mapInArrow(run, BLOCK_SCHEMA)


def _bounded(norms: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Norms by bucket, none lower than the fall allows from those of shorter blocks with enough texts. A table of at most 82 rows."""
    shorter = Window.partitionBy(*kinds).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    fallen = F.pow(F.lit(FALL), F.col("bucket"))
    sure = F.max(F.when(F.col("texts") >= LEAST_TEXTS, F.col(column) / fallen)).over(shorter)
    return norms.withColumn(column, F.greatest(column, sure * fallen))


def spam_shares(documents: DataFrame) -> DataFrame:
    """``doc_id, spam_share``: the share of each text held by flagged blocks."""
    blocks = pinned(block_measures(documents))
    # Each text counts once in a norm, however many blocks it has.
    means = blocks.groupBy("doc_id", "lang_key", "style", "bucket").agg(F.avg("ratio").alias("ratio"))
    median = F.percentile_approx("ratio", 0.5, 1000)
    own = means.where("lang_key <> 'other'").groupBy("lang_key", "style", "bucket").agg(median.alias("own"), F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS).drop("texts")
    pooled = _bounded(means.groupBy("style", "bucket").agg(median.alias("pooled"), F.count("*").alias("texts")), "pooled", ["style"])
    both = _bounded(means.groupBy("bucket").agg(median.alias("both"), F.count("*").alias("texts")), "both", []).drop("texts")
    # At most languages x styles x buckets = 4 x 2 x 41 rows, whatever the data.
    joined = blocks.join(F.broadcast(own), ["lang_key", "style", "bucket"], "left").join(F.broadcast(pooled), ["style", "bucket"]).join(F.broadcast(both), "bucket")
    general = F.greatest("pooled", F.when(F.col("texts") < LEAST_TEXTS, LEAST_NORM).otherwise(LEAST_STYLE) * F.col("both"))
    norm = F.when(F.col("own").isNull(), general).otherwise(F.greatest("own", LEAST_NORM * general))
    z = F.col("ratio") / norm - F.when(F.col("bytes") < SHORT, SHORT_MORE).otherwise(0.0)
    flagged = (z < EXTREME) | ((z < REDUNDANT) & (F.col("ends") < FEW_ENDS))
    spam = F.when(flagged, F.col("chars")).otherwise(0)
    return joined.groupBy("doc_id").agg((F.sum(spam) / F.sum("chars")).alias("spam_share"))


def found_spam(documents: DataFrame, share: float = 0.75) -> DataFrame:
    """``doc_id`` of each text more than ``share`` of which is stuffing."""
    return spam_shares(documents).where(F.col("spam_share") > share).select("doc_id")
