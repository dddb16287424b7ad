"""Sizes of texts in tokens of a public byte-level tokenizer, counted in Arrow batches.

The tokenizer cuts a text before every blank that stands between two other signs, so the count of a text is the sum of
the counts of its blank-separated chunks, which repeat; each chunk is encoded once a worker. Texts with doubled blanks
are encoded whole. Defined results: null and empty texts have 0 tokens; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's own pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_KEEP = 500_000


class Counter:
    """Counts the tokens of texts, remembering chunks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if "  " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        known, total = self.known, len(self.encode(first))
        for chunk in rest:
            n = known.get(chunk)
            if n is None:
                n = len(self.encode(" " + chunk))
                if len(known) >= _KEEP:
                    known.clear()
                known[chunk] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker and vocabulary."""
    return Counter(path)


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counter(tokenizer)
        for batch in batches:
            tokens = pa.array([sizes.count(x.as_py()) for x in pc.fill_null(batch.column(2), "")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")
