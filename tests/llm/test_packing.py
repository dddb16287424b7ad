"""Packing of items."""

import random
from collections import Counter, defaultdict

import tiktoken

from aubade.llm import packing as P
from aubade.llm.tokens import TOKENIZER, Counter as Tokens
from aubade.llm.tokens import token_sizes
from tests.conftest import rows

SIZES = "doc_id bigint, source string, tokens bigint, size string"


def test_plan_packs_all_within_capacity():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 512):
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(500))
        total, fill = Counter(), defaultdict(int)
        for size, first, end, each, bin0, length, content in P.plan(dict(counts), capacity):
            total[size] += end - first
            for r in range(end - first):
                fill[bin0 + r // each] += size
            assert content <= length <= capacity
        assert total == counts and max(fill.values()) <= capacity
        assert len(fill) <= -(-sum(s * n for s, n in counts.items()) // capacity) * 1.25 + 1
    assert P.plan({}, 10) == []


def test_items(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([rng.randrange(0, 40), 5, 5, 5, None]), "x") for i in range(500)] + [(900, "a", 1000, "x"), (900, "a", 1000, "x")]
    specs = spark.createDataFrame([("all", 32, False), ("apart", 32, True), ("none", None, True), ("zero", 0, False), ("all", 31, True), (None, 9, False), ("apart", 32, None)], "spec_name string, capacity_tokens bigint, keep_sources_apart boolean")
    got = P.packed_items(spark.createDataFrame(data, SIZES).repartition(5), specs).collect()
    for spec in ("all", "apart"):
        mine = [r for r in got if r.spec_name == spec]
        assert sum(r.tokens for r in mine) == sum(t or 0 for *_, t, _ in data)
        assert {r.doc_id for r in mine} == {d[0] for d in data}
        bins = defaultdict(list)
        for r in mine:
            bins[r.pack_group, r.container].append(r)
        assert all(sum(max(r.tokens, 1) for r in rs) == rs[0].container_fill <= rs[0].container_length <= 32 for rs in bins.values())
        parts = Counter((r.doc_id, r.part_no) for r in mine)
        assert all(parts[900, p] == 2 for p in range(1, 33)) and all(n == 1 for (d, p), n in parts.items() if d != 900 and p == 1)
    assert {r.spec_name for r in got} == {"all", "apart"}
    assert P.packed_items(spark.createDataFrame([], SIZES), specs).count() == 0


def test_token_counts_equal_the_tokenizer():
    sizes = Tokens(TOKENIZER)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "Zü", " ", " ", "\n", "don't", "1 2", " ", "\t", "é", "…", "  ", "<|endoftext|>"]) for _ in range(rng.randrange(12)))
        assert sizes.count(text) == len(sizes.encode(text)), text
    assert isinstance(tiktoken.__version__, str)


def test_token_sizes_of_rows(spark):
    df = spark.createDataFrame([(1, "s", "hello world", 3), (2, None, None, 3), (3, "s", "", 3), (4, "s", "word " * 200_000, 3)], "doc_id bigint, source string, text string, tokens bigint")
    got = {r.doc_id: r.tokens for r in token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 200_000
    assert rows(token_sizes(df.limit(0))) == []
