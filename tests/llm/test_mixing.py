"""Mixing of sources."""

import math

from aubade.llm import mixing as M

SIZES = "doc_id bigint, source string, tokens bigint, u string"
TARGETS = "mix_name string, source string, target_share double, max_repeats bigint, budget_ratio double"


def poisson(u, rate, limit):
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while k < limit and total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_cuts_invert_the_distribution():
    for rate in (0.0, 0.3, 2.5, 9.0):
        sure, cuts = M._cuts(rate, 6)
        for u in (0.0, 0.05, 0.2, 0.5, 0.8, 0.999):
            assert sure + sum(c <= u for c in cuts) == (poisson(u, rate, 6) if rate else 0)


def test_high_rates_reach_their_share(spark):
    """Far more copies a record than the distribution's first terms can hold."""
    data = [(i, "few", 1, "") for i in range(20)] + [(100 + i, "many", 5, "") for i in range(5000)]
    targets = [("m", "few", 1.0, 5000, 2.0), ("m", "many", 1.0, 50, 2.0), ("n", "few", 1.0, 1_000_000_000, 30_000.0)]
    uses, shares = M.mixed(spark.createDataFrame(data, SIZES), spark.createDataFrame(targets, TARGETS))
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert abs(got["m", "few"].reached_tokens - 25_020) <= 20 and abs(got["m", "many"].reached_tokens - 25_020) < 100
    assert abs(got["n", "few"].reached_tokens / (30_000 * 25_020) - 1) < 1e-4
    assert max(r.uses for r in uses.where("mix_name = 'm'").collect()) <= 5000


def test_shares_and_limits(spark):
    data = [(i, "big", 10 + i % 50, "") for i in range(6000)] + [(10_000 + i, "small", 20, "") for i in range(50)] + [(20_000, None, 5, ""), (20_001, "big", None, ""), (20_002, "big", 0, ""), (20_003, "unused", 999, "")]
    targets = [("m", "big", 3.0, 2, 0.5), ("m", "small", 1.0, 3, 0.5), ("m", "missing", 1.0, 3, 0.5), ("n", "big", 1.0, 1, 0.1), ("o", None, 1.0, 1, 0.1)]
    uses, shares = M.mixed(spark.createDataFrame(data, SIZES).repartition(3), spark.createDataFrame(targets, TARGETS))
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert set(got) == {("m", "big"), ("m", "small"), ("m", "missing"), ("n", "big")}
    assert abs(got["m", "big"].reached_tokens - got["m", "big"].wanted_tokens) < 200
    assert abs(got["n", "big"].reached_tokens - got["n", "big"].wanted_tokens) < 200
    assert got["m", "small"].reached_tokens == 50 * 20 * 3 and got["m", "missing"].reached_tokens == 0
    rows = uses.collect()
    assert max(r.uses for r in rows if (r.mix_name, r.source) == ("m", "big")) <= 2
    assert all(r.uses == 1 for r in rows if r.mix_name == "n") and len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    copies = M.shuffled_copies(uses).collect()
    assert len(copies) == sum(r.uses for r in rows)
    order = [r.doc_id for r in copies if r.mix_name == "m"]
    assert order != sorted(order)
    again = M.mixed(spark.createDataFrame(data, SIZES), spark.createDataFrame(targets, TARGETS))[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_empty(spark):
    none, some = spark.createDataFrame([], SIZES), spark.createDataFrame([("m", "a", 1.0, 2, 0.5)], TARGETS)
    uses, shares = M.mixed(none, some)
    assert uses.count() == 0 and [r.reached_tokens for r in shares.collect()] == [0]
    uses, shares = M.mixed(spark.createDataFrame([(1, "a", 5, "")], SIZES), some.limit(0))
    assert uses.count() == 0 and shares.count() == 0
