"""Nearest records in time against brute force."""

import random

import numpy as np

from aubade.llm.nearest import LearnedIndex, nearest_in_time
from tests.conftest import rows

PROBES, TARGETS = "entity string, t bigint, probe_id bigint, shard string", "entity string, t bigint, target_id bigint, targets string"


def brute(probes, targets, tolerance):
    out = []
    for e, t, p, _ in probes:
        near = [(abs(t - u), i) for f, u, i, _ in targets if None not in (e, t, f, u) and e == f and abs(t - u) <= tolerance]
        if near:
            out.append((p, min(near)[1]))
    return sorted(out)


def test_random_and_shard_edges(spark):
    rng = random.Random(5)
    probes = [(rng.choice("abc"), rng.choice([rng.randrange(-9000, 9000), 3600 * rng.randrange(-2, 3) + rng.randrange(-91, 92)]), i, "s") for i in range(600)]
    targets = [(rng.choice("abc"), rng.choice([rng.randrange(-9000, 9000), 3600 * rng.randrange(-2, 3) + rng.randrange(-3, 4)]), i, "t") for i in range(400)]
    probes += [(None, 1, 900, "s"), ("a", None, 901, "s"), ("a", 10**18, 902, "s"), probes[0]]
    targets += [(None, 1, 900, "t"), ("a", None, 901, "t"), ("a", 10**17, 902, "t")]
    got = rows(nearest_in_time(spark.createDataFrame(probes, PROBES), spark.createDataFrame(targets, TARGETS), 90))
    assert sorted(got) == brute(probes, targets, 90)


def test_ties_go_to_the_smaller_id(spark):
    probes = [("a", 100, 1, ""), ("a", 100, 2, "")]
    targets = [("a", 90, 9, ""), ("a", 110, 4, ""), ("a", 110, 7, "")]
    assert rows(nearest_in_time(spark.createDataFrame(probes, PROBES), spark.createDataFrame(targets, TARGETS), 90)) == [(1, 4), (2, 4)]


def test_times_of_any_size(spark):
    ends = [1 << 53, 1 << 60, (1 << 60) + 1, 1 << 61, -(1 << 61), (1 << 63) - 1, -(1 << 63), -3600, -3601, 3599]
    targets = [("a", t, i, "") for i, t in enumerate(ends)] + [("a", t - 40, 100 + i, "") for i, t in enumerate(ends) if t > 0]
    probes = [("a", min(max(t + d, -(1 << 63)), (1 << 63) - 1), 10 * i + k, "") for i, t in enumerate(ends) for k, d in enumerate((0, -30, 60, 91))]
    got = rows(nearest_in_time(spark.createDataFrame(probes, PROBES), spark.createDataFrame(targets, TARGETS), 90))
    assert sorted(got) == brute(probes, targets, 90)


def test_empty(spark):
    none, some = spark.createDataFrame([], PROBES), spark.createDataFrame([("a", 1, 1, "")], TARGETS)
    assert nearest_in_time(none, some, 90).count() == 0
    assert nearest_in_time(spark.createDataFrame([("a", 1, 1, "")], PROBES), some.limit(0), 90).count() == 0


def test_index_places_as_a_sorted_search():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(rng.integers(-10_000, 60_000, n) ** 1)
        x = rng.integers(-20_000, 80_000, 4000)
        assert (LearnedIndex(keys).place(x) == np.searchsorted(keys, x)).all()


def test_predictions_stay_within_the_error():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 10_000, 3000), rng.integers(10**9, 10**9 + 300, 200), 5 * 10**9 + np.arange(5000) ** 2]))
    for error in (0, 1, 8, 100):
        index = LearnedIndex(keys, error)
        piece = np.searchsorted(index.base, keys, "right") - 1
        off = np.abs(index.first[piece] + index.slope[piece] * (keys - index.base[piece]) - np.arange(len(keys)))
        assert off.max() <= error + 1e-6 and len(index.base) < len(keys) / max(1, error)
