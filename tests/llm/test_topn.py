"""Top items of groups against a plain sort."""

import random
from collections import defaultdict

from aubade.llm.topn import partition_bounds, top_n
from tests.conftest import rows

SCHEMA = "g string, item string, score bigint, grp string, bound string"


def brute(data, n):
    best = defaultdict(dict)
    for g, i, s, *_ in data:
        if None not in (g, i, s):
            best[g][i] = max(s, best[g].get(i, s))
    return sorted((g, p, i, s) for g, items in best.items() for p, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n], 1))


def test_random_ties_repeats_and_nulls(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["b", "c", "ł", None]), rng.choice([f"é{rng.randrange(60)}", f"i{rng.randrange(900)}", None]), rng.choice([rng.randrange(6), None]), "x", "y") for _ in range(4000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    for n in (1, 5, 400):
        assert sorted(rows(top_n(df, "g", "item", "score", n))) == brute(data, n)
        # Bounds for all groups, broadcast and salted.
        assert sorted(rows(top_n(df, "g", "item", "score", n, heavy=1))) == brute(data, n)
    assert sorted(rows(top_n(df, "g", "item", "score", 5, heavy=1, broadcast=0))) == brute(data, 5)


def test_bounds_are_reached_by_n_items(spark):
    """In small batches, so that groups go over their edges."""
    rng = random.Random(3)
    data = [(rng.choice("aaab"), f"i{rng.randrange(50)}", rng.random()) for _ in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.createDataFrame(data, "grp string, item string, score double").repartition(3)
        found = {r.grp: (r.b_score, r.b_item, r.n_rows) for r in partition_bounds(df, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, (score, item, n_rows) in found.items():
        best = {}
        for h, i, s in data:
            if h == g:
                best[i] = max(s, best.get(i, s))
        assert sum((-s, i) <= (-score, item) for i, s in best.items()) >= 5 and n_rows == sum(h == g for h, _, _ in data)
    assert set(found) == {"a", "b"}
    got = [(r.grp, r.place, r.item, r.score) for r in top_n(df, "grp", "item", "score", 3).collect()]
    assert sorted(got) == brute(data, 3)


def test_empty_and_one(spark):
    df = spark.createDataFrame([("a", "x", 3, "", "")], SCHEMA)
    assert top_n(df.limit(0), "g", "item", "score", 5).count() == 0
    assert rows(top_n(df, "g", "item", "score", 5)) == [("a", 1, "x", 3)]
