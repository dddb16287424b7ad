"""Spellings of one name."""

import random

import pytest

from aubade.llm import variants as V
from tests.conftest import rows


def like(a, b):
    return V.likeness(V.parsed(a), V.parsed(b))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Rebecca Nebasireau", "R. Nebasireau"), ("Rebecca Nebasireau", "Nebasireau, Rebecca"), ("von Telözoberg, Ursula", "Urs. von Telozoberg"), ("William Lohuveoni", "Bill Lohuveoni"), ("Katharina von Pazopaberg", "Kahtarina von Pazopaberg"),
        ("Frederick Sokogolmann", "SOKOGOLMANN Frederick"), ("Wilhelmina von Bubovugrave", "Bubovugrave"), ("Momüduwitz Chamber Orchestra", "Momüduwitz CO"), ("Kirudowitz Baroque Ensemble", "Barockensemble Kirudowitz"), ("Radio Choir, Rusivatti", "The Rusivatti Radio Choir"), ("Sadekener Str. Qt.", "Sadekener String Quartet"), ("Benedikt-Ladovequist", "Benedikt Ladovequist"),
    ],
)
def test_same(a, b):
    assert like(a, b) >= V.AGREE and like(b, a) == like(a, b)


@pytest.mark.parametrize(
    ("a", "b"),
    [("Rebecca Nebasireau", "Michael Nebasireau"), ("Ulrich Beduveveld", "Zacharias Beduveveld"), ("Sevinowitz Chamber Orchestra", "Sevinowitz Symphony Orchestra"), ("Sevinowitz Radio Choir", "Gunilotti Radio Choir"), ("Katharina de Zokovusen", "Katharina Theodore Zokovusen"), ("Anna von Foxolund", "Anna de Foxolund"), ("Sevinowitz Philharmonic", "Ulrich Sevinowitz")],
)
def test_different(a, b):
    assert like(a, b) < V.AGREE


def names(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, name string")


@pytest.mark.parametrize("block", [5, 512])
def test_the_join_finds_each_pair_once(spark, block):
    """Against all pairs, with n-grams in one block and split over many."""
    rng = random.Random(2)
    first = [" ".join("".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(2)) for _ in range(60)]
    mistyped = [x[:i] + rng.choice("xyz") + x[i + 1 :] for x in first for i in rng.sample(range(len(x)), 2)]
    texts = sorted({*first, *mistyped, "", "?", "Bedu " * 3000})
    kept = names(spark, texts)
    unit = {}
    for i, v in V.vectors(kept).collect():
        norm = sum(x.w * x.w for x in v) ** 0.5
        unit[i] = {x.g: x.w / norm for x in v}
    ids = sorted(unit)
    cosine = lambda a, b: sum(w * unit[b].get(g, 0) for g, w in unit[a].items())
    want = {(a, b) for a in ids for b in ids if a < b and cosine(a, b) >= V.COSINE}
    found = V.similar_pairs(kept, block=block).collect()
    got = {(r.a, r.b) for r in found}
    assert not (want ^ got), [(texts[a], texts[b], cosine(a, b)) for a, b in want ^ got][:5]
    assert len(found) == len(want) > 20
    assert all(abs(r.cosine - cosine(r.a, r.b)) < 1e-9 for r in found)
    assert V.similar_pairs(kept.limit(0)).count() == 0


@pytest.mark.parametrize("steps", [2, 5, 1000])
def test_rounds_give_the_groups_of_the_direct_function(spark, steps):
    """Also where many scores, and so many means, are equal."""
    rng = random.Random(steps)
    links = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(160)) if a < b})
    df = spark.createDataFrame([(a, b, 0.45 + 0.5 * rng.randrange(steps) / steps) for a, b in links], "a bigint, b bigint, cosine double")
    group = lambda rs: sorted(tuple(sorted(x for x, g in rs if g == k)) for k in {g for _, g in rs})
    small, large = group([tuple(r) for r in V.groups_of(df).collect()]), group([tuple(r) for r in V.groups_of(df, large=1).collect()])
    assert small == large


def test_linkage_against_all_merges():
    """Against a plain search for the best mean at each step."""
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(2, 14)
        links = [(i, j, rng.choice([450_000, 600_000, 900_000])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        score = {(i, j): s for i, j, s in links}
        clusters = [[i] for i in range(n)]
        while True:
            best = min(((-sum(score.get((min(x, y), max(x, y)), 0) for x in p for y in q) / (len(p) * len(q)), p[0], q[0]) for a, p in enumerate(clusters) for q in clusters[a + 1 :]), default=(0,))
            if -best[0] < V.LINKAGE * V.UNIT:
                break
            p, q = (next(c for c in clusters if c[0] == x) for x in best[1:])
            clusters.remove(q)
            p.extend(q)
        want = {x: c[0] for c in clusters for x in c}
        assert V.average_linkage(n, links) == [want[i] for i in range(n)]


def test_pairs_of_a_small_archive(spark):
    tracks = spark.createDataFrame([(1, "Rebecca Nebasireau", 'R. Nebasireau (piano); "Nebasireau, Rebecca" (organ)', "x"), (2, "Traditional", None, "x"), (3, None, "", "x"), (4, "Michael Nebasireau", "Traditional", "x")], "id bigint, composer string, performers string, grp string")
    segments = spark.createDataFrame([("Rebecca Nebasireau",), (None,), ("Michael Nebasirеau",)], "composer_name string")
    want = [("Nebasireau, Rebecca", "R. Nebasireau"), ("Nebasireau, Rebecca", "Rebecca Nebasireau"), ("R. Nebasireau", "Rebecca Nebasireau")]
    assert rows(V.found_variants(tracks, segments)) == want
    assert V.found_variants(tracks.limit(0), segments.limit(0)).count() == 0
