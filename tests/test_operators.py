"""Reference operators on small fixtures: alignment, graphs, registry, parsers, keys, interface."""

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aubade.api import Archive, OptionError
from aubade.functions import text as X
from aubade.functions.titlekey import demojibake, work_title_key
from aubade.operators import graph as G
from aubade.operators import identity as N
from aubade.operators import instants as I
from aubade.operators import matching as M
from aubade.operators import parse as P
from aubade.operators import ranking as R
from aubade.operators import search as Q
from aubade.operators import temporal as T
from aubade.operators import warehouse as W
from aubade.plans.matching import match_aligned
from aubade.sources import landed
from aubade.sources.tables import load
from tests.conftest import rows


def side(items):
    return pd.DataFrame([{"rid": i, "position": i, "offset_s": o, "sur": s, "words": w} for i, (o, s, w) in enumerate(items)], columns=["rid", "position", "offset_s", "sur", "words"])


def test_alignment_is_the_cheapest():
    tracks = [(0, "lund", ["sonata"]), (300, "oster", ["trio", "op"]), (None, "weil", ["mass"])]
    segs = [(10, "lund", ["sonata"]), (150, "kahn", ["motet"]), (320, "oster", ["trio"]), (900, "weil", ["mass"])]
    got = M._align(("e",), side(tracks), side(segs))
    cost = lambda a, b: M.pair_cost(a[0], b[0], a[1] == b[1], len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])))
    best = min(
        sum(cost(tracks[i], segs[j]) for i, j in zip(left, right, strict=True)) + M.GAP * (len(tracks) + len(segs) - 2 * n)
        for n in range(4) for left in itertools.combinations(range(3), n) for right in itertools.combinations(range(4), n)
    )
    assert abs(got.cost.sum() + M.GAP * (7 - 2 * len(got)) - best) < 1e-9
    assert got.tier.tolist() == ["high"] * 3 and len(M._align(("e",), side([]), side(segs))) == 0


def test_alignment_of_long_nights(spark):
    air = spark.range(1700).selectExpr("'e' AS pid", "id", "id AS position", "concat('N Lund', chr(CAST(97 + id % 26 AS INT))) AS composer", "concat('w', id) AS title")
    segs = spark.range(850).selectExpr("'e' AS episode_pid", "id", "id AS position", "CAST(NULL AS BIGINT) AS version_offset", "concat('N Lund', chr(CAST(97 + (2 * id) % 26 AS INT))) AS composer_name", "concat('w', 2 * id) AS track_title")
    offsets = spark.createDataFrame([], "id bigint, offset_s bigint")
    got = M.aligned(air, offsets, segs).collect()
    assert {(r.track_id, r.segment_id) for r in got} == {(2 * k, k) for k in range(850)} and {r.tier for r in got} == {"high"}


def test_alignment_by_tiles_is_the_same(monkeypatch):
    some = random.Random(4)
    pick = lambda n: side([(some.choice([None, 90 * i]), some.choice([None, "lund", "oster", "weil"]), some.sample(["op", "trio", "mass"], some.randint(0, 3))) for i in range(n)])
    tracks, segs = pick(150), pick(70)
    whole = M._align(("e",), tracks, segs)
    monkeypatch.setattr(M, "TILE", 11)
    assert whole.equals(M._align(("e",), tracks, segs)) and len(whole) > 0


def test_offsets_of_all_clock_forms(spark):
    episodes = spark.createDataFrame([("a", "14/01/2008 00:30"), ("b", None)], "pid string, broadcast_date string")
    clocks = ["12:31 AM", "00:39 GMT", "00:45:30", "1:02 AM GMT", "?", "23:50 UTC", "12:10 AM"]
    tracks = spark.createDataFrame([(10 * k + i, e, i, c) for k, e in enumerate("ab") for i, c in enumerate(clocks)], "id bigint, episode_pid string, position bigint, time_str string")
    air = tracks.withColumnRenamed("episode_pid", "pid")
    got = dict(rows(T.instant_offsets(air, I.track_instants(tracks, episodes, undated=True))))
    want = [0, 480, 870, 1860, None, 83940, 85140]
    assert got == {10 * k + i: o for k in range(2) for i, o in enumerate(want) if o is not None}


def test_aligned_tracks_are_timed_by_all_clock_forms(spark, sf):
    read = I.parse_instant_texts(load(spark, sf, "tracks"), "time_str").where("ts_kind is not null").select("id", "episode_pid")
    kept = read.join(load(spark, sf, "episodes").select(F.col("pid").alias("episode_pid")), "episode_pid").count()
    seen = []
    whole = M.aligned
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "aligned", lambda air, offsets, segments: seen.append(offsets) or whole(air, offsets, segments))
        match_aligned(spark, sf)
    assert seen[0].where("offset_s is not null").count() == kept > 0


def test_reairings_by_words_number_and_performers(spark):
    works = [("Old grey castle overture alpha", "X Choir, A B (piano)"), ("Old grey castle overture beta", "X Choir"), ("Sea song BWV 12", "Y Trio"), ("Cantata of spring BWV 12", "Y Trio (ensemble)"), ("Old grey castle overture gamma", "Z Band"), ("Sea song BWV 13", "Y Trio"), ("Alpha beta gamma delta", None)]
    air = spark.createDataFrame([(i, f"p{i}", "c", " ".join(sorted(t.lower().split())), t, p, None) for i, (t, p) in enumerate(works)], "id bigint, pid string, ck string, wk string, title string, performers string, bdate date")
    key = lambda i: " ".join(sorted(works[i][0].lower().split()))
    got = {(r.a, r.b) for r in M.reairing_pairs(air).collect()}
    assert got == {tuple(sorted((key(0), key(1)))), tuple(sorted((key(2), key(3))))}
    assert M.reairing_pairs(air.withColumn("pid", F.lit("p"))).count() == 0


def test_reairings_equal_all_pairs(spark, sf):
    from aubade.plans.common import air

    rows_ = air(spark, sf).withColumn("ck", F.lit("c")).withColumn("performers", F.when(F.col("id") % 2 == 0, "X Choir, A B (piano)").otherwise("X Choir; C D (cello"))
    base = rows_.where("wk <> '' and title is not null").groupBy("wk").agg(F.count("*").alias("n"), F.min("title").alias("t"), F.min("performers").alias("p"), F.min("pid").alias("pid"), F.min("bdate").alias("d")).where("n = 1")
    ones = base.select("wk", "pid", "d", "t", X.catalogue_ref(F.col("t")).alias("cat"), X.canonical_key(F.col("t")).alias("k"), M.performer_names(F.col("p")).alias("names")).collect()
    want = set()
    for x, y in itertools.combinations(ones, 2):
        u, v, m, n = set(x.k.split()), set(y.k.split()), set(x.names or []), set(y.names or [])
        same = x.cat == y.cat if x.cat and y.cat else len(u | v) > 0 and len(u & v) / len(u | v) >= 0.55
        if same and m and n and m & n and len(m & n) / min(len(m), len(n)) >= 0.5 and x.pid != y.pid and (x.d is None or y.d is None or x.d != y.d):
            want.add((*sorted((x.wk, y.wk)), x.t, y.t) if x.wk < y.wk else (*sorted((x.wk, y.wk)), y.t, x.t))
    pairs = spark.createDataFrame(sorted(want), "a string, b string, ta string, tb string")
    kept = {(r.a, r.b) for r in pairs.where(~M.title_conflict(F.col("ta"), F.col("tb"))).collect()}
    assert {(r.a, r.b) for r in M.reairing_pairs(rows_).collect()} == kept and kept


def test_bridge_by_ids_lengths_and_roles(spark):
    credit = lambda *ps: json.dumps([{"name": n, "role": r, "musicbrainz_gid": g} for n, r, g in ps])
    recorded = [
        ("r1", "one", credit(("A B", "Conductor", "m1")), 600), ("r2", "two", credit(("A B", "Conductor", "m1")), 600), ("r3", "three", credit(("C D", "Conductor", "m2")), 600),
        ("r4", "four", credit(("Blue Quartet", "Ensemble", "m3")), 600), ("r5", "five", credit(("E F", "Conductor", None)), 600), ("r6", "six", credit(("Big Orchestra", "Orchestra", "m4")), 600),
        ("r7", "seven", credit(("Aa Bb", "Conductor", "m1")), 600),
    ]
    segs = spark.createDataFrame([(i, "e", r, "k", t, c, d) for i, (r, t, c, d) in enumerate(recorded)], "id bigint, episode_pid string, recording_pid string, ck string, track_title string, contributions_json string, duration_seconds bigint")
    texts = [("one", "A B (conductor)", 700), ("two", "A B (conductor)", 60), ("three", "A B (conductor), C E (piano)", 600), ("four", "Blue Quartet", 600), ("five", "E F (conductor)", 600), ("six", "Big Orchestra", 600), ("seven", "A B (conductor)", None)]
    air = spark.createDataFrame([(i, "k", t, p) for i, (t, p, _) in enumerate(texts)], "id bigint, ck string, wk string, performers string").withColumn("wk", X.work_key(F.col("wk")))
    lengths = spark.createDataFrame([(i, s) for i, (_, _, s) in enumerate(texts)], "id bigint, length_s bigint")
    got = {r.recording_pid: r.tier for r in M.bridged(air, segs, lengths).collect()}
    assert got == {"r1": "trusted", "r2": "candidate", "r4": "trusted", "r5": "candidate", "r6": "candidate", "r7": "trusted"}


def test_components_and_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.root for r in G.components(links).collect()} == {0, 100}
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", None)], "variant string, preferred string")
    got = dict(rows(G.resolved(aliases)))
    assert got == {"a": "d", "b": "d", "c": "d", "y": "x", "z": "x"}
    assert G.components(links.limit(0)).count() == 0


def test_components_keep_small_estimates(spark):
    name = lambda n: F.sha1((F.col("id") + n).cast("string"))
    got = G.components(spark.range(300).select(name(0).alias("a"), name(1).alias("b")))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**80
    assert len({r.root for r in got.collect()}) == 1 and got.count() == 301


def test_work_components_equal_walks_over_pairs(spark, sf):
    from aubade.plans.common import air

    rows_ = air(spark, sf)
    root, pairs = {}, [(f"{r.ck}|{r.a}", f"{r.ck}|{r.b}") for r in M.work_duplicates(rows_).collect()]
    for pair in pairs:
        for x in pair:
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert rows(M.work_components(rows_).select("id", "root")) == sorted(root.items()) and root


def test_walk_back_ends_in_loops(spark):
    episodes = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("a", "c"), ("e", None)], "pid string, previous_pid string")
    got = rows(landed.walk_back(episodes, episodes.where("pid in ('d', 'e')").select("pid")))
    assert got == [("d", "a", 3), ("d", "b", 2), ("d", "c", 1), ("d", "d", 0), ("e", "e", 0)]


def test_registry(spark):
    registry = spark.createDataFrame([("bach", "k1"), ("bach-2", "k2"), ("gone", "k3")], "slug string, key string")
    derived = spark.createDataFrame([("bach", "k1"), ("bach", "k4"), ("new", "k5"), ("bach", "k2")], "slug string, key string")
    after, report = W.sync_registry(registry, derived)
    assert rows(after.select("key", "slug")) == [("k1", "bach"), ("k2", "bach-2"), ("k3", "gone"), ("k4", "bach-3"), ("k5", "new")]
    assert rows(report) == [("kept", 2), ("minted", 2), ("orphan", 1)]


def test_slugs_are_unique_beside_natural_numbers(spark):
    names = ["trio", "Trio!", "trio 2", "TRIO", "trio 4", "trio 2!", "x 5", "symphony no 5"]
    got = [r.slug for r in W.with_slugs(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int"), "n", ["i"]).orderBy("i").collect()]
    assert got == ["trio", "trio-3", "trio-2", "trio-5", "trio-4", "trio-2-2", "x-5", "symphony-no-5"]
    registry = spark.createDataFrame([("symphony-no-5", "k1"), ("trio", "k2"), ("trio-3", "k3")], "slug string, key string")
    derived = spark.createDataFrame([("symphony-no-5", "k4"), ("trio", "k5"), ("trio", "k6"), ("symphony-no", "k7"), ("trio-2", "k8")], "slug string, key string")
    after = dict(rows(W.sync_registry(registry, derived)[0].select("key", "slug")))
    assert after == {"k1": "symphony-no-5", "k2": "trio", "k3": "trio-3", "k4": "symphony-no-5-2", "k5": "trio-4", "k6": "trio-5", "k7": "symphony-no", "k8": "trio-2"}


def test_registry_changes(spark):
    registry = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k3"), ("b", "k4")], "slug string, key string")
    redirects = spark.createDataFrame([("old", "a"), ("x", "nowhere"), ("c", "a")], "source string, target string")
    assert rows(W.registry_faults(registry, redirects)) == [("held twice", "b"), ("redirect lost", "x"), ("redirect shadowed", "c")]
    after, led = W.renamed(registry, redirects.where("source = 'old'"), spark.createDataFrame([("a", "n"), ("c", "b"), ("gone", "m")], "old string, new string"))
    assert rows(after) == [("k1", "n"), ("k2", "b"), ("k3", "c"), ("k4", "b")] and rows(led) == [("a", "n"), ("old", "n")]
    left, kept, gone = W.retired(registry, redirects, spark.createDataFrame([("a",)], "slug string"))
    assert rows(left) == [("k2", "b"), ("k3", "c"), ("k4", "b")] and rows(kept) == [("x", "nowhere")] and rows(gone) == [("a", "k1")]


def test_numbers_of_a_whole_report(spark):
    ranked = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS v").repartition(6)
    assert [(r.rank, r.v) for r in R.numbered(ranked, F.col("v").desc()).orderBy("rank").collect()] == [(i + 1, 999 - i) for i in range(1000)]


def test_performer_parts(spark):
    texts = ["WDR Symphony Orchestra, Cologne, Anna Lund (conductor)", "A Trio, Köln, Berlin. ", "B (piano), Paris", "", None, "C D (director), E (chorus-conductor )."]
    df = spark.createDataFrame([(i, "p", None, "c", "w", t) for i, t in enumerate(texts)], "id bigint, pid string, bdate date, ck string, wk string, performers string")
    assert rows(R.performer_names(df, "ensemble").select("id", "name")) == [(0, "WDR Symphony Orchestra, Cologne"), (1, "A Trio, Köln, Berlin"), (2, "Paris")]
    assert rows(R.performer_names(df, "conductor").select("id", "nk")) == [(0, "anna lund"), (5, "c d"), (5, "e")]


def test_identity_layer(spark):
    air = spark.createDataFrame([(1, "p", 0, "", "J. Bach", "J. Bach", "Sonata for violin and piano", "", None, None, "", ""), (2, "p", 1, "", "Bach, J", "x", "Suite, K. 5", "", None, None, "", ""), (3, "p", 2, "", "Weil", None, None, "", None, None, "", "")], "id bigint, pid string, position bigint, time_str string, composer string, composer_line string, title string, performers string, bdate date, yr int, ck string, wk string")
    segments = spark.createDataFrame([("r", "Johann Bach", "Violin Sonata **EXPIRED**"), ("s", "X", "Y"), ("r2", "Other", "Z")], "recording_pid string, composer_name string, track_title string")
    names = N.recording_names(segments, spark.createDataFrame([("r2", "r")], "variant string, preferred string"))
    assert rows(names) == [("r", "Johann Bach", "Violin Sonata"), ("s", "X", "Y")]
    met = N.projected(air, spark.createDataFrame([(1, "r")], "track_id bigint, recording_pid string"), names)
    alias = lambda *p: spark.createDataFrame(list(p), "variant string, preferred string")
    got = {r.id: (r.ck, r.wk) for r in N.identified(met, alias(("bach j", "johann bach")), alias(("§k5|5|", "anywhere"), ("sonata violin", "never")), spark.createDataFrame([("johann bach", "sonata violin", "scoped")], "ck string, variant string, preferred string")).collect()}
    assert got == {1: ("johann bach", "scoped"), 2: ("johann bach", "anywhere"), 3: ("weil", "")}
    parts = N.corpus(spark.createDataFrame([(1, "a"), (2, "b")], "track_id bigint, recording_pid string"), spark.createDataFrame([(1, "c"), (2, "d")], "track_id bigint, recording_pid string"), spark.createDataFrame([(1, "2010-01-01"), (2, "2015-01-01")], "track_id bigint, bdate string").withColumn("bdate", F.col("bdate").cast("date")))
    assert rows(parts) == [(1, "a", "bridge"), (2, "d", "projection")]
    assert rows(N.status(spark.createDataFrame([(1, "a")], "track_id bigint, recording_pid string"), air)) == [(3, 1, 0.333333)]


def test_publish_stops_on_dangling_references(spark, tmp_path):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",), (None,)], "r string")
    with pytest.raises(ValueError, match="dangling"):
        W.publish({"a": a, "b": b}, str(tmp_path / "p"), [("b", "r", "a", "k")])
    W.publish({"a": a, "b": b.where("r = 'x'")}, str(tmp_path / "p"), [("b", "r", "a", "k")])
    assert spark.read.parquet(str(tmp_path / "p" / "b")).count() == 1


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Sonata in A major, K. 331", "Sonata in A, KV 331", True), ("Sonata in A major, K. 331", "Sonata in A major, KV331", True), ("Symphony No. 5 & Finale", "Symphony no 5 and finale", True), ("Trio for two oboes", "Trio for 2 oboes", True),
        ("Adagio from Concerto BWV 1052", "Concerto BWV 1052", False), ("Quartet in C major", "Quartet in C minor", False), ("Suite No. 1 - Allegro", "Suite No. 1", False), ("Élégie", "Elegie", True),
    ],
)
def test_title_keys(a, b, same):
    assert (work_title_key(a) == work_title_key(b)) is same


def test_demojibake():
    assert demojibake("Ã‰lÃ©gie") == "Élégie" and demojibake("Élégie") == "Élégie"


def test_parsers():
    assert P.flip_surname_first("Beduveveld, Ulrich") == "Ulrich Beduveveld"
    assert [P.flip_surname_first(x) for x in ("Traditional, Edvard Grieg", "Moritz, Landgrave of Hessen", "Anonymous, arr. X Y")] == ["Traditional, Edvard Grieg", "Moritz, Landgrave of Hessen", "Anonymous, arr. X Y"]
    block = "12:31 AM\nA B (1700-1750)\nSonata\nX Choir\nC D (conductor)\n\n12:40 AM\nonly one\n"
    form, tracks = P.derive(block)
    assert form == "block" and [(t["time_str"], t["composer"], t["title"], t["performers"]) for t in tracks] == [("12:31 AM", "A B", "Sonata", "X Choir | C D (conductor)")]
    assert P.derive("A B (1700-1750): Sonata\nC D: Trio")[1][1]["composer"] == "C D"
    assert P.parse_duration("1h30m") == 5400 and P.parse_duration("6:00") == 360 and P.parse_duration("3000") == 3000
    with pytest.raises(ValueError):
        P.parse_duration("soon")
    assert P.derive("") == ("inline", [])


def test_text_functions(spark):
    df = spark.createDataFrame([("Łódź Æther ß",), (None,), ("",), ("é" * 10_000,)], "t string")
    assert [r[0] for r in df.select(X.plain_key(F.col("t"))).collect()][:3] == ["lodz aether ss", None, ""]
    one = spark.range(1)
    none = F.array().cast("array<string>")
    assert one.select(X.jaccard(none, none, 1.0), X.jaccard(none, none, 0.0)).first() == (1.0, 0.0)


def test_search_with_slips(spark):
    docs = spark.createDataFrame([("composer", "a", "Ulrich Beduveveld", "", "u beduveveld", 9), ("work", "b", "Beduveveld suite", "", "", 1), ("work", "c", "Other", "", "", 5)], "k string, key string, n string, s string, a string, w bigint")
    assert [r.key for r in Q.search(docs, "bedvveveld").collect()] == ["a", "b"]
    assert [(r.key, r.pinned) for r in Q.search(docs, "beduveveld ulrich").collect()][0] == ("a", True)
    assert Q.search(docs, " ?! ").count() == 0 and Q.search(docs, "zzzz", index=Q.inverted(docs)).count() == 0


def test_ledgers(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": "x"}\n{"a": \n')
    assert landed.ledger(spark, str(tmp_path / "none.json"), "a string", True).count() == 0
    assert landed.ledger(spark, str(tmp_path / "l.json"), "a string", True).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        landed.ledger(spark, str(tmp_path / "l.json"), "a string", False).collect()
    (tmp_path / "g.json").write_text('{"a": "x"}\n')
    assert rows(landed.ledger(spark, str(tmp_path / "g.json"), "a string", True)) == [("x",)]
    W.write_json_cache(spark.range(3), str(tmp_path / "c"))
    W.write_json_cache(spark.range(2), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_dates_in_queries():
    assert Q.date_query("3 march 2019") == "2019-03-03" and Q.date_query("31/02/2019") == "" and Q.date_query("2019") is None


def test_interface(spark, sf, tmp_path):
    archive = Archive(*(load(spark, sf, t) for t in ("episodes", "tracks", "segment_events")))
    top = archive.composer("beduveveld").by("composer", top=3)
    assert top.count() >= 1
    assert archive.airings(2).by("work").agg(F.min("airings")).first()[0] >= 2
    assert archive.length(100, 900).by("recording").count() > 0 and archive.by("contributor", 5).count() == 5
    for wrong in (lambda: archive.length(1, 2).by("work"), lambda: archive.title("x").by("recording"), lambda: archive.airings(1).by("year"), lambda: archive.by("colour"), lambda: archive.year(2010).between("2010-01-01").by("work")):
        with pytest.raises(OptionError):
            wrong()
    archive.csv("form", str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() > 0
    assert set(archive.profile("sonata")) == {"works", "years", "composers", "credits"} and archive.summary().count() == 1
