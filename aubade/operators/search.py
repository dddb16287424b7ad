"""Search catalogue and ranking: an inverted index as a table, fields boosted, kinds and airings as priors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aubade.functions.stations import station
from aubade.functions.text import plain_key
from aubade.operators import ranking as R
from aubade.operators import segments as S
from aubade.session import pinned

#: Field boosts and kind priors; the fewest hits for which all words must match.
BOOSTS = {"n": 3.0, "a": 2.0, "s": 1.5}
KINDS = {"composer": 3.0, "artist": 2.5, "ensemble": 2.5, "country": 2.0, "broadcaster": 2.0, "form": 2.0, "year": 2.0, "work": 1.0, "episode": 0.8}
AND_FLOOR = 5
#: Months by name, in order.
MONTHS = "january february march april may june july august september october november december".split()


def catalogue(air: DataFrame, segments: DataFrame) -> DataFrame:
    """``k, key, n, s, a, w``: documents of all kinds with name, subtitle, other spellings and airings."""
    air = pinned(air.select("id", "pid", "bdate", "yr", "ck", "wk", "composer", "title", "performers"))
    doc = lambda df, kind, key, name, sub, other, weight: df.select(F.lit(kind).alias("k"), key.cast("string").alias("key"), name.cast("string").alias("n"), sub.cast("string").alias("s"), other.cast("string").alias("a"), weight.cast("bigint").alias("w"))
    none, col = F.lit(""), F.col
    parts = [
        doc(R.rank_works(air), "work", F.concat_ws("|", "ck", "wk"), F.coalesce("display", "wk"), col("ck"), col("wk"), col("airings")),
        doc(R.rank_composers(air).join(spellings(air), "ck", "left"), "composer", col("ck"), F.coalesce("display", "ck"), none, F.coalesce("others", none), col("airings")),
        doc(R.rank_conductors(air), "artist", col("nk"), col("nk"), none, none, col("airings")),
        doc(R.rank_ensembles(air), "ensemble", col("nk"), F.coalesce("display", "nk"), none, none, col("airings")),
        doc(R.forms(air), "form", col("form"), col("form"), none, none, col("airings")),
        doc(R.years(air), "year", col("yr"), col("yr"), none, none, col("airings")),
        doc(S.broadcasters(segments, private=True), "broadcaster", col("brc"), station(col("brc")), none, col("brc"), col("airings")),
        doc(S.countries(segments, private=True), "country", col("country"), col("country"), none, none, col("airings")),
        doc(air.where("bdate is not null").groupBy("pid", "bdate").agg(F.count("*").alias("n_tracks")), "episode", col("pid"), col("bdate"), none, none, col("n_tracks")),
    ]
    return reduce(DataFrame.unionByName, parts)


def spellings(air: DataFrame, most: int = 20) -> DataFrame:
    """``ck, others``: a composer's spellings as one text, the commonest first, each folded form once."""
    folded = air.where("ck <> ''").groupBy("ck", plain_key(F.col("composer")).alias("form")).agg(F.count("*").alias("n"))
    kept = R.top_per_group(folded, ["ck"], most, F.col("n").desc(), F.col("form"))
    return kept.groupBy("ck").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "form"))), lambda x: x["form"])).alias("others"))


def inverted(docs: DataFrame) -> DataFrame:
    """``word, k, key, tf``: boosted counts of each document's words over its fields, in one pass."""
    fields = F.flatten(F.array(*(F.transform(F.split(F.coalesce(plain_key(F.col(f)), F.lit("")), " "), lambda w, b=b: F.struct(w.alias("word"), F.lit(b).alias("boost"))) for f, b in BOOSTS.items())))
    return docs.select("k", "key", F.explode(fields).alias("f")).where("f.word <> ''").groupBy(F.col("f.word").alias("word"), "k", "key").agg(F.sum("f.boost").alias("tf"))


def near(word: str) -> Column:
    """Whether an index word is the word, starts with it, or is a letter or two away from it: more for longer words (K3)."""
    slips = 0 if len(word) < 4 else 1 if len(word) < 8 else 2
    close = F.col("word").startswith(word)
    return close | (F.abs(F.length("word") - len(word)) <= slips) & (F.levenshtein("word", F.lit(word), slips) >= 0) if slips else close


def search(docs: DataFrame, query: str, top: int = 20, index: DataFrame | None = None) -> DataFrame:
    """``place, k, key, n, score, pinned`` of the best documents (K3); none for a query without words.

    Words match as prefixes or with slips of a letter or two, rarer words weigh more; all words must match, or any where
    too few documents have all. Names that hold each word of the query whole come first. ``index``: what ``inverted``
    made of the documents, to serve many queries.
    """
    words = sorted(set(re.sub("[^a-z0-9 ]", "", query.lower()).split()))
    if not words:
        return docs.sparkSession.createDataFrame([], "place bigint, k string, key string, n string, score double, pinned boolean")
    if index is None:
        docs = pinned(docs)
        index = inverted(docs)
    weight = lambda w: F.when(F.col("word") == w, 1.0).when(F.col("word").startswith(w), 0.5).otherwise(0.25)
    told = F.explode(F.filter(F.array(*(F.when(near(w), F.struct(F.lit(w).alias("q"), weight(w).alias("x"))) for w in words)), lambda h: h.isNotNull()))
    hits = pinned(index.where(reduce(Column.__or__, (near(w) for w in words))).select("k", "key", "tf", told.alias("h")).groupBy("k", "key", F.col("h.q").alias("q")).agg(F.sum(F.col("tf") * F.col("h.x")).alias("tf")))
    total = docs.agg(F.count("*").alias("all"))
    frequency = hits.groupBy("q").agg(F.count("*").alias("df"))  # a row a word of the query
    weighed = hits.join(F.broadcast(frequency), "q").crossJoin(total).withColumn("p", F.col("tf") * F.log(1 + F.col("all") / F.col("df")))
    scored = weighed.groupBy("k", "key").agg(F.sum("p").alias("base"), F.count("*").alias("matched"))
    enough = scored.agg((F.count_if(F.col("matched") == len(words)) >= AND_FLOOR).alias("strict"))
    kept = scored.crossJoin(enough).where(~F.col("strict") | (F.col("matched") == len(words)))
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("k")], F.lit(1.0)) * (1 + F.log10(1 + F.coalesce("w", F.lit(0))))
    named = kept.join(docs.select("k", "key", "n", "w"), ["k", "key"])
    whole = F.size(F.array_except(F.array(*map(F.lit, words)), F.split(plain_key(F.col("n")), " "))) == 0
    out = named.select("k", "key", "n", F.round(F.col("base") * prior, 6).alias("score"), whole.alias("pinned"))
    return R.numbered(out, F.col("pinned").desc(), F.col("score").desc(), F.col("k"), F.col("key"), top=top).withColumnRenamed("rank", "place")


def date_query(query: str) -> str | None:
    """The ISO date a query asks for, '' for a date-shaped text that is none, None for other texts (K4)."""
    from datetime import date

    q = query.strip().lower()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", q):
        parts = m.groups()
    elif m := re.fullmatch(r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})", q):
        parts = (m[3], m[2], m[1])
    elif m := re.fullmatch(r"(\d{1,2})\s+([a-z]+)\s+(\d{4})", q):
        parts = (m[3], MONTHS.index(m[2]) + 1 if m[2] in MONTHS else 0, m[1])
    else:
        return None
    try:
        return date(*map(int, parts)).isoformat()
    except ValueError:
        return ""
