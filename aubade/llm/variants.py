"""Spellings of one person or body among names typed by people, linked.

Each distinct name becomes a unit vector of weighted character trigrams, in any order of letters, of its informative words (particles, single
letters and words for kinds of ensembles left out, short forms of given names resolved by an optional table). A sparse
cosine similarity join finds every pair at or above a threshold: a vector is posted under the rarest trigrams of it, a
prefix long enough that no such pair can be missed; a trigram's postings are worked as matrix products in blocks of
bounded size, and only pairs that reach the threshold are emitted, once. An exact check of the words then takes out
pairs whose given names, particles or kinds contradict each other; it adds none. Groups are formed by average linkage
over the cosines: within connected components by a grouped function, in components too large for one task by rounds of
reciprocal nearest neighbours over the edge table. Both order pairs by mean, then by the smaller ids, on whole millionths,
and so give the same groups.

There is no cap on a name's partners: all pairs at or above the threshold are kept, not only the top n.

Defined results: null, blank and letterless names, and names of nobody ('Traditional', 'Anonymous'), are linked to
nothing; repeated rows count once; names are compared whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aubade.llm.looks import clean
from aubade.operators.graph import components
from aubade.operators.packed import KINDS, NOBODY, PARTICLES, unpacked
from aubade.session import pinned

#: Short forms of given names and the forms they stand for.
NICKNAMES = dict(
    pair.split("=")
    for pair in (
        "alec=alexander alex=alexander sasha=alexander sandy=alexander nastya=anastasia stacy=anastasia andy=andrew andrew=andrzej bart=bartholomew ben=benedikt bronek=bronislaw carrie=caroline caro=caroline lina=caroline "
        "lotte=charlotte charlie=charlotte connie=constance dan=daniel danny=daniel dima=dmitri mitya=dmitri dora=dorothea dolly=dorothea thea=dorothea ed=edward eddie=edward ned=edward ted=theodore teddy=theodore theo=theodore "
        "ella=elisabeth elsa=elisabeth lisa=elisabeth lise=elisabeth beth=elisabeth betty=elisabeth liz=elisabeth genie=eugenie ferdi=ferdinand nando=ferdinand fanfan=francois fred=frederick freddie=frederick fritz=frederick "
        "gabi=gabriele trude=gertrude gerti=gertrude beppe=giuseppe peppe=giuseppe pino=giuseppe harry=harold hal=harold heinz=heinrich heiner=heinrich henri=henrietta hettie=henrietta etta=henrietta nacho=ignacio ili=ilona ilka=ilona "
        "bella=isabella isa=isabella jadzia=jadwiga hans=johannes jan=johannes joe=joseph jo=joseph sepp=joseph jozsi=jozsef kathi=katharina kate=katharina katja=katharina käthe=katharina kazik=kazimierz kirsty=kristina kris=kristina "
        "larry=lawrence laurie=lawrence leo=leonard lenny=leonard len=leonard grete=margarete greta=margarete gretel=margarete mike=michael mick=michael micha=michael nat=nathaniel nate=nathaniel niko=nikolaus klaus=nikolaus nick=nikolaus "
        "liv=olivia livia=olivia otti=ottoline pat=patricia patsy=patricia trish=patricia pip=philippa pippa=philippa quin=quentin quint=quentin becky=rebecca becca=rebecca bob=robert rob=robert bobby=robert bert=robert seb=sebastian bastian=sebastian basti=sebastian "
        "stas=stanislaw staszek=stanislaw tom=thomas tommy=thomas uli=ulrich ulli=ulrich uschi=ursula ulla=ursula tina=valentina valya=valentina vera=veronica ronnie=veronica vroni=veronica mina=wilhelmina minna=wilhelmina willa=wilhelmina helma=wilhelmina "
        "bill=william will=william billy=william xavi=xaver zhenya=yevgenia zach=zacharias zack=zacharias zsofi=zsofia"
    ).split()
)
#: Short and foreign forms of words for ensembles, and what they stand for.
KIND_FORMS = {
    "co": "chamber orchestra", "so": "symphony orchestra", "sq": "string quartet", "rc": "radio choir", "be": "baroque ensemble", "po": "philharmonic", "rso": "radio symphony orchestra",
    "ens": "ensemble", "orch": "orchestra", "phil": "philharmonic", "philh": "philharmonic", "philharm": "philharmonic", "chamb": "chamber", "ch": "chamber", "symph": "symphony", "sym": "symphony", "sinf": "symphony", "str": "string", "qt": "quartet", "qrt": "quartet", "quart": "quartet", "bar": "baroque", "rad": "radio",
    "strings": "string", "philharmonia": "philharmonic", "choral": "chorus", "orchester": "orchestra", "orchestre": "orchestra", "chor": "choir", "choeur": "choir", "quatuor": "string quartet", "quartett": "quartet",
    "barockensemble": "baroque ensemble", "sinfonieorchester": "symphony orchestra", "symphonieorchester": "symphony orchestra", "rundfunkchor": "radio choir", "kammerorchester": "chamber orchestra", "streichquartett": "string quartet", "philharmonie": "philharmonic", "philharmoniker": "philharmonic", "filharmonia": "philharmonic", "baroque": "baroque",
}
_LINKING = frozenset("the of and & for from der die das des und von du le la les et".split())
_SPECIAL = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "ð": "d"})
_TOKEN = re.compile(r"[^\W\d_]+[.]?|&")

#: Least cosine of a pair; least mean cosine of a group, where a pair that isn't linked counts 0; least agreement of words.
COSINE, LINKAGE, AGREE = 0.4, 0.25, 0.5
GRAM = 3
#: Postings of a trigram worked at once; largest component grouped in one task. Of no effect on results.
BLOCK, LARGE = 512, 2000
#: Cosines are summed in whole millionths, so that means don't depend on the order of summing.
UNIT = 1_000_000


def fold(text: str) -> str:
    """Without accents, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_SPECIAL)) if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=1 << 17)
def typo(a: str, b: str) -> bool:
    """Whether two words differ by one letter dropped, added, changed or swapped."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


@lru_cache(maxsize=1 << 15)
def kind_of(token: str) -> tuple[str, ...]:
    """The kinds of ensemble a folded word stands for, spelled right, shortened, mistyped or foreign; none for other words."""
    word = token.strip(".")
    if word in KIND_FORMS:
        return tuple(KIND_FORMS[word].split())
    if word in KINDS:
        return (word,)
    if len(word) >= 5:
        for known in (*sorted(KINDS), *sorted(KIND_FORMS)):
            if len(known) >= 5 and typo(word, known):
                return tuple(KIND_FORMS.get(known, known).split())
    return ()


class Name:
    """A parsed name: its kinds if a body, its words in order, its particles, and which words are short."""

    __slots__ = ("kinds", "words", "particles", "core")

    def __init__(self, text: str):
        raw = _TOKEN.findall(text.replace("-", " ").replace("/", " "))
        tokens = [fold(t) for t in raw]
        kinds = [kind_of(t) if len(t.strip(".")) > 3 or t.endswith(".") or len(t) > 1 and r.isupper() else () for t, r in zip(tokens, raw, strict=True)]
        sure = any(k and len(t.strip(".")) > 3 for t, k in zip(tokens, kinds, strict=True)) or sum(bool(k) and t.endswith(".") for t, k in zip(tokens, kinds, strict=True)) > 1
        # Short forms alone name an ensemble only as two or three capitals at the end, such as a place's "CO".
        ended = len(raw) > 1 and bool(kinds[-1]) and raw[-1].isupper() and 2 <= len(raw[-1]) <= 3 and not raw[0].isupper()
        body = len(tokens) > 1 and (sure or ended)
        if body and tokens[-1].strip(".") == "ch":
            kinds[-1] = ("choir",)
        if body:
            self.kinds = frozenset(x for k in kinds for x in k)
            self.words = tuple(t.strip(".") for t, k in zip(tokens, kinds, strict=True) if not k and t not in _LINKING)
            self.particles = frozenset()
        else:
            self.kinds = frozenset()
            self.words = tuple(t for t in tokens if t.strip(".") not in PARTICLES and t != "&")
            self.particles = frozenset(t for t in tokens if t in PARTICLES)
        self.core = tuple(NICKNAMES.get(w.strip("."), w.strip(".")) for w in self.words if len(w.strip(".")) > 1)


@lru_cache(maxsize=1 << 15)
def parsed(text: str) -> Name:
    """The parsed form of a name."""
    return Name(text)


@lru_cache(maxsize=1 << 17)
def word_likeness(a: str, b: str) -> float:
    """0 to 1: the same word, a mistyped one, a short form or an initial of the other."""
    x, y = a.strip("."), b.strip(".")
    if x == y:
        return 1.0
    if NICKNAMES.get(x, x) == NICKNAMES.get(y, y):
        return 0.9
    if typo(x, y):
        return 0.9
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if long.startswith(short):
        if len(short) == 1:
            return 0.8
        if len(short) >= 2 and (a.endswith(".") or b.endswith(".")) and len(long) - len(short) >= 2:
            return 0.88
    for nick, other in ((NICKNAMES.get(x), y), (NICKNAMES.get(y), x)):
        if nick and (typo(nick, other) or (nick.startswith(other) and len(other) < 4)):
            return 0.8
    return 0.0


def likeness(a: Name, b: Name) -> float:
    """0 to 1: how well two names can be spellings of one; 0 where they contradict each other."""
    if bool(a.kinds) != bool(b.kinds):
        return 0.0
    if a.kinds:
        if a.kinds != b.kinds:
            return 0.0
    if not a.words or not b.words:
        return 0.0
    few, many = (a.words, b.words) if len(a.words) <= len(b.words) else (b.words, a.words)
    if a.kinds and len(few) != len(many):
        return 0.0
    options = sorted(((word_likeness(x, y), -abs(i - j), i, j) for i, x in enumerate(few) for j, y in enumerate(many)), reverse=True)
    used_i: set[int] = set()
    used_j: set[int] = set()
    total, strong = 0.0, 0
    for value, _, i, j in options:
        if value and i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            total += 1 - value
            strong = max(strong, min(len(few[i]), len(many[j])) if value >= 0.9 else 0)
    if len(used_i) < len(few) or strong < (3 if a.kinds else 4):
        return 0.0
    score = 1.0 - total - 0.12 * (len(many) - len(few))
    if len(few) == 1 and len(many) > 1:
        # A surname alone: it must be the last word, or the first of a name written surname first.
        j = next(iter(used_j))
        if j not in (0, len(many) - 1):
            return 0.0
        score -= 0.08
    if a.particles != b.particles:
        if a.particles and b.particles:
            return 0.0
        score -= 0.12 if len(few) in (1, len(many)) else 0.4
    return max(score, 0.0)


def grams(text: str) -> list[str]:
    """The character n-grams of a name's informative words, word ends marked; the letters of each in order, so that swapped ones keep theirs."""
    words = parsed(text).core
    return sorted({"".join(sorted(g)) for w in words for m in (f"^{w}$",) for g in ([m[i : i + GRAM] for i in range(len(m) - GRAM + 1)] or [m])})


def ordered_ids(df: DataFrame, *order: str) -> DataFrame:
    """The rows with unique whole numbers ``id`` in an order."""
    return pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))


def vectors(names: DataFrame) -> DataFrame:
    """``id, v``: each name's n-grams, the rarest first, as (number in order of rarity, names that have it, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), [grams(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(ids, lists, strict=True) for _ in g], pa.int64()), pa.array([y for g in lists for y in g], pa.string())], ["id", "gram"])

    terms = pinned(names.select("id", "name").mapInArrow(run, "id bigint, gram string"))
    known = ordered_ids(terms.groupBy("gram").agg(F.count("*").alias("df")), "df", "gram").withColumnRenamed("id", "g")
    count = names.agg(F.count("*").alias("n_names"))  # one row
    weighted = terms.join(known, "gram").crossJoin(count).select("id", F.struct("g", "df", F.log(1 + F.col("n_names") / F.col("df")).alias("w")).alias("t"))
    # A name has a few dozen n-grams, so the sorting happens inside its own array.
    return weighted.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("v"))


_POSTING = "gram bigint, lo bigint, hi bigint, id bigint, side bigint, gs array<bigint>, ws array<double>"


def postings(listed: DataFrame, cosine: float, block: int) -> DataFrame:
    """Each unit vector under the n-grams of its prefix in order of rarity, up to where the remaining norm falls below the threshold.

    Two unit vectors that share no n-gram of both prefixes have a cosine below it. Postings of an n-gram with more names
    than a block are dealt over blocks, and each goes to every pair of blocks that holds its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            offsets = np.asarray(lists.offsets)
            offsets = offsets - offsets[0]
            flat = lists.flatten()
            g, df, w = (np.asarray(flat.field(i)) for i in range(3))
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            total = np.concatenate([[0.0], np.cumsum(w * w)])
            norm = np.sqrt(total[offsets[1:]] - total[offsets[:-1]])
            tail = np.sqrt(np.maximum(total[offsets[1:]][row] - total[:-1], 0)) / norm[row]
            # A little below the threshold, for rounding: only more postings.
            at = np.flatnonzero(tail >= cosine - 1e-6)
            blocks = -(-df[at] // block)
            which = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            owner = row[at][which]
            own = (ids[owner] * 0x9E3779B1 >> 16) % blocks[which]
            parts = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (g, w / norm[row])]
            for i in range(0, len(which), 8192):
                s = slice(i, i + 8192)
                taken = pa.array(owner[s])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (g[at][which][s], np.minimum(own, other)[s], np.maximum(own, other)[s], ids[owner][s], own[s])), *(x.take(taken) for x in parts)], ["gram", "lo", "hi", "id", "side", "gs", "ws"])

    return listed.mapInArrow(run, _POSTING)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of a sorted stream, all rows of one key together; ``keys``: how many leading columns are the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *edge.tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _similar(run: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of the pairs of one block of postings that share no rarer n-gram and reach the threshold."""
    ids, side = np.asarray(run.column("id")), np.asarray(run.column("side"))
    lists = run.column("gs").combine_chunks()
    row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
    g, w = np.asarray(lists.flatten()), np.asarray(run.column("ws").combine_chunks().flatten())
    seen, column = np.unique(g, return_inverse=True)
    vector, earlier = np.zeros((len(ids), len(seen))), np.zeros((len(ids), len(seen)), np.float32)
    vector[row, column] = w
    earlier[row, column] = g < run.column("gram")[0].as_py()
    cosines = vector @ vector.T
    hit = (cosines >= cosine) & (earlier @ earlier.T == 0) & (ids[:, None] < ids)
    if run.column("lo")[0] != run.column("hi")[0]:
        hit &= side[:, None] != side
    i, j = np.nonzero(hit)
    return ids[i], ids[j], cosines[i, j]


def similar_pairs(names: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``a, b, cosine``: every pair of names (ids, a < b) whose vectors' cosine reaches the threshold, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for table in _runs(batches, 3):
            out.append(_similar(table, cosine))
            if len(out) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "cosine"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "cosine"])

    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = postings(vectors(names), cosine, block).repartition(parts, "gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi", "id")
    return laid.mapInArrow(run, "a bigint, b bigint, cosine double")


def agreeing(pairs: DataFrame, names: DataFrame, agree: float = AGREE) -> DataFrame:
    """The pairs whose words don't contradict each other. ``names``: ``id, name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([likeness(parsed(x), parsed(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], float)
            keep = pa.array(np.flatnonzero(scores >= agree))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(3)], ["a", "b", "cosine"])

    named = pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")
    return named.select("a", "b", "cosine", "name_a", "name_b").mapInArrow(run, "a bigint, b bigint, cosine double")


def average_linkage(n: int, links: list[tuple[int, int, int]], least: float = LINKAGE) -> list[int]:
    """The group of each of n items, as its smallest: clusters are merged, best mean first, then smallest ids, while the mean over all pairs reaches ``least``.

    ``links``: pairs with their cosine in whole millionths.
    """
    total: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, s in links:
        total[i][j] = total[j][i] = s
    size, group = [1] * n, list(range(n))
    heap = [(-float(s), min(i, j), max(i, j), 1, 1) for i, j, s in links]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= least * UNIT:
        _, i, j, a, b = heapq.heappop(heap)
        if (size[i], size[j]) != (a, b) or j not in total[i]:
            continue  # of clusters that have since been merged
        for k, s in total[j].items():
            del total[k][j]
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0) + s
        total[j] = {}
        size[i], size[j] = size[i] + size[j], 0
        group[j] = i
        for k, s in total[i].items():
            x, y = min(i, k), max(i, k)
            heapq.heappush(heap, (-s / (size[i] * size[k]), x, y, size[x], size[y]))
    for i in range(n):  # a group's smallest item comes first
        group[i] = group[group[i]]
    return group


def linkage_rounds(links: DataFrame, least: float = LINKAGE) -> DataFrame:
    """``id, grp`` by average linkage over the edge table ``a, b, s``: each round merges reciprocal nearest neighbours.

    Means never rise over the better of two merged clusters, nor do ties leave the smaller ids, so that these merges are
    those of the direct function.
    """
    names = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    groups = pinned(names.select("id", F.col("id").alias("grp")))
    while True:
        sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
        ends = links.join(groups.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(groups.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b").where("ga <> gb")
        sums = ends.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.sum("s").alias("s"))
        means = sums.join(sizes.select(F.col("grp").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("grp").alias("y"), F.col("n").alias("ny")), "y")
        means = means.withColumn("mean", F.col("s") / (F.col("nx") * F.col("ny"))).where(F.col("mean") >= least * UNIT).select("x", "y", "mean")
        rank = F.struct((-F.col("mean")).alias("m"), F.col("x").alias("lo"), F.col("y").alias("hi"))
        sides = means.select(F.col("x").alias("c"), rank.alias("r")).union(means.select(F.col("y").alias("c"), rank.alias("r")))
        best = sides.groupBy("c").agg(F.min("r").alias("r")).select("c", F.col("r.lo").alias("into"), F.col("r.hi").alias("grp"))
        merges = pinned(best.groupBy("into", "grp").agg(F.count("*").alias("n")).where("n = 2").select("into", "grp"))
        if merges.isEmpty():
            return groups
        groups = pinned(groups.join(merges, "grp", "left").select("id", F.coalesce("into", "grp").alias("grp")))


def groups_of(links: DataFrame, large: int = LARGE) -> DataFrame:
    """``id, grp``: the groups of all linked ids. ``links``: ``a, b, cosine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            a, b, s = (np.asarray(table.column(c)) for c in ("a", "b", "s"))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            groups = average_linkage(len(ids), list(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), s.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[groups])], ["id", "grp"])

    whole = pinned(links.select("a", "b", F.round(F.col("cosine") * UNIT).cast("bigint").alias("s")))
    roots = pinned(components(whole))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    placed = pinned(whole.join(roots.withColumnRenamed("id", "a"), "a").join(sizes, "root"))
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = placed.where(F.col("n") <= large).select("root", "a", "b", "s").repartition(parts, "root").sortWithinPartitions("root", "a", "b")
    groups = small.mapInArrow(run, "id bigint, grp bigint")
    big = placed.where(F.col("n") > large).select("a", "b", "s")
    return groups if big.isEmpty() else groups.unionByName(linkage_rounds(big))


def distinct_names(tracks: DataFrame, segment_events: DataFrame) -> DataFrame:
    """``name``: the distinct composers, clean segment composers and performers' items."""
    parts = [tracks.select(F.col("composer").alias("name")), segment_events.select("composer_name").distinct().select(clean(F.col("composer_name")).alias("name")), unpacked(tracks, "id", ("performers",), least=1).select(F.col("item_text").alias("name"))]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name is not null").distinct()
    return names.where(F.col("name").rlike(r"\p{L}") & ~F.lower(F.trim("name")).isin(*sorted(NOBODY)))


def linked_names(names: DataFrame) -> DataFrame:
    """``name, grp``: distinct names that share a person or body with another."""
    kept = ordered_ids(names.select("name"), "name")
    links = pinned(agreeing(similar_pairs(kept), kept))
    return groups_of(links).join(kept, "id").select("name", "grp")


def found_variants(tracks: DataFrame, segment_events: DataFrame) -> DataFrame:
    """``name_a, name_b``: the pairs of spellings of each group."""
    groups = pinned(linked_names(distinct_names(tracks, segment_events)))
    a, b = groups.select(F.col("name").alias("name_a"), "grp"), groups.select(F.col("name").alias("name_b"), "grp")
    return a.join(b, "grp").where("name_a < name_b").select("name_a", "name_b")
