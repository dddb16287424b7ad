"""Records of several sources mixed to target shares of the total size.

Poisson replication: each record has a uniform number from a seeded hash, inverted through the Poisson distribution
whose mean is the source's repetition rate and cut at the repeat limit. The rate is solved for the tokens wanted from
the weighted distribution of the hashed numbers, in bins of 1/65,536: so a source reaches its share to within the tokens of
a bin. Copies are exploded and shuffled globally by a second hash.

Defined results: shares are relative to their sum in a mix; a mix's budget is its ratio times the tokens of all rows; a
source that can't reach its part within its repeat limit is used to the limit and its shortfall is reported, not given
to others; a named source without records reports 0; rows of sources no mix names, and rows without tokens, are not
used; repeated rows count as records; several rows of one mix and source add up their shares and take the larger limit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aubade.llm.tokens import TOKENIZER, token_sizes
from aubade.session import pinned

BINS = 1 << 16
RATE_SCHEMA = "mix_name string, source string, rate double, sure bigint, cuts array<double>"


def _cuts(rate: float, limit: int) -> tuple[int, np.ndarray]:
    """(sure, cuts): P(N < k) for k = 1 to the limit, without those that are 0 (``sure`` many, at the start) and 1 for any number.

    A record is used once for each sure one, and once for each cut its number reaches. Terms are taken in logs, so that
    rates of any size have theirs; only counts near the rate differ from 0 and 1.
    """
    if rate <= 0:
        return 0, np.zeros(0)
    spread = 12 * math.sqrt(rate) + 60
    low, high = max(0, int(rate - spread)), min(limit, int(rate + spread))
    if low >= limit:
        return limit, np.zeros(0)
    counts = np.arange(low, high)
    terms = np.exp(counts * math.log(rate) - rate - np.array([math.lgamma(k + 1) for k in counts.tolist()]))
    return low, np.minimum(np.cumsum(terms), 1.0)


def _solve(part: pd.DataFrame) -> pd.DataFrame:
    """The rate at which a source's expected copies hold the tokens wanted; at most BINS rows."""
    wanted, limit = float(part.wanted.iloc[0]), int(part.max_repeats.iloc[0])
    weight = np.zeros(BINS + 1, np.int64)
    np.add.at(weight, part.bin.to_numpy(), part.tokens.to_numpy())
    above = np.append(np.cumsum(weight[::-1])[::-1], 0)

    def reached(rate: float) -> float:
        sure, cuts = _cuts(rate, limit)
        return float(sure * above[0] + above[np.ceil(cuts * BINS).astype(np.int64)].sum())

    if wanted >= limit * above[0]:
        rate, sure, cuts = math.inf, limit, np.zeros(0)
    else:
        low, high = 0.0, 1.0
        while reached(high) < wanted:
            low, high = high, 2 * high
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if reached(middle) < wanted else (low, middle)
        rate = min((low, high), key=lambda r: abs(reached(r) - wanted))
        sure, cuts = _cuts(rate, limit)
        cuts = np.ceil(cuts * BINS) / BINS
    return pd.DataFrame([{"mix_name": part.mix_name.iloc[0], "source": part.source.iloc[0], "rate": rate, "sure": sure, "cuts": cuts[cuts < 1].tolist()}])


def _uniform(*columns: str, seed: int) -> Column:
    """A number from 0 on and below 1 by a seeded hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def targets_of(mix_targets: DataFrame, all_tokens: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, wanted, max_repeats, budget``: the tokens wanted of each source."""
    merged = mix_targets.where("target_share > 0 and source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("ratio"))
    total = merged.groupBy("mix_name").agg(F.sum("share").alias("shares"))
    joined = merged.join(total, "mix_name").crossJoin(all_tokens)  # all_tokens is one row
    share = F.col("share") / F.col("shares")
    budget = F.col("ratio") * F.col("all_tokens")
    return joined.select("mix_name", "source", share.alias("target_share"), (share * budget).alias("wanted"), F.greatest("max_repeats", F.lit(0)).alias("max_repeats"), budget.alias("budget"))


def mixed(sizes: DataFrame, mix_targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): ``mix_name, doc_id, source, tokens, uses`` and ``mix_name, source, target_share, reached_share, ...``.

    ``sizes``: ``doc_id, source, tokens``.
    """
    base = pinned(sizes)
    targets = targets_of(mix_targets, base.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")))
    wanted = F.broadcast(pinned(targets))  # one row a mix and source named in the settings
    rows = base.where("tokens > 0").join(wanted, "source").where("max_repeats > 0").withColumn("u", _uniform("doc_id", "mix_name", seed=seed))
    bins = rows.groupBy("mix_name", "source", "wanted", "max_repeats", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens"))
    rates = F.broadcast(bins.groupBy("mix_name", "source").applyInPandas(_solve, RATE_SCHEMA))
    uses = rows.join(rates, ["mix_name", "source"]).withColumn("uses", F.col("sure") + F.size(F.filter("cuts", lambda c: c <= F.col("u"))))
    uses = uses.where("uses > 0").select("mix_name", "doc_id", "source", "tokens", "uses")
    reached = uses.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"), F.sum("uses").alias("copies"))
    per_mix = reached.groupBy("mix_name").agg(F.sum("reached").alias("mix_tokens"))
    shares = targets.join(reached, ["mix_name", "source"], "left").join(per_mix, "mix_name", "left").select(
        "mix_name", "source", "target_share",
        F.coalesce(F.col("reached") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("reached") / F.col("budget"), F.lit(0.0)).alias("budget_share"),
        F.round("wanted").cast("bigint").alias("wanted_tokens"), F.coalesce("reached", F.lit(0)).alias("reached_tokens"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    return uses, shares


def shuffled_copies(uses: DataFrame, seed: int = 17) -> DataFrame:
    """One row a copy in global random order: range-partitioned and sorted by ``shuffle_key``."""
    copies = uses.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("uses"))))
    keyed = copies.withColumn("shuffle_key", F.xxhash64("mix_name", "doc_id", "copy_no", F.lit(seed + 1)))
    order = ["mix_name", "shuffle_key", "doc_id", "copy_no"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("mix_name", "shuffle_key", "doc_id", "copy_no", "source", "tokens")


def mix_documents(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Uses and shares of all mixes over the documents' token sizes."""
    return mixed(token_sizes(documents, tokenizer), mix_targets, seed)
