"""The N best items of every group, whatever the group's size.

First pass: each partition, sorted by group and score, reports of every group its N-th best distinct item as a lower bound
of the group's N-th best, since N items are known to reach it. The best bound of each group that has many rows meets the
rows, and those below it are dropped before any shuffle; second pass: the few survivors are reduced to distinct items
and ranked. Groups with few rows need no bound: all of them survive.

Order: score descending, then item ascending by code point. Defined results: rows with a null group, item or score are
left out; rows of one item in a group count as one with its largest score; groups with fewer than N items keep all;
empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aubade.session import pinned

#: Rows from which a group's bound is applied; most bounds that are broadcast, and the salts of the join beyond that. Of
#: no effect on results.
HEAVY, BROADCAST, SALTS = 1_000, 100_000, 32


def partition_bounds(rows: DataFrame, n: int) -> DataFrame:
    """``grp, b_score, b_item, n_rows``: the best of the partitions' N-th best (score, item) of each group.

    A worker holds one batch and the N best of one group: the sort within partitions is Spark's, and may spill.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the N best so far of the group that is open
        before = 0

        def bounds(of: pd.DataFrame) -> pd.DataFrame:
            return of.rename(columns={"score": "b_score", "item": "b_item"})[["grp", "b_score", "b_item", "n_rows"]]

        for batch in batches:
            if not len(batch):
                continue
            same = held is not None and held.grp.iloc[0] == batch.grp.iloc[0]
            if held is not None and not same and len(held) == n:
                yield bounds(held.tail(1).assign(n_rows=before))
            sizes = batch.groupby("grp", sort=False).size()
            if same:
                sizes.iloc[0] += before
                batch = pd.concat([held, batch], ignore_index=True)
            once = batch[~batch.duplicated(["grp", "item"])]
            place = once.groupby("grp", sort=False).cumcount()
            last = batch.grp.iloc[-1]
            found = once[(place == n - 1) & (once.grp != last)]
            if len(found):
                yield bounds(found.assign(n_rows=found.grp.map(sizes)))
            held, before = once[(once.grp == last) & (place < n)], int(sizes.iloc[-1])
        if held is not None and len(held) == n:
            yield bounds(held.tail(1).assign(n_rows=before))

    local = rows.sortWithinPartitions("grp", F.col("score").desc(), "item").mapInPandas(run, f"grp string, b_score {kinds['score']}, b_item string, n_rows bigint")
    # The highest score, and of equal scores the smallest item.
    high = local.groupBy("grp", "b_score").agg(F.min("b_item").alias("b_item"), F.sum("n_rows").alias("n_rows"))
    return high.groupBy("grp").agg(F.max_by(F.struct("b_score", "b_item"), "b_score").alias("b"), F.sum("n_rows").alias("n_rows")).select("grp", "b.*", "n_rows")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, heavy: int = HEAVY, broadcast: int = BROADCAST) -> DataFrame:
    """``grp, place, item, score``: places 1 to n of each group."""
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), F.col(score).alias("score")).where("grp is not null and item is not null and score is not null")
    bounds = pinned(partition_bounds(rows, n).where(F.col("n_rows") >= heavy).drop("n_rows"))
    some = bounds.limit(broadcast + 1).count()
    if some > broadcast:
        salt = F.pmod(F.xxhash64("item"), F.lit(SALTS))
        spread = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = rows.withColumn("salt", salt).join(spread, ["grp", "salt"], "left")
    else:
        joined = rows.join(F.broadcast(bounds), "grp", "left")
    above = F.col("b_score").isNull() | (F.col("score") > F.col("b_score")) | ((F.col("score") == F.col("b_score")) & (F.col("item") <= F.col("b_item")))
    survivors = joined.where(above).groupBy("grp", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item"))
    return survivors.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= n).select("grp", "place", "item", "score")


def found_top_works(works: DataFrame, n: int = 5) -> DataFrame:
    """``composer_slug, place, slug``: each composer's n works with the most airings."""
    return top_n(works, "composer_slug", "slug", "airings", n).select(F.col("grp").alias("composer_slug"), "place", F.col("item").alias("slug"))
