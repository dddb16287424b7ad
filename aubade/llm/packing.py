"""Items of varying length into containers of fixed capacity, as few and as full as possible.

The plan is made on histograms of sizes, which a capacity bounds whatever the number of items: variable-capacity
best-fit opens for the largest item left the permitted length of least cost a token, fills it with the largest items
that fit, uses the pattern as often as the histogram allows, and at last downsizes each container to the smallest
permitted length that holds its contents. Items get their places from the plan by their rank among items of one size;
ranks are offsets of partitions plus places within them, and each partition's items meet only the stretches of the plan
that hold them, so a hot size is never gathered in one task.

Defined results: a text longer than the capacity is cut into full containers and a remainder, each a part of its own;
an empty or null text takes room for one token; null and empty sources are one source; equal sizes and repeated rows are
separate items; empty tables give no rows; specs with a null name, or a null or non-positive capacity, are left out; of
specs with one name the one with the largest capacity holds, of these the one that keeps sources apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aubade.llm.tokens import TOKENIZER, token_sizes
from aubade.session import pinned

#: Permitted lengths as shares of a spec's capacity, and the cost of a container besides its length, in capacities.
LENGTHS = (1.0, 0.75, 0.5, 0.25, 0.125)
CONTAINER_COST = 1.0

#: Specs are settings, read to the driver; more are an error.
MAX_SPECS = 1000

ITEM_SCHEMA = "spec_name string, pack_group string, container bigint, container_length bigint, container_fill bigint, doc_id bigint, part_no bigint, tokens bigint"
PLAN_SCHEMA = "spec_name string, pack_group string, size bigint, first_rank bigint, end_rank bigint, each bigint, first_bin bigint, bin_length bigint, bin_fill bigint"


class _Sizes:
    """Counts by size with the largest size left at or below a limit."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for size, n in counts.items():
            self.left[size] = n
        self.below = list(range(capacity + 1))  # each size, or a smaller one to look on from

    def at_most(self, limit: int, used: dict[int, int]) -> int:
        """The largest size left, beyond those ``used``, or 0."""
        path, s = [], limit
        while s > 0:
            if self.below[s] != s:
                path.append(s)
                s = self.below[s]
            elif self.left[s] == 0:
                path.append(s)
                self.below[s] = s - 1
                s -= 1
            elif self.left[s] <= used.get(s, 0):
                for p in path:
                    self.below[p] = s
                path, s = [], s - 1
            else:
                break
        for p in path:
            self.below[p] = s
        return s

    def fill(self, length: int) -> tuple[dict[int, int], int]:
        """The pattern of the largest items that fit a length, and what it holds."""
        used: dict[int, int] = {}
        free = length
        while free > 0 and (s := self.at_most(free, used)):
            n = min(free // s, self.left[s] - used.get(s, 0))
            used[s] = used.get(s, 0) + n
            free -= n * s
        return used, length - free


def plan(counts: dict[int, int], capacity: int, shares: tuple[float, ...] = LENGTHS, container_cost: float = CONTAINER_COST) -> list[tuple[int, int, int, int, int, int, int]]:
    """(size, first rank, end rank, items a container, first container, length, fill) of all items, by variable-capacity best-fit."""
    lengths = sorted({max(1, round(capacity * s)) for s in shares} | {capacity})
    sizes, out, taken, bins = _Sizes(counts, capacity), [], {}, 0
    while largest := sizes.at_most(capacity, {}):
        best = None
        for length in reversed(lengths):
            if length >= largest:
                pattern, fill = sizes.fill(length)
                cost = (length + container_cost * capacity) / fill
                if best is None or cost < best[0]:
                    best = (cost, pattern, fill)
                if fill == capacity:
                    break
        _, pattern, fill = best
        times = min(sizes.left[s] // n for s, n in pattern.items())
        length = next(x for x in lengths if x >= fill)  # downsized to its contents
        for s, n in pattern.items():
            first = taken.get(s, 0)
            out.append((s, first, first + n * times, n, bins, length, fill))
            taken[s] = first + n * times
            sizes.left[s] -= n * times
        bins += times
    return out


def _plan_group(histogram: pd.DataFrame) -> pd.DataFrame:
    """The plan of one spec and group; the histogram has at most the capacity's rows, whatever the number of items."""
    rows = plan(dict(zip(histogram["size"].tolist(), histogram["n"].tolist(), strict=True)), int(histogram.capacity.iloc[0]))
    frame = pd.DataFrame(rows, columns=["size", "first_rank", "end_rank", "each", "first_bin", "bin_length", "bin_fill"])
    return frame.assign(spec_name=histogram.spec_name.iloc[0], pack_group=histogram.pack_group.iloc[0])


def packed_items(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_name, pack_group, container, container_length, container_fill, doc_id, part_no, tokens`` of every part.

    ``sizes``: ``doc_id, source, tokens``; ``specs``: ``spec_name, capacity_tokens, keep_sources_apart``. Containers are
    numbered from 1 within a spec and group; the group is the source where sources are kept apart, else '*'.
    """
    base = pinned(sizes.withColumn("pack_part", F.spark_partition_id()))
    one = specs.where("capacity_tokens > 0 and spec_name is not null").groupBy("spec_name").agg(F.max(F.struct("capacity_tokens", F.coalesce("keep_sources_apart", F.lit(False)).alias("keep_sources_apart"))).alias("s"))
    usable = one.select("spec_name", "s.*").limit(MAX_SPECS + 1).collect()
    if len(usable) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    if not usable:
        return base.sparkSession.createDataFrame([], ITEM_SCHEMA)
    room = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1))
    spec = F.explode(F.array(*(F.struct(F.lit(s["spec_name"]).alias("spec_name"), F.lit(s["capacity_tokens"]).cast("bigint").alias("capacity"), F.lit(bool(s["keep_sources_apart"])).alias("apart")) for s in usable)))
    items = base.select("*", spec.alias("spec")).select("*", "spec.*").withColumn("part_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(room / F.col("capacity")))))
    items = items.select(
        "spec_name", "capacity", F.when(F.col("apart"), F.coalesce("source", F.lit(""))).otherwise("*").alias("pack_group"), "doc_id", "part_no", "pack_part",
        F.least(F.col("capacity"), room - (F.col("part_no") - 1) * F.col("capacity")).alias("size"), F.coalesce("tokens", F.lit(0)).alias("doc_tokens"),
    )
    key = ["spec_name", "pack_group", "size"]
    by_part = pinned(items.groupBy(*key, "capacity", "pack_part").agg(F.count("*").alias("n")))
    histogram = by_part.groupBy(*key, "capacity").agg(F.sum("n").alias("n"))
    # Specs and groups spread over all tasks; small as they are, they would be coalesced into one.
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plans = histogram.repartition(tasks, "spec_name", "pack_group").groupBy("spec_name", "pack_group").applyInPandas(_plan_group, PLAN_SCHEMA)
    before = Window.partitionBy(*key).orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("capacity")
    stretches = offsets.join(plans, key).where("first_rank < offset + n and end_rank > offset").drop("n")
    local = Window.partitionBy(*key, "pack_part").orderBy("doc_id", "part_no")
    rank = F.col("offset") + F.col("local_rank")
    ranked = items.drop("capacity").withColumn("local_rank", F.row_number().over(local) - 1)
    placed = ranked.join(stretches, [*key, "pack_part"]).where((rank >= F.col("first_rank")) & (rank < F.col("end_rank")))
    container = F.col("first_bin") + F.floor((rank - F.col("first_rank")) / F.col("each")) + 1
    return placed.select(
        "spec_name", "pack_group", container.cast("bigint").alias("container"), F.col("bin_length").alias("container_length"), F.col("bin_fill").alias("container_fill"),
        "doc_id", "part_no", F.least("size", "doc_tokens").alias("tokens"),
    )


def pack_documents(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents packed for every spec."""
    return packed_items(token_sizes(documents, tokenizer), specs)


def pack_report(packed: DataFrame) -> DataFrame:
    """``spec_name, containers, tokens, room, fill``: how full the containers of each spec are, downsized."""
    bins = packed.groupBy("spec_name", "pack_group", "container").agg(F.first("container_length").alias("length"), F.first("container_fill").alias("fill"))
    return bins.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.sum("length").alias("room"), F.round(F.sum("fill") / F.sum("length"), 6).alias("fill"))
