"""Nearest record in time for the same entity, within a tolerance.

Targets are cut into entity-time shards whose edges overlap by the tolerance, so the nearest target of a probe always
lies in the probe's own shard. Targets of one second are reduced to their smallest id and probes of one second to one,
so a shard holds at most its width in rows whatever the entity's size. In each shard a piecewise-linear learned index,
its pieces fitted to an error bound, predicts the place of a time; a search within the bound gives the exact neighbours.

Defined results: rows with a null entity, time or id have no partner; times may be any whole numbers of 64 bits; equal
distances go to the smaller target id; repeated probes each get their row; empty tables give no rows; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aubade.operators.instants import track_instants

#: Places by which a prediction may be off; pieces are as long as that allows.
ERROR = 8


class LearnedIndex:
    """Lines over sorted distinct integers, each as far as it foretells the place of its keys to within the error."""

    def __init__(self, keys: np.ndarray, error: int = ERROR):
        self.keys, self.error = keys, error
        first, slope, i = [], [], 0
        while i < len(keys):
            end, best = self._piece(i)
            first.append(i)
            slope.append(best)
            i = end
        self.first, self.slope = np.array(first, np.int64), np.array(slope, float)
        self.last = np.append(self.first[1:], len(keys))[: len(first)]
        self.base = keys[self.first] if len(first) else keys

    def _piece(self, i: int) -> tuple[int, float]:
        """(end, slope) of the longest piece from key i on whose line stays within the error: slopes that do narrow to a cone."""
        step = 64
        while True:
            ahead = np.arange(1, min(len(self.keys) - i, step))
            run = (self.keys[i + 1 : i + step] - self.keys[i]).astype(float)
            low, high = np.maximum.accumulate((ahead - self.error) / run), np.minimum.accumulate((ahead + self.error) / run)
            out = np.flatnonzero(low > high)
            if not len(out) and i + step < len(self.keys):
                step *= 2
                continue
            n = int(out[0]) if len(out) else len(ahead)
            return i + 1 + n, float(max(0.0, low[n - 1] + high[n - 1]) / 2) if n else 0.0

    def place(self, x: np.ndarray) -> np.ndarray:
        """How many keys are below each x: predicted by the piece it falls in, then searched for within the error."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64)
        piece = np.maximum(np.searchsorted(self.base, x, "right") - 1, 0)
        first, last = self.first[piece], self.last[piece]
        guess = np.clip(first + self.slope[piece] * (x - self.base[piece]), first, last).astype(np.int64)
        low, high = np.maximum(guess - self.error - 1, first), np.minimum(guess + self.error + 2, last)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = self.keys[np.minimum(middle, len(self.keys) - 1)] < x
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low


def _match(batch: pa.RecordBatch, tolerance: int, width: int) -> pa.RecordBatch:
    """The matches of a batch of shards, all on one axis: shard by shard, a gap wider than the tolerance between them."""
    shard = np.asarray(batch.column("shard"))
    span = width + 4 * tolerance + 4

    def flat(name: str) -> tuple[pa.Array, np.ndarray]:
        lists = batch.column(name)
        return lists.flatten(), np.asarray(pa.compute.list_parent_indices(lists))

    probes, probe_of = flat("probe_times")
    targets, target_of = flat("targets")
    times, ids = np.asarray(targets.field("t")), np.asarray(targets.field("target_id"))
    # Near the ends of the range the product wraps around, and the difference back.
    axis = lambda t, of: of * span + (t - shard[of] * width) + 2 * tolerance
    probe_t = np.asarray(probes)
    target_x, probe_x = axis(times, target_of), axis(probe_t, probe_of)
    order = np.argsort(target_x, kind="stable")
    target_x, ids, target_of = target_x[order], ids[order], target_of[order]
    place = LearnedIndex(target_x).place(probe_x)
    best_d = np.full(len(probe_x), tolerance + 1, np.int64)
    best_id = np.zeros(len(probe_x), np.int64)
    for at in (place - 1, place):
        inside = (at >= 0) & (at < len(target_x))
        k = np.clip(at, 0, max(len(target_x) - 1, 0))
        d = np.where(inside & (target_of[k] == probe_of), np.abs(target_x[k] - probe_x), tolerance + 1)
        better = (d < best_d) | ((d == best_d) & (d <= tolerance) & (ids[k] < best_id))
        best_d, best_id = np.where(better, d, best_d), np.where(better, ids[k], best_id)
    hit = np.flatnonzero(best_d <= tolerance)
    return pa.RecordBatch.from_arrays([batch.column("entity").take(pa.array(probe_of[hit])), pa.array(probe_t[hit]), pa.array(best_id[hit])], ["entity", "t", "target_id"])


def nearest_in_time(probes: DataFrame, targets: DataFrame, tolerance: int, width: int = 3600) -> DataFrame:
    """``probe_id, target_id``: each probe's nearest target of its entity, at most ``tolerance`` seconds away.

    ``probes``: ``entity, t, probe_id``; ``targets``: ``entity, t, target_id``; times are whole seconds.
    """
    probes = probes.where("entity is not null and t is not null and probe_id is not null")
    once = targets.where("entity is not null and t is not null and target_id is not null").groupBy("entity", "t").agg(F.min("target_id").alias("target_id"))
    # In whole numbers that can't overflow: the shard, and the place within it.
    within = F.expr(f"pmod(t, {width}L)")
    shard = F.expr(f"t div {width}L - if(t < 0 and t % {width}L <> 0, 1L, 0L)")
    near = lambda by: shard + F.floor((within + by) / width).cast("bigint")
    indexed = once.withColumn("shard", F.explode(F.sequence(near(-tolerance), near(tolerance)))).groupBy("entity", "shard").agg(F.collect_list(F.struct("t", "target_id")).alias("targets"))
    asked = probes.groupBy("entity", shard.alias("shard")).agg(F.collect_set("t").alias("probe_times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _match(batch, tolerance, width)

    kind = dict(probes.dtypes)["entity"]
    matched = asked.join(indexed, ["entity", "shard"]).mapInArrow(run, f"entity {kind}, t bigint, target_id bigint")
    return probes.join(matched, ["entity", "t"]).select("probe_id", "target_id")


def found_pairs(tracks: DataFrame, segment_events: DataFrame, episodes: DataFrame, tolerance: int = 90) -> DataFrame:
    """``track_id, segment_id``: tracks with a clock time and the segment of their episode nearest in elapsed time."""
    clocks = track_instants(tracks, episodes).select(F.col("scan_group").alias("entity"), (F.col("utc_s") - F.col("start_s")).alias("t"), F.col("rec_id").alias("probe_id"))
    segments = segment_events.select(F.col("episode_pid").alias("entity"), F.col("version_offset").alias("t"), F.col("id").alias("target_id"))
    return nearest_in_time(clocks, segments, tolerance).select(F.col("probe_id").alias("track_id"), F.col("target_id").alias("segment_id"))
