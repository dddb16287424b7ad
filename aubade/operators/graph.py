"""Connected components and alias chains over edge tables, by joins in rounds; each round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aubade.session import pinned, settled


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for edges ``a, b``: the smallest id of each connected component.

    Each round takes the least label of the neighbours and jumps to the label's own label, so chains halve.
    """
    edges = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settled(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("root").alias("low"))
        stepped = labels.join(near, labels.id == near.a).select("id", "root", F.least("root", "low").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("root").alias("far"))
        after = settled(stepped.join(jump, "new", "left").select("id", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        if after.where("old <> root").isEmpty():
            return after.select("id", "root")
        labels = after.drop("old")


def resolved(aliases: DataFrame) -> DataFrame:
    """``variant, preferred`` with every chain followed to its end.

    Pointers double each round; names still pointing at a variant once no more reach an end lead into a cycle and
    resolve to the smallest name of their component.
    """
    pairs = pinned(aliases.where("variant is not null and preferred is not null and variant <> preferred").groupBy("variant").agg(F.min("preferred").alias("preferred")))
    variants = pairs.select(F.col("variant").alias("preferred"))
    now, open_before = pairs, None
    while True:
        still_open = now.join(variants, "preferred", "left_semi").count()
        if still_open == 0 or still_open == open_before:
            break
        hop = now.select(F.col("variant").alias("preferred"), F.col("preferred").alias("far"))
        now, open_before = pinned(now.join(hop, "preferred", "left").select("variant", F.coalesce("far", "preferred").alias("preferred"))), still_open
    if still_open == 0:
        return now.select("variant", "preferred")
    ends = now.join(variants, "preferred", "left_anti").select("variant", "preferred")
    looping = pairs.join(now.join(variants, "preferred", "left_semi").select("variant"), "variant", "left_semi")
    roots = components(looping.select(F.col("variant").alias("a"), F.col("preferred").alias("b"))).select(F.col("id").alias("variant"), F.col("root").alias("preferred"))
    return ends.unionByName(roots.join(looping.select("variant"), "variant", "left_semi").where("variant <> preferred"))


def alias_health(aliases: DataFrame, used: DataFrame) -> DataFrame:
    """``chained, dead``: aliases that lead to another alias, and aliases no row uses (C21). ``used``: ``variant``."""
    chained = aliases.join(aliases.select(F.col("variant").alias("preferred")).distinct(), "preferred", "left_semi").agg(F.count("*").alias("chained"))
    dead = aliases.join(used.select("variant").distinct(), "variant", "left_anti").agg(F.count("*").alias("dead"))
    return chained.crossJoin(dead)


def with_alias(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Rows with ``column`` replaced by its preferred form where an alias exists (C20)."""
    table = aliases.select(F.col("variant").alias(column), F.col("preferred").alias("alias_to"))
    return rows.join(table, column, "left").withColumn(column, F.coalesce("alias_to", column)).drop("alias_to")
