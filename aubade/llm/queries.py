"""Queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aubade.llm import looks, mixing, nearest, packing, spam, topn, variants
from aubade.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks and their nearest segments."""
    return nearest.found_pairs(*(load(spark, sf_dir, t) for t in ("tracks", "segment_events", "episodes")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most aired works of each composer."""
    return topn.found_top_works(load(spark, sf_dir, "works"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ from their clean form."""
    return looks.found_unclean({t: load(spark, sf_dir, t) for t in ("tracks", "segment_events")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or body."""
    return variants.found_variants(load(spark, sf_dir, "tracks"), load(spark, sf_dir, "segment_events"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the containers of every spec."""
    return packing.pack_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_specs"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each spec are."""
    return packing.pack_report(p8_packing(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    return mixing.mix_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mix reaches."""
    return mixing.mix_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p9_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each mix in global random order."""
    return mixing.shuffled_copies(p9_mix(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuffed pages."""
    return spam.found_spam(load(spark, sf_dir, "documents"))


_NAMED = (p1_found, p4_found, p5_found, p6_found, p8_packing, p8_report, p9_mix, p9_shares, p9_shuffled, p10_found)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {query.__name__: query for query in _NAMED}

ORACLES: dict[str, str] = {
    "p4_found": """
WITH best AS (SELECT composer_slug, slug, max(airings) AS airings FROM works
              WHERE composer_slug IS NOT NULL AND slug IS NOT NULL AND airings IS NOT NULL GROUP BY ALL),
ranked AS (SELECT composer_slug, slug, CAST(row_number() OVER (PARTITION BY composer_slug ORDER BY airings DESC, slug) AS BIGINT) AS place FROM best)
SELECT composer_slug, place, slug FROM ranked WHERE place <= 5""",
}
