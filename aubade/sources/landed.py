"""What has landed and what is still to fetch: seeds, walks, gaps, coverage, guarded readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aubade.session import pinned


def require(spark: SparkSession, path: str) -> str:
    """The path, or an error if nothing lies there."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return path


def ledger(spark: SparkSession, path: str, schema: str, derived: bool) -> DataFrame:
    """A JSON table; a missing one is empty, a corrupt one is empty if it can be derived again, else an error."""
    kind = T._parse_datatype_string(schema)
    try:
        require(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], kind)
    if not derived:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    marked = T.StructType([*kind.fields, T.StructField("corrupt_line", T.StringType())])
    rows = pinned(spark.read.schema(marked).option("columnNameOfCorruptRecord", "corrupt_line").json(path))
    whole = rows.where("corrupt_line is not null").isEmpty()
    return rows.drop("corrupt_line") if whole else spark.createDataFrame([], kind)


def seed(starts: DataFrame, now_s: int) -> DataFrame:
    """``pid``: the newest night already aired, else the soonest to come (A2). ``starts``: ``pid, start_s``."""
    aired = F.col("start_s") <= F.lit(now_s)
    best = starts.agg(F.max(F.when(aired, F.struct("start_s", "pid"))).alias("past"), F.min(F.when(~aired, F.struct("start_s", "pid"))).alias("next"))
    return best.select(F.coalesce("past.pid", "next.pid").alias("pid")).where("pid is not null")


def walk_back(episodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor, pid, steps``: all nights reached from the anchors over previous_pid (A3).

    Doubling: each round knows where 1, 2, 4, ... steps lead, so a chain of n nights takes about log n rounds; a loop
    ends where a night would be reached again.
    """
    jump = pinned(episodes.where("previous_pid is not null and previous_pid <> pid").groupBy("pid").agg(F.min("previous_pid").alias("to")))
    reached = pinned(anchors.select(F.col("pid").alias("anchor"), "pid", F.lit(0).cast("bigint").alias("steps")))
    step = 1
    while step < 1 << 40:
        further = reached.join(jump, "pid").select("anchor", F.col("to").alias("pid"), (F.col("steps") + step).alias("steps"))
        fresh = further.join(reached.select("anchor", "pid"), ["anchor", "pid"], "left_anti")
        after = pinned(reached.unionByName(fresh).groupBy("anchor", "pid").agg(F.min("steps").alias("steps")))
        jump = pinned(jump.select("pid", F.col("to").alias("mid")).join(jump.select(F.col("pid").alias("mid"), "to"), "mid").select("pid", "to"))
        if jump.isEmpty() or after.count() == reached.count():
            return after
        reached, step = after, step * 2
    return reached


def gaps(episodes: DataFrame, starts: DataFrame, now_s: int, floor_s: int, settle_s: int = 3600, retry: bool = False) -> DataFrame:
    """``pid``: nights from a floor on, over for the settling time, whose segments were never asked for - or came empty, on a retry."""
    rows = episodes.join(starts, "pid")
    open_ = F.col("segments_fetched_at").isNull() | (F.lit(retry) & F.col("segments_raw_json").isNull())
    return rows.where((F.col("start_s") >= floor_s) & (F.col("start_s") + F.coalesce("duration_seconds", F.lit(0)) + settle_s < now_s) & open_).select("pid")


def outcomes(episodes: DataFrame) -> DataFrame:
    """``status, nights``: present, absent and never fetched."""
    status = F.when(F.col("segments_raw_json").isNotNull(), "present").when(F.col("segments_fetched_at").isNotNull(), "absent").otherwise("unfetched")
    return episodes.groupBy(status.alias("status")).agg(F.count("*").alias("nights"))
