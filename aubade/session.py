"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="aubade-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def pinned(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the checkpoint folder: computed once, partitions fixed, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """As ``pinned``, for a table that is made anew each round: the planner's estimate of its size is dropped too.

    A checkpoint keeps the estimate of its plan, and a join's is the product of both sides, so from round to round the
    number of its digits doubles; after some twenty rounds such numbers fill the driver's memory.
    """
    fixed, session = pinned(df)._jdf, df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(fixed.toJavaRDD(), fixed.schema()), session)


def local_session(cpus: str | int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("aubade")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
