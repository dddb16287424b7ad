"""Streams over small folders."""

from pyspark.sql import functions as F

from aubade.streaming import ingest as S
from tests.conftest import rows

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


def folder(spark, path, data):
    df = spark.createDataFrame(data, "event_id bigint, ts string, user_id bigint, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_windows_sessions_and_state(spark, tmp_path):
    folder(spark, tmp_path / "e", [(1, "2024-01-01 00:10:00", 1, 1.0), (2, "2024-01-01 00:20:00", 1, 2.0), (3, "2024-01-01 05:00:00", 1, 3.0), (4, "2024-01-02 05:00:00", 2, 4.0)])
    stream = S.read_folder(spark, str(tmp_path / "e"), SCHEMA)
    days = S.run_to_table(S.windowed(stream, "ts", "user_id"), "t_days")
    assert sorted(r.n for r in days.collect()) == [1, 3]
    done = S.run_to_table(S.sessions(stream, "ts", "user_id"), "t_sessions", "append")
    assert done.count() <= 3
    totals = S.run_to_table(S.running_totals(stream, "user_id", "value"), "t_totals", "update")
    assert rows(totals) == [("1", 3, 6.0), ("2", 1, 4.0)]


def test_each_event_once(spark, tmp_path):
    folder(spark, tmp_path / "e", [(1, "2024-01-01 00:10:00", 1, 1.0), (1, "2024-01-01 00:10:00", 1, 1.0), (2, "2024-01-01 00:11:00", 1, 1.0)])
    out = S.run_to_table(S.once(S.read_folder(spark, str(tmp_path / "e"), SCHEMA), "event_id", "ts"), "t_once", "append")
    assert out.count() == 2


def test_settled(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 60), (2, "2024-01-01 02:00:00", 60)], "k int, s string, d int").withColumn("s", F.col("s").cast("timestamp"))
    assert rows(S.settled(df, "s", "d", "2024-01-01 02:00:00").select("k")) == [(1,)]


def test_upserts_keep_the_last_version(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder(spark, source, [(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:00:00", 1, 1.0)])
    S.upsert_folder(S.read_folder(spark, str(source), SCHEMA), "event_id", "ts", target, state).awaitTermination()
    folder(spark, source, [(1, "2024-01-02 00:00:00", 1, 9.0)])
    S.upsert_folder(S.read_folder(spark, str(source), SCHEMA), "event_id", "ts", target, state).awaitTermination()
    last = max(S._generations(spark, target))
    assert rows(spark.read.parquet(f"{target}/gen={last}").select("event_id", "value")) == [(1, 9.0), (2, 1.0)]


def test_upserts_keep_rows_without_an_order(spark, tmp_path):
    schema, target = "k bigint, at bigint, v string", str(tmp_path / "out")
    for batch in ([(1, None, "a"), (2, 5, "b")], [(1, None, None), (2, None, "late")], [(2, 6, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.upsert_folder(S.read_folder(spark, str(tmp_path / "in"), schema), "k", "at", target, str(tmp_path / "state")).awaitTermination()
    found = S._generations(spark, target)
    assert len(found) == 2
    assert [(r.k, r.at, r.v) for r in spark.read.parquet(f"{target}/gen={max(found)}").orderBy("k").collect()][1] == (2, 6, "c")
    assert spark.read.parquet(f"{target}/gen={max(found)}").count() == 2
