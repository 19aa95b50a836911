import uuid

from conftest import rows
from pyspark.sql import functions as F

from veridact.streaming import events as S


def stream(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    batch.repartition(4).write.parquet(path)
    return batch, S.from_table(spark, path, batch.schema)


def drained(df, tmp_path, mode):
    return S.drain(df, f"q{uuid.uuid4().hex}", mode, str(tmp_path / uuid.uuid4().hex))


def test_latest_status_equals_batch(spark, small, tmp_path):
    batch, live = stream(spark, small, tmp_path)
    assert rows(drained(S.latest_status(live, ["user_id"]), tmp_path, "complete")) == rows(S.latest_status(batch, ["user_id"]))


def test_windows_close_with_the_watermark(spark, small, tmp_path):
    batch, live = stream(spark, small, tmp_path)
    done = rows(drained(S.tumbling(live, "1 day", "0 seconds"), tmp_path, "append"))
    assert set(done) <= set(rows(S.tumbling(batch, "1 day", "0 seconds")))


def test_duplicates_go(spark, small, tmp_path):
    batch, _ = stream(spark, small, tmp_path)
    path = str(tmp_path / "twice")
    batch.union(batch).repartition(3).write.parquet(path)
    live = S.deduplicated(S.from_table(spark, path, batch.schema), "100 days")
    assert drained(live, tmp_path, "append").count() == batch.count()


def test_stale_keys(spark, small, tmp_path):
    _, live = stream(spark, small, tmp_path)
    out = drained(S.stale(live, "user_id", 60), tmp_path, "append")
    assert out.filter("NOT stale").count() > 0


def test_pairs_and_gaps(spark, small, tmp_path):
    _, live = stream(spark, small, tmp_path)
    joined = S.paired(live.filter("event_type = 'view'"), live.filter("event_type = 'purchase'"), "user_id", "2 HOURS", "1 hour")
    assert drained(joined, tmp_path, "append").filter("ended < began").count() == 0
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 3)], "k string, s int")
    assert rows(S.gaps_in_sequence(df, "k", "s")) == [("a", 2, 2)]


def test_follow_leaves_a_torn_line_out(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"event_id": 1, "ts": "2024-01-01T00:00:00Z", "user_id": 1}\n{"event_id": 2, "ts"')
    assert drained(S.follow(spark, str(tmp_path / "log")), tmp_path, "append").count() == 1
