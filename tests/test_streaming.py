import pytest
from pyspark.sql import functions as F

from quarry import streaming

from .conftest import SMALL


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(3, "ts").write.mode("overwrite").parquet(path)
    return path, e


def test_moments_equal_the_batch(spark, events, tmp_path):
    path, e = events
    s = streaming.moments(streaming.file_stream(spark, path, e.schema), "event_type", "value")
    found = {r["event_type"]: (r["n"], round(r["mean"], 6), round(r["var_"], 5)) for r in streaming.drain(s, "m", "complete", str(tmp_path)).collect()}
    plain = e.groupBy("event_type").agg(F.count("value"), F.avg("value"), F.var_pop("value")).collect()
    assert found == {r[0]: (r[1], round(r[2], 6), round(r[3], 5)) for r in plain}


def test_repeats_are_dropped(spark, events, tmp_path):
    path, e = events
    s = streaming.file_stream(spark, path, e.schema)
    s = streaming.once_per_key(s.unionAll(streaming.file_stream(spark, path, e.schema)), ["event_id"], "ts", "3650 days")
    assert streaming.drain(s.select("event_id"), "once", "append", str(tmp_path)).count() == e.count()


def test_budget_windows_equal_the_batch(spark, events, tmp_path):
    path, e = events
    s = streaming.budget(streaming.file_stream(spark, path, e.schema, 10), "user_id", "value", "ts", "1 minute")
    found = {(r["w"]["start"], r["user_id"]): r["calls"] for r in streaming.drain(s, "b", "append", str(tmp_path)).collect()}
    plain = {(r["w"]["start"], r["user_id"]): r["calls"] for r in e.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "user_id").agg(F.count("*").alias("calls")).collect()}
    assert found and all(plain[k] == v for k, v in found.items())


def test_batches_merge_once(spark, events, tmp_path):
    path, e = events
    out = str(tmp_path / "out")
    s = streaming.file_stream(spark, path, e.schema).select("user_id", "event_type")
    streaming.merge_batches(s, out, ["user_id", "event_type"], str(tmp_path / "c"))
    streaming.merge_batches(s, out, ["user_id", "event_type"], str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == e.select("user_id", "event_type").distinct().count()
