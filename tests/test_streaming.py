import datetime as dt

from purlin.streaming import events as ops


def run_stream(spark, frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def make(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i + (90 if i > 20 else 0)), i % 2, "ab"[i % 2], 1.0, "{}") for i in range(40)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events")
    return spark.read.parquet(f"{tmp_path}/events"), spark.readStream.schema(schema).parquet(f"{tmp_path}/events")


def test_tumbling_stream_equals_batch(spark, tmp_path):
    batch, stream = make(spark, tmp_path)
    want = sorted(map(tuple, ops.tumbling_counts(batch, "1 hour").collect()))
    assert sorted(map(tuple, run_stream(spark, ops.tumbling_counts(stream, "1 hour"), "tumbling", "complete"))) == want


def test_closed_sessions_equal_batch(spark, tmp_path):
    batch, stream = make(spark, tmp_path)
    want = set(map(tuple, ops.sessions(batch, "30 minutes").collect()))
    got = set(map(tuple, run_stream(spark, ops.sessions(stream, "30 minutes"), "sessions", "append")))
    assert len(want) == 4 and got <= want and len(got) >= 2  # sessions still open aren't emitted


def test_conversation_memory(spark, tmp_path):
    rows = [(1, t, "user", f"m{t}") for t in range(6)] + [(2, 0, "user", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{tmp_path}/c")
    got = {r.conv_id: r for r in run_stream(spark, ops.conversation_memory(stream), "memory_of", "update")}
    assert got[1].messages == 6 and got[1].recent == [f"user: m{t}" for t in (2, 3, 4, 5)] and got[1].summary == "user: m0\nuser: m1"
    assert got[2].recent == ["user: hi"]
