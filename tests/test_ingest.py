import datetime as dt

import pytest
from pyspark.sql import functions as F

from purlin.operators.registry import evicted
from purlin.sources.store import Store
from purlin.streaming.ingest import DocumentIndex
from purlin.streaming.sessions import LiveTable, Memory, conversation_events

DOCS = "document_id string, filename string, version bigint, text string"


def words(documents):
    return documents.select("document_id", "version", F.posexplode(F.split("text", " ")).alias("chunk_no", "chunk")).where("chunk != ''")


def index_at(spark, root):
    fault = F.when(~F.col("filename").endswith(".txt"), "only .txt files are taken")
    return DocumentIndex(spark, f"{root}/index", words, "document_id string, version bigint, chunk_no int, chunk string", fault)


def held(index):
    out = {}
    for r in index.chunks().orderBy("document_id", "chunk_no").collect():
        out.setdefault((r.document_id, r.version), []).append(r.chunk)
    return out


def drop(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(2)


def test_later_versions_replace_and_replays_change_nothing(spark, tmp_path):
    index = index_at(spark, tmp_path)
    index.apply(drop(spark, [("a", "a.txt", 1, "x y"), ("a", "a.txt", 2, "p q r"), ("b", "b.txt", 1, "z")]), 0)
    assert held(index) == {("a", 2): ["p", "q", "r"], ("b", 1): ["z"]}
    second = drop(spark, [("a", "a.txt", 3, "new"), ("b", "b.exe", 9, "bad"), ("c", "c.txt", 1, "  "), ("d", "d.txt", 1, None)])
    index.apply(second, 1)
    want = {("a", 3): ["new"], ("b", 1): ["z"]}
    assert held(index) == want
    log = {r.document_id: (r.status, r.error, r.chunks_extracted, r.stale_chunks_replaced) for r in index.log().where("commit = 1").collect()}
    assert log["a"] == ("indexed", None, 1, 3)
    assert log["b"] == ("failed", "only .txt files are taken", 0, 0)
    assert log["c"][:2] == log["d"][:2] == ("failed", "no text could be extracted")
    index.apply(drop(spark, [("a", "a.txt", 4, "other")]), 1)  # the batch was committed before
    assert held(index) == want and index.log().count() == 6


def test_a_batch_that_died_is_not_seen_and_can_be_redone(spark, tmp_path, monkeypatch):
    index = index_at(spark, tmp_path)
    index.apply(drop(spark, [("a", "a.txt", 1, "x")]), 0)
    publish = Store.publish
    monkeypatch.setattr(Store, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        index.apply(drop(spark, [("a", "a.txt", 2, "half")]), 1)
    monkeypatch.setattr(Store, "publish", publish)
    assert held(index) == {("a", 1): ["x"]}
    index.apply(drop(spark, [("a", "a.txt", 2, "whole now")]), 1)
    assert held(index) == {("a", 2): ["whole", "now"]}


def test_deletion_and_compaction(spark, tmp_path):
    index = index_at(spark, tmp_path)
    for i, text in enumerate(["one", "two", "three"]):
        index.apply(drop(spark, [("a", "a.txt", i, text), (f"x{i}", "x.txt", 1, "k")]), i)
    index.delete(["x1", "unknown"])
    want = {("a", 2): ["three"], ("x0", 1): ["k"], ("x2", 1): ["k"]}
    assert held(index) == want
    index.compact()
    assert held(index) == want and len(index.store.commits()) == 1
    index.apply(drop(spark, [("a", "a.txt", 7, "again")]), 2)  # done before the compaction
    assert held(index) == want
    index.apply(drop(spark, [("a", "a.txt", 7, "again")]), 3)
    assert held(index) == {**{k: v for k, v in want.items() if k[0] != "a"}, ("a", 7): ["again"]}


def test_stream_of_files(spark, tmp_path):
    index = index_at(spark, tmp_path)
    for version, text in ((1, "old text"), (2, "new")):
        drop(spark, [("a", "a.txt", version, text), (f"only{version}", "o.txt", 1, "k")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in")
        index.start(arriving, f"{tmp_path}/check").awaitTermination(120)
    assert held(index) == {("a", 2): ["new"], ("only1", 1): ["k"], ("only2", 1): ["k"]}


def test_two_writers_get_two_numbers(spark, tmp_path):
    a, b = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    assert a.publish("p") == 0 and b.publish("q") == 1
    assert not a.files.create("_commits/000000000001.json", "{}")
    assert [c["part"] for c in b.commits()] == ["p", "q"]
    schema = spark.range(0).schema
    assert a.read("t", schema).count() == 0
    a.stage("t", "q", spark.range(3))
    a.stage("t", "orphan", spark.range(9))
    assert sorted(map(tuple, b.read("t", schema).collect())) == [(0, 1), (1, 1), (2, 1)]


def test_memory_in_any_order():
    rows = [(t, f"user: {'m' * (t % 7)}{t}") for t in range(60)]
    straight, shuffled = Memory(4, 50), Memory(4, 50)
    for m, order in ((straight, rows), (shuffled, rows[::2] + rows[1::2][::-1])):
        for r in order:
            m.add(*r)
        m.settle()
    assert (straight.n, straight.held, straight.summary) == (shuffled.n, shuffled.held, shuffled.summary)
    assert straight.summary == "\n".join(m for _, m in rows[:-4])[-50:] and [t for t, _ in straight.held] == [56, 57, 58, 59]


def test_conversations_expire_on_the_event_clock(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda hours: start + dt.timedelta(hours=hours)
    drops = [
        [(1, 0, "user", "a", at(0)), (1, 1, "assistant", "b", at(0.1)), (2, 0, "user", "c", at(1))],
        [(2, 1, "user", "d", at(6)), (3, 0, "user", "e", at(6.5))],
        [(4, 0, "user", "f", at(12.5)), (2, 2, "user", "g", at(11))],
    ]
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    table = LiveTable(spark, f"{tmp_path}/live")
    for i, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        turns = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        events = conversation_events(turns, recent=1, ttl_seconds=6 * 3600)
        query = events.writeStream.option("checkpointLocation", f"{tmp_path}/check").outputMode("update").foreachBatch(table.apply).trigger(availableNow=True).start()
        query.awaitTermination(120)
        now = max(r[4] for d in drops[: i + 1] for r in d)
        last = {}
        for d in drops[: i + 1]:
            for conv, _, _, _, ts in d:
                last[conv] = max(ts, last.get(conv, ts))
        states = spark.createDataFrame(list(last.items()), "conv_id long, last_access timestamp")
        want = {r.conv_id for r in evicted(states, F.lit(now)).collect()}
        assert {r.conv_id for r in table.current().collect()} == want == {r.conv_id for r in table.live(F.lit(now)).collect()}
    kept = {r.conv_id: r for r in table.current().collect()}
    assert set(kept) == {2, 3, 4} and kept[2].messages == 3 and kept[2].recent == ["user: g"] and kept[2].summary == "user: c\nuser: d"
    assert [r.conv_id for r in table.live(F.lit(at(12.5)), most=1).collect()] == [4]
