"""Streams over given or small tables: what they end with equals the batch operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docketry.sources import store
from docketry.streaming import jobs


def source(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_audit_is_redacted(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, "call 012-345 6789")], [(2, "pay RM 5,000 now"), (3, None)]], "id long, text string")
    jobs.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "call [PHONE_REDACTED]", 2: "pay [AMOUNT_REDACTED] now", 3: None}


def test_audit_rows(spark, tmp_path):
    schema = "trace_id string, session_id string, channel string, route string, rule_version string, guardrail struct<flagged:boolean,text:string>, primary string, confidence double, secondary string, decision_inputs map<string,string>, handoff_required boolean, reply string"
    rows = [("t1", "s", "web", None, None, (True, "call 012-345 6789"), "INS-01", 0.9, None, {"status": "ok", "said": "RM 5,000"}, None, "Our loan is cheap"), ("t2", "s", "web", "R", "v", None, None, None, None, None, True, "hello")]
    out = jobs.audit_rows(source(spark, tmp_path, [rows], schema), F.lit("2025-01-01 00:00:00"))
    jobs.audit_stream(out, str(tmp_path / "out"), str(tmp_path / "cp"), ()).awaitTermination()
    got = {r["trace_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    a, b = got["t1"], got["t2"]
    assert (a["route"], a["rule_version"], a["handoff_required"], a["guardrail"]["text"]) == ("", "", False, "call [PHONE_REDACTED]") and tuple(a["intent"]) == ("INS-01", 0.9, None)
    assert a["decision_inputs"]["said"] == "[AMOUNT_REDACTED]" and "loan" in a["decision_inputs"]["terminology_violations"]
    assert (b["decision_inputs"], b["handoff_required"], b["guardrail"]) == ({}, True, None)


def files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in (root / "data").rglob("*.parquet")}


def stored(spark, root, commit=None):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("chunk_id", StringType()), StructField("version", LongType()), StructField("body", StringType())])
    return sorted((tuple(r) for r in store.read_store(spark, str(root), schema, commit).collect()), key=repr)


SCHEMA = "chunk_id string, version long, body string"


def test_upsert_keeps_the_newest(spark, tmp_path):
    batches = [[("a", 1, "x"), ("b", 1, "x"), ("b", 3, "new"), ("b", 2, "old"), (None, 1, "n")], [("b", 2, "later"), ("c", 2, "x"), (None, 2, "m")]]
    stream = source(spark, tmp_path, batches, SCHEMA)
    jobs.upsert_stream(stream, str(tmp_path / "store"), "chunk_id", str(tmp_path / "cp"), order=("version",), buckets=8).awaitTermination()
    assert stored(spark, tmp_path / "store") == sorted([("a", 1, "x"), ("b", 2, "later"), ("c", 2, "x"), (None, 2, "m")], key=repr)
    assert ("b", 3, "new") in stored(spark, tmp_path / "store", 0)


def test_untouched_buckets_keep_their_files_and_replays_change_nothing(spark, tmp_path):
    root = tmp_path / "store"
    assert stored(spark, root) == []
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v, f"body {v}") for i in ids], SCHEMA)
    store.merge_batch(rows(range(100), 1), 0, str(root), "chunk_id", ("version",), 16)
    first = files(root)
    store.merge_batch(rows([7, 200], 2), 1, str(root), "chunk_id", ("version",), 16)
    second = files(root)
    assert first.items() <= second.items() and len({f.split("bucket=")[1].split("/")[0] for f in second.keys() - first.keys()}) <= 2
    want = sorted([(f"k{i}", 2 if i in (7, 200) else 1, f"body {2 if i in (7, 200) else 1}") for i in [*range(100), 200]], key=repr)
    assert stored(spark, root) == want
    store.merge_batch(rows([7, 200], 2), 1, str(root), "chunk_id", ("version",), 16)
    assert files(root) == second and stored(spark, root) == want
    store.merge_batch(rows([], 3), 2, str(root), "chunk_id", ("version",), 16)
    assert files(root) == second and stored(spark, root) == want


def test_a_batch_without_its_commit_is_not_there(spark, tmp_path, monkeypatch):
    root = tmp_path / "store"
    rows = lambda v: spark.createDataFrame([("a", v, "x"), ("b", v, "y")], SCHEMA)
    store.merge_batch(rows(1), 0, str(root), "chunk_id", (), 4)
    store.merge_batch(rows(2), 1, str(root), "chunk_id", (), 4)
    for f in sorted((root / "commits" / "commit=1").iterdir()):
        f.unlink()
    (root / "commits" / "commit=1").rmdir()
    assert stored(spark, root) == [("a", 1, "x"), ("b", 1, "y")]
    store.merge_batch(rows(3), 1, str(root), "chunk_id", (), 4)
    assert stored(spark, root) == [("a", 3, "x"), ("b", 3, "y")]


def test_daily_rollup_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = jobs.daily_rollup(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()
    assert {(r["day"], r["event_type"], r["n"]) for r in spark.table("daily").collect()} == {tuple(r) for r in want}


def with_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_balance_breaks_across_batches(spark, tmp_path):
    with_state(spark)
    batches = [[("a", 0, None, None, 100.0), ("a", 1, 30.0, None, 70.0), ("b", 0, None, None, 1.0)], [("a", 2, None, None, None), ("a", 3, None, 5.0, 80.0), ("b", 1, None, 1.0, 2.0)]]
    stream = source(spark, tmp_path, batches, "statement string, row_no long, debit double, credit double, balance double")
    assert drained(jobs.balance_break_stream(stream), tmp_path, "breaks") == [("a", 3, 75.0, 80.0)]


def test_session_flow_across_batches(spark, tmp_path):
    with_state(spark)
    batches = [[("s", 0, True), ("t", 0, False)], [("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, True)]]
    stream = source(spark, tmp_path, batches, "session_id string, turn long, unclear boolean")
    got = sorted(drained(jobs.session_flow_stream(stream), tmp_path, "flow"))
    assert got == [("s", 0, "clarify"), ("s", 1, "hand_off"), ("s", 2, None), ("s", 3, "clarify"), ("t", 0, None), ("t", 1, "clarify")]


def at(minute):
    return dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def test_sessions_end(spark, tmp_path):
    """A session that is quiet ends and starts anew; one that goes on does not; a turn behind the watermark is dropped."""
    with_state(spark)
    batches = [[("s", 0, True, at(0)), ("t", 0, True, at(0))], [("t", 1, True, at(50))], [("u", 0, False, at(200))], [("s", 1, True, at(210)), ("t", 2, True, at(20))], [("u", 1, False, at(400))]]
    stream = source(spark, tmp_path, batches, "session_id string, turn long, unclear boolean, ts timestamp")
    got = sorted(drained(jobs.session_flow_stream(stream, idle="60 minutes", late="10 minutes"), tmp_path, "ended"), key=repr)
    # s asks again instead of handing off, t's late turn left no trace, and only u, whose last turn holds it up, has not ended.
    assert got == sorted([("s", 0, "clarify"), ("t", 0, "clarify"), ("t", 1, "hand_off"), ("s", 0, "ended"), ("t", 1, "ended"), ("u", 0, None), ("s", 1, "clarify"), ("s", 1, "ended"), ("u", 1, None)], key=repr)


def test_statements_end(spark, tmp_path):
    with_state(spark)
    batches = [[("a", 0, None, None, 100.0, at(0))], [("a", 1, 30.0, None, 60.0, at(30))], [("b", 0, None, None, 1.0, at(500))], [("a", 2, 1.0, None, 5.0, at(510)), ("b", 1, None, 1.0, 3.0, at(505))]]
    stream = source(spark, tmp_path, batches, "statement string, row_no long, debit double, credit double, balance double, ts timestamp")
    got = sorted(drained(jobs.balance_break_stream(stream, idle="2 hours", late="10 minutes"), tmp_path, "closed"))
    assert got == [("a", 1, 70.0, 60.0), ("b", 1, 2.0, 3.0)]
