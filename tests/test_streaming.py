"""Streams that begin without a table and streams that run a batch again."""

import json

from pyspark.sql import functions as F

from ledgerleaf.operators.ordering import rank_in_group
from ledgerleaf.streaming import jobs


def test_runs_begin_a_table_and_are_not_attached_twice(spark, tmp_path):
    source = tmp_path / "in"
    rows = [{"conv_id": 3, "run_id": f"r{i}", "at": i, "reply": f"reply {i}", "trace": json.dumps({"run_id": f"r{i}", "events": []})} for i in range(3)]
    spark.createDataFrame([(json.dumps(r),) for r in rows] + [("broken",)], "payload string").write.parquet(str(source))
    stored, bad = str(tmp_path / "messages"), str(tmp_path / "bad")
    for again in range(2):
        payloads = spark.readStream.schema("payload string").parquet(str(source))
        jobs.record_run_stream(payloads, stored, bad, str(tmp_path / f"state{again}"), buckets=2).awaitTermination()
        got = spark.read.parquet(stored).orderBy("idx").collect()
        assert [(r.conv_id, r.content) for r in got] == [(3, f"reply {i}") for i in range(3)]
        assert spark.read.json(bad).count() == 1


def test_versions_follow_batches(spark, tmp_path):
    path = str(tmp_path / "docs")
    for version in (1, 2):
        source = str(tmp_path / f"in{version}")
        spark.createDataFrame([(1, f"old {version}", 1), (1, f"new {version}", 2), (2, "two", 1)], "doc_id long, text string, arrived_at long").write.parquet(source)
        state = str(tmp_path / f"state{version}")
        for _again in range(2):
            uploads = spark.readStream.schema("doc_id long, text string, arrived_at long").parquet(source)
            jobs.ingest_stream(uploads, lambda df: df, path, state).awaitTermination()
    table = spark.read.parquet(path)
    assert table.select("_version").distinct().count() == 2
    assert {(r.doc_id, r.text) for r in jobs.current_rows(table).collect()} == {(1, "new 2"), (2, "two")}
    jobs.compact(spark, path, str(tmp_path / "compact"))
    assert {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "compact")).collect()} == {(1, "new 2"), (2, "two")}


def test_null_keys_keep_their_place(spark):
    rows = [(None, 1), (None, 2), ("a", 1)]
    df = spark.createDataFrame(rows, "k string, at long").withColumn("tie", F.lit(0))
    assert sorted((r.k or "", r.at, r.no) for r in rank_in_group(df, ["k"], "at", "tie", "no").collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_folds_survive_a_restart_drop_replays_and_expire(spark, tmp_path):
    def line(**event):
        return "data: " + json.dumps(event)

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id string, seq long, line string, at timestamp"

    def arrive(*rows):
        at = lambda s: f"timestamp_seconds({1_700_000_000 + s})"
        parts = [spark.createDataFrame([(r, n, text)], "run_id string, seq long, line string").selectExpr("*", f"{at(s)} AS at") for r, n, text, s in rows]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.write_folds(spark.readStream.schema(schema).parquet(source), out, state, late="10 seconds", quiet_ms=60_000).awaitTermination()
        return {r.run_id: (r.reply, r.conversation_id, r.agent_messages, r.failed, r.detail, r.version, r.closed) for r in jobs.latest_folds(spark, out).collect()}

    got = arrive(("a", 0, line(type="agent_message", content="x"), 0), ("b", 0, line(type="agent_message", content="y"), 0), ("a", 0, line(type="agent_message", content="x"), 0), ("a", 9, "no event", 0))
    assert got == {"a": ("", None, 1, False, None, 1, False), "b": ("", None, 1, False, None, 1, False)}
    got = arrive(("a", 2, line(type="done", reply="second", conversation_id=7), 3), ("a", 1, line(type="done", reply="first", conversation_id=6), 2), ("a", 0, line(type="agent_message", content="x"), 1))
    assert got["a"] == ("second", 7, 1, False, None, 3, False)
    # Much later events of another run let the others expire.
    got = arrive(("c", 0, line(type="error", detail="broken"), 500))
    got = arrive(("c", 1, line(type="agent_message", content=""), 501))
    assert got["c"] == ("", None, 0, True, "broken", 2, False)
    assert got["a"][-1] and got["b"][-1] and got["a"][:2] == ("second", 7)


def test_runs_share_rows_of_state_and_close_one_by_one(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, large = "run_id string, seq long, line string, at timestamp", 2**60 + 1

    def arrive(*rows):
        texts = [(run, seq, "data: " + json.dumps(event), s) for run, seq, event, s in rows]
        df = spark.createDataFrame(texts, "run_id string, seq long, line string, s int").selectExpr("run_id", "seq", "line", "timestamp_seconds(1700000000 + s) AS at")
        df.coalesce(1).write.mode("append").parquet(source)
        query = jobs.write_folds(spark.readStream.schema(schema).parquet(source), out, state, late="10 seconds", quiet_ms=60_000, buckets=3)
        query.awaitTermination()
        assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 3
        return {r.run_id: (r.reply, r.conversation_id, r.agent_messages, r.failed, r.version, r.closed) for r in jobs.latest_folds(spark, out).collect()}

    runs = [None, *(f"r{i}" for i in range(20))]
    done = lambda i: {"type": "done", "reply": f"reply {i}", "conversation_id": large + i}
    talk = {"type": "agent_message", "content": "x"}
    got = arrive(*((run, 0, done(i) if i % 2 else talk, i) for i, run in enumerate(runs)))
    first = {run: (f"reply {i}", large + i, 0, False, 1, False) if i % 2 else ("", None, 1, False, 1, False) for i, run in enumerate(runs)}
    assert got == first
    # New events of one run and replays of others change that one run only.
    got = arrive(("r4", 1, {"type": "error", "detail": "broken"}, 30), ("r4", 0, done(5), 30), ("r7", 0, talk, 30))
    first["r4"] = (*first["r4"][:3], True, 2, False)
    assert got == first
    # Runs whose quiet time the watermark has passed close in the next batch, also beside a run with events.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        first["r12"] = (*first["r12"][:2], first["r12"][2] + 1, False, 2, False)
        assert arrive(("r12", 1, talk, 79)) == first
        first["r12"] = (*first["r12"][:2], first["r12"][2] + 1, False, 3, False)
        quiet = lambda i, run: i < 9 and run not in ("r4", "r7")
        assert arrive(("r12", 2, talk, 90)) == {run: (*f[:5], quiet(i, run)) for i, (run, f) in enumerate(first.items())}
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = arrive(("r12", 3, talk, 90))
    assert {run for run, f in got.items() if f[-1]} == set(runs[:20]) - {"r4", "r7", "r12"}
