"""Message routing over files with a stateful stream."""

import json

from lorikeet.streaming import messages as M


def send(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, source, tmp_path, name):
    replies = M.route(M.read_messages(spark, str(source), 1), None)
    q = replies.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_handshake_routing_and_fan_out(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    send(source, "1.json", [
        {"connection_id": "a", "type": "ping", "ts": at(1)},
        {"connection_id": "a", "type": "initialize_session", "session_id": "s1", "ts": at(2)},
        {"connection_id": "a", "type": "ping", "ts": at(3)},
        {"connection_id": "b", "type": "initialize_session", "session_id": "s1", "ts": at(4)},
    ])
    send(source, "2.json", [
        {"connection_id": "a", "type": "child_response", "item_id": "i", "response": "cat", "ts": at(5)},
        {"connection_id": "a", "type": "caregiver_command", "command": "stop", "ts": at(6)},
        {"connection_id": "a", "type": "unknown", "ts": at(7)},
        {"connection_id": "b", "type": "disconnect", "ts": at(8)},
        {"connection_id": "b", "type": "ping", "ts": at(9)},
    ])
    replies = run(spark, source, tmp_path, "replies")
    rows = [(r["connection_id"], r["type"], r["session_id"]) for r in replies.orderBy("ts").collect()]
    assert rows == [
        ("a", "session_initialized", "s1"), ("a", "pong", "s1"), ("b", "session_initialized", "s1"),
        ("a", "response_update", "s1"), ("a", "session_command", "s1"), ("b", "disconnected", "s1"),
    ]
    assert replies.where("type = 'response_update'").first()["score"] == 0.0
    assert [tuple(r) for r in M.members(replies).collect()] == [("s1", "a")]
    sent = M.fan_out(replies, M.members(replies.where("type <> 'disconnected'")))
    assert sorted(r["recipient"] for r in sent.where("type = 'response_update'").collect()) == ["a", "b"]
    assert [r["recipient"] for r in sent.where("type = 'pong'").collect()] == ["a"]


def test_odd_messages(spark, tmp_path):
    """No time, no session name, a message at the time of its handshake, joining again; as a stream and as a table."""
    source = tmp_path / "in"
    source.mkdir()
    at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    rows = [
        {"connection_id": "a", "type": "child_response", "item_id": "i", "ts": at(1)}, {"connection_id": "a", "type": "initialize_session", "ts": at(1)},
        {"connection_id": "a", "type": "initialize_session", "session_id": "other", "ts": at(2)}, {"connection_id": "a", "type": "disconnect", "ts": at(2)},
        {"connection_id": "a", "type": "ping", "ts": at(3)}, {"connection_id": "a", "type": "initialize_session", "session_id": "s2", "ts": at(4)},
        {"connection_id": "b", "type": "initialize_session"}, {"connection_id": "b", "type": "ping"}, {"connection_id": "c", "type": None, "ts": at(5)},
        {"connection_id": "c", "type": "disconnect", "ts": at(6)},
    ]
    send(source, "1.json", rows)
    replies = run(spark, source, tmp_path, "odd")
    from lorikeet.schemas import SCHEMAS

    table = M.route_table(spark.read.schema(SCHEMAS["messages"]).json(str(source)))
    assert sorted(map(repr, replies.collect())) == sorted(map(repr, table.select(*replies.columns).collect()))
    assert {(r["connection_id"], r["type"], r["session_id"]) for r in table.collect()} == {
        ("a", "session_initialized", "a-20240101000001"), ("a", "response_update", "a-20240101000001"), ("a", "disconnected", "a-20240101000001"),
        ("a", "session_initialized", "s2"), ("b", "session_initialized", "b-unknown"), ("b", "pong", "b-unknown"),
    }
    assert {tuple(r) for r in M.members(table).collect()} == {("s2", "a"), ("b-unknown", "b")}
    replies = M.route(M.read_messages(spark, str(source)), None)
    assert M.write_messages(replies, str(tmp_path / "out"), str(tmp_path / "sink"), availableNow=True).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).groupBy("scope").count().where("scope <> 'none'").count() == 2


def test_triggers_routed_as_tables(spark, tmp_path, monkeypatch):
    """Any cut into triggers, with a failure between the replies and the table of sessions."""
    import random

    from lorikeet.schemas import SCHEMAS
    from lorikeet.sources.keyed import KeyedTable

    rng, rows = random.Random(3), []
    kinds = ["initialize_session"] * 2 + ["child_response"] * 4 + ["caregiver_command", "ping", "disconnect", "other"]
    for t in range(120):
        rows.append({"connection_id": rng.choice("aaaabc"), "type": rng.choice(kinds), "session_id": rng.choice(["s", "t", None]), "item_id": f"i{t}", "ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"})
    source = tmp_path / "in"
    source.mkdir()

    def serve():
        stream = M.read_messages(spark, str(source), 1)
        q = M.serve_messages(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4, availableNow=True)
        assert q.awaitTermination(300)

    for k, (lo, hi) in enumerate(((0, 50), (50, 51), (51, 120))):
        send(source, f"{k}.json", rows[lo:hi])
        if k == 2:
            with monkeypatch.context() as m:
                m.setattr(KeyedTable, "_commit", lambda self, manifest: 1 / 0)
                try:
                    serve()
                except Exception as e:  # noqa: BLE001
                    assert "division" in str(e)
        serve()
    got = spark.read.parquet(str(tmp_path / "out" / "replies")).drop("trigger")
    want = M.route_table(spark.read.schema(SCHEMAS["messages"]).json(str(source)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and got.count() > 50


def test_silence_ends_a_session(spark, tmp_path):
    import time

    source = tmp_path / "in"
    source.mkdir()
    send(source, "1.json", [{"connection_id": "a", "type": "initialize_session", "session_id": "s", "ts": "2024-01-01T00:00:01Z"}])
    stream = M.route(M.read_messages(spark, str(source)), 1000).writeStream.format("memory").queryName("silent")
    q = stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            rows = [(r["type"], r["session_id"], r["scope"]) for r in spark.table("silent").collect()]
            if len(rows) == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert rows == [("session_initialized", "s", "personal"), ("disconnected", "s", "none")]


def test_event_rates_as_stream(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    source = tmp_path / "events"
    table.coalesce(1).write.parquet(str(source))
    stream = M.event_rates(spark.readStream.schema(table.schema).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n_events"]) for r in df.collect())
    assert key(spark.table("rates")) == key(M.event_rates(table))


def test_scoring_a_stream(spark, tmp_path):
    from lorikeet.operators.scoring import score_words

    source = tmp_path / "said"
    source.mkdir()
    send(source, "1.json", [{"expected": "rabbit", "actual": "wabbit"}, {"expected": "cat", "actual": "zzzzz"}])
    rows = spark.readStream.schema("expected string, actual string").json(str(source))
    q = score_words(rows).writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["expected"]: r["is_correct"] for r in spark.table("scores").collect()} == {"rabbit": True, "cat": False}
