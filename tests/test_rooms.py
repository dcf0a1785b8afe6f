"""Live rooms as a stream and as a table."""

import json
import random

import pytest

from lorikeet.schemas import SCHEMAS
from lorikeet.streaming import messages as M
from lorikeet.streaming import rooms as L

at = lambda s: f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"


def send(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def message(t, c, kind, session=None, item=None):
    return {"connection_id": c, "type": kind, "session_id": session, "item_id": item, "ts": at(t)}


def serve(spark, source, base, **options):
    replies = M.route(M.read_messages(spark, str(source), 1), None)
    q = L.serve_rooms(replies, str(base / "rooms"), str(base / "checkpoint"), availableNow=True, **options)
    assert q.awaitTermination(300)
    return spark.read.parquet(str(base / "rooms" / "sent"))


def sent(df):
    return sorted((r["recipient"], r["type"], r["session_id"], r["item_id"] or "") for r in df.collect())


def test_joins_leaves_and_late_replies_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    join, say, leave = "initialize_session", "child_response", "disconnect"
    send(source, "1.json", [message(1, "a", join, "s"), message(2, "b", join, "s"), message(3, "a", say, item="i3"), message(4, "c", join, "other")])
    serve(spark, source, tmp_path)
    send(source, "2.json", [message(5, "a", say, item="i5"), message(6, "b", leave), message(7, "a", say, item="i7")])
    serve(spark, source, tmp_path)
    assert {tuple(r) for r in L.present(spark, str(tmp_path / "rooms")).collect()} == {("s", "a"), ("other", "c")}
    # a reply of the time before b left, and b again, in another room
    send(source, "3.json", [message(5, "a", say, item="late"), message(8, "b", join, "other"), message(9, "c", say, item="i9"), message(10, "a", "ping")])
    got = serve(spark, source, tmp_path)
    assert sent(got.where("type = 'response_update'")) == sorted(
        [(r, "response_update", "s", i) for r in "ab" for i in ("i3", "i5", "late")] + [("a", "response_update", "s", "i7")]
        + [(r, "response_update", "other", "i9") for r in "bc"]
    )
    assert sent(got.where("type = 'pong'")) == [("a", "pong", "s", "")]
    assert {tuple(r) for r in L.present(spark, str(tmp_path / "rooms")).collect()} == {("s", "a"), ("other", "c"), ("other", "b")}


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_and_table_agree(spark, tmp_path, cuts):
    draw, rows = random.Random(cuts), []
    kinds = ["initialize_session"] * 3 + ["child_response"] * 6 + ["caregiver_command", "ping", "disconnect", "disconnect", "other"]
    for t in range(240):
        rows.append(message(t // 2, draw.choice("abcdef"), draw.choice(kinds), draw.choice(["s", "t", None]), f"i{t}"))
    rows.append({"connection_id": "a", "type": "child_response", "item_id": "no time"})
    source, size = tmp_path / "in", -(-len(rows) // cuts)
    # a cut between two messages of one time would come in another order than the table's
    for k in range(cuts):
        lo, hi = k * size - k * size % 2, min(len(rows), (k + 1) * size - (k + 1) * size % 2 if k < cuts - 1 else len(rows))
        send(source, f"{k}.json", rows[lo:hi])
        got = serve(spark, source, tmp_path)
    table = M.route_table(spark.read.schema(SCHEMAS["messages"]).json(str(source)))
    want = L.fan_out_at(table, L.stays(table))
    assert sent(got) == sent(want) and len(sent(got)) > 50


def test_a_trigger_that_is_run_again_overwrites_itself(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    send(source, "1.json", [message(1, "a", "initialize_session", "s"), message(2, "a", "child_response", item="i")])
    whole, broken = L.fan_out_at, [True]

    def fails_once(replies, known):
        if broken.pop() if broken else False:
            raise RuntimeError("lost")
        return whole(replies, known)

    monkeypatch.setattr(L, "fan_out_at", fails_once)
    with pytest.raises(Exception, match="lost"):
        serve(spark, source, tmp_path)
    got = serve(spark, source, tmp_path)
    assert sent(got.where("type = 'response_update'")) == [("a", "response_update", "s", "i")]


def test_old_stays_go(spark, tmp_path):
    source = tmp_path / "in"
    send(source, "1.json", [message(1, "a", "initialize_session", "s"), message(2, "a", "disconnect"), message(3, "b", "initialize_session", "s")])
    serve(spark, source, tmp_path, late="1 minute")
    send(source, "2.json", [message(4000, "b", "child_response", item="i")])
    serve(spark, source, tmp_path, late="1 minute")
    left = spark.read.parquet(str(tmp_path / "rooms" / "stays" / "1")).collect()
    assert [(r["connection_id"], r["left"]) for r in left] == [("b", None)]


def test_stays_of_a_table(spark):
    rows = [("a", "s", "session_initialized", "2024-01-01 00:00:01"), ("a", "t", "session_initialized", "2024-01-01 00:00:05"),
            ("b", None, "disconnected", "2024-01-01 00:00:01"), (None, "s", "session_initialized", "2024-01-01 00:00:02"),
            ("c", "s", "session_initialized", "2024-01-01 00:00:03"), ("c", "s", "disconnected", "2024-01-01 00:00:03")]
    replies = spark.createDataFrame(rows, "connection_id string, session_id string, type string, ts string").selectExpr("* except(ts)", "timestamp(ts) ts")
    got = {(r["connection_id"], r["session_id"], r["joined"].second, r["left"] and r["left"].second) for r in L.stays(replies).collect()}
    assert got == {("a", "s", 1, 5), ("a", "t", 5, None), ("c", "s", 3, 3)}
    assert L.stays(replies.limit(0)).count() == 0
