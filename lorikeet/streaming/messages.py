"""Session messages as a stream (engine D).

A connection's messages are dropped until it sends initialize_session; after
that each is routed by type. State is one short string for each connection, in
Spark's state store, so it survives a restart and spreads over executors; it goes
when the connection leaves or is silent for an hour. ``route_table`` gives the
same replies for a table of messages, by windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorikeet.schemas import SCHEMAS
from lorikeet.sources.keyed import KeyedTable

OUT = (
    "connection_id string, session_id string, type string, scope string, item_id string, response string,"
    " score double, command string, ts timestamp"
)
_NAMES = [f.strip().split()[0] for f in OUT.split(",")]
#: Silence after which a connection counts as gone.
SILENCE_MS = 3_600_000
#: What each message becomes, and who gets it: its session, the connection alone, or nobody.
REPLIES = {
    "child_response": ("response_update", "session"),
    "caregiver_command": ("session_command", "session"),
    "ping": ("pong", "personal"),
    "initialize_session": ("session_initialized", "personal"),
    "disconnect": ("disconnected", "none"),
}


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """S-14: JSON messages from a folder, with the fixed schema."""
    return spark.readStream.schema(SCHEMAS["messages"]).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_messages(replies: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """S-14: the sink: replies that go to somebody as JSON files, one folder for
    each scope, from which the transport takes them. ``trigger`` as in Spark, a
    batch each second by default."""
    out = replies.where("scope <> 'none'").writeStream.format("json").partitionBy("scope")
    out = out.option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _session_name(given: str | None, connection: str, ts: pd.Timestamp) -> str:
    return given or f"{connection}-{'unknown' if pd.isna(ts) else f'{ts:%Y%m%d%H%M%S}'}"


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows in the columns of OUT, with types that don't depend on what there is."""
    out = pd.DataFrame(rows, columns=_NAMES, dtype=object)
    return out.assign(score=pd.to_numeric(out["score"]).astype("float64"), ts=pd.to_datetime(out["ts"]))


def _route(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, silence_ms: int | None) -> Iterator[pd.DataFrame]:
    session = state.get[0] if state.exists else None
    if state.hasTimedOut:
        state.remove()
        now = pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
        yield _frame([{"connection_id": key[0], "session_id": session, "type": "disconnected", "scope": "none", "ts": now}])
        return
    rows = []
    whole = pd.concat(list(batches), ignore_index=True)
    # messages of one trigger in time order; at one time a handshake comes first and a disconnect last, others by what they say, so reruns agree
    whole["__rank"] = whole["type"].map({"initialize_session": 0, "disconnect": 2}).fillna(1)
    order = ["ts", "__rank", "type", "session_id", "item_id", "command"]
    for m in whole.sort_values(order, kind="stable").itertuples(index=False):
        if (session is None) != (m.type == "initialize_session") or m.type not in REPLIES:
            continue
        kind, scope = REPLIES[m.type]
        if m.type == "initialize_session":
            session = _session_name(m.session_id, key[0], m.ts)
        row = {"connection_id": key[0], "ts": m.ts, "session_id": session, "type": kind, "scope": scope}
        if m.type == "child_response":
            score = 0.0 if m.score is None or m.score != m.score else float(m.score)
            row |= {"item_id": m.item_id, "response": m.response, "score": score}
        elif m.type == "caregiver_command":
            row |= {"command": m.command}
        elif m.type == "disconnect":  # D-07: what was known of the connection goes
            session = None
        rows.append(row)
    if session is None:
        if state.exists:
            state.remove()
    else:
        state.update((session,))
        if silence_ms:
            state.setTimeoutDuration(silence_ms)
    yield _frame(rows)


def route(messages: DataFrame, silence_ms: int | None = SILENCE_MS) -> DataFrame:
    """D-01, D-02, D-04, D-06, D-07: replies to a stream of messages. scope tells
    whether a reply goes to its connection, to all of its session or, for the
    mark that a connection has left, to nobody. The messages that a connection
    sends within a trigger are put in order in memory; a null type is dropped, a
    null time comes last. A connection that is silent for ``silence_ms`` counts as
    gone; None waits for ever, which a query that is to end by itself
    (``availableNow``) needs, since Spark runs on to watch the time."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout

    def routed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _route(key, batches, state, silence_ms)

    return messages.groupBy("connection_id").applyInPandasWithState(routed, OUT, "session_id string", "append", timeout)


def route_table(messages: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """The replies to a table of messages, as ``route`` gives them for a stream that
    brings the messages in order. Disconnects cut a connection's messages into
    stretches; the first handshake of a stretch opens its session. ``opened``
    (connection_id, session_id): the sessions that were open before."""
    messages = messages.withColumn("__carried", F.lit(False))
    if opened is not None:
        known = opened.select("connection_id", "session_id", F.lit("initialize_session").alias("type"), F.lit(True).alias("__carried"))
        known = known.join(messages.select("connection_id").distinct(), "connection_id", "left_semi")
        messages = messages.unionByName(known, allowMissingColumns=True)
    rank = F.when(F.col("type") == "initialize_session", 0).when(F.col("type") == "disconnect", 2).otherwise(1)
    ties = [F.asc_nulls_last(c) for c in ("session_id", "item_id", "command")]
    order = [F.desc("__carried"), F.asc_nulls_last("ts"), rank, F.asc("type"), *ties]
    along = Window.partitionBy("connection_id").orderBy(*order)
    ends = F.count_if(F.col("type") == "disconnect").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.where(F.col("type").isin(*REPLIES)).withColumn("__at", F.row_number().over(along)).withColumn("__part", ends)
    stretch = Window.partitionBy("connection_id", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    made = F.concat("connection_id", F.lit("-"), F.coalesce(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("unknown")))
    given = F.coalesce(F.nullif("session_id", F.lit("")), made)
    opening = F.col("type") == "initialize_session"
    opened = F.first(F.when(opening, F.struct(given.alias("session"), F.col("__at").alias("at"))), ignorenulls=True).over(stretch)
    rows = rows.withColumn("__opened", opened).where(
        F.col("__opened").isNotNull() & (~opening | (F.col("__opened.at") == F.col("__at")))
    )
    rows = rows.where(~F.col("__carried"))
    table = F.create_map(*[x for k, (kind, scope) in REPLIES.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(scope).alias("scope")))])
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    return rows.select(
        "connection_id", F.col("__opened.session").alias("session_id"), table[F.col("type")]["kind"].alias("type"),
        table[F.col("type")]["scope"].alias("scope"), of("child_response", F.col("item_id")).alias("item_id"),
        of("child_response", F.col("response")).alias("response"),
        of("child_response", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))).alias("score"),
        of("caregiver_command", F.col("command")).alias("command"), "ts",
    )


def serve_messages(messages: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """D-01, D-02, D-04, D-06, D-07 for connections of any size: each trigger is
    routed as a table, so its messages are sorted by Spark and held by no worker.

    ``path``/replies holds the replies, a folder a trigger, ``path``/open the
    sessions that are open. Replies are written before the table of open sessions
    names the trigger as done, and a trigger that is done is not run again, so
    after a failure nothing is lost or answered twice. A silent connection stays
    open; ``route`` has a timeout.
    """
    table = KeyedTable(messages.sparkSession, f"{path}/open", "connection_id string, session_id string", ["connection_id"], buckets)

    def serve(batch: DataFrame, number: int) -> None:
        done = table.manifest()["last_batch"]
        if done is not None and number <= done:
            return
        at = f"{path}/replies/trigger={number}"
        route_table(batch, table.read()).write.mode("overwrite").parquet(at)
        marks = batch.sparkSession.read.parquet(at).where("type IN ('session_initialized', 'disconnected')")
        when = F.struct(F.col("ts").isNull().alias("late"), "ts", (F.col("type") == "disconnected").alias("left"))
        last = marks.groupBy("connection_id").agg(F.max_by(F.struct("type", "session_id"), when).alias("m"))

        def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
            open_ = changes.where("m.type = 'session_initialized'").select("connection_id", "m.session_id")
            return old.join(changes, "connection_id", "left_anti").unionByName(open_)

        table.change(last.where("connection_id IS NOT NULL"), merged, number)
        table.vacuum(2)

    out = messages.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()


def members(replies: DataFrame) -> DataFrame:
    """D-03, D-07: (session_id, connection_id) of the connections that are in a
    session by the replies so far: those that joined more often than they left, in
    the session that they joined last."""
    joined, left = (F.col("type") == kind for kind in ("session_initialized", "disconnected"))
    last: Column = F.max(F.when(joined, F.struct("ts", "session_id")))["session_id"]
    known = replies.groupBy("connection_id").agg(last.alias("session_id"), (F.count_if(joined) - F.count_if(left)).alias("n"))
    return known.where("n > 0").select("session_id", "connection_id")


def fan_out(replies: DataFrame, joined: DataFrame) -> DataFrame:
    """D-05: a copy of each session reply for every member, the sender included;
    personal replies go to their connection. Both sides are batches, as in
    ``foreachBatch``."""
    to = joined.select(F.col("session_id").alias("__session"), F.col("connection_id").alias("recipient"))
    to_all = replies.where("scope = 'session'").join(to, F.col("session_id") == F.col("__session")).drop("__session")
    personal = replies.where("scope = 'personal'").select(F.col("connection_id").alias("recipient"), *replies.columns)
    return to_all.select("recipient", *replies.columns).unionByName(personal)


def event_rates(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and mean values of events by type in event-time windows, with a
    watermark for late ones; the same plan serves a table and a stream."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("ts", late)
    return at.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), F.avg("value").alias("mean_value")
    ).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "mean_value")
