"""Live rooms: who is in a session at a time, and copies of its replies for them (D-03, D-05).

``messages.route`` says when a connection joins and leaves. A stay is the time
between; a reply to a session goes to those whose stay covers its time. For a
stream the stays are a table, brought up to date once a trigger: joins, leaves
and replies of a trigger are sorted and joined as tables, so a room of any size is
spread like any other join and nothing of a trigger is held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: What a time that isn't known counts as: after all others.
END_OF_TIME = "9999-12-31 00:00:00"
STAY = "session_id string, connection_id string, joined timestamp, left timestamp"


def _time(col: str | Column) -> Column:
    return F.coalesce(col, F.lit(END_OF_TIME).cast("timestamp"))


def stays(replies: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(session_id, connection_id, joined, left) by the joins and leaves among
    ``replies``, and by the stays ``before``; left is null while a stay is open.

    A leave ends the connection's stay; so does another join, which opens the next
    one. At one time a join comes before a leave. Leaves without a stay, and rows
    without a connection, do nothing; stays that had ended remain as they were.
    """
    kinds = F.when(F.col("type") == "session_initialized", 0).when(F.col("type") == "disconnected", 1)
    marks = replies.select("connection_id", "session_id", _time("ts").alias("at"), kinds.alias("kind"))
    marks = marks.where("kind IS NOT NULL AND connection_id IS NOT NULL")
    if before is not None:
        opened = before.where("left IS NULL")
        marks = marks.unionByName(opened.select("connection_id", "session_id", F.col("joined").alias("at"), F.lit(0).alias("kind")))
    along = Window.partitionBy("connection_id").orderBy("at", "kind", F.asc_nulls_last("session_id"))
    found = marks.withColumn("left", F.lead("at").over(along)).where("kind = 0")
    found = found.select("session_id", "connection_id", F.col("at").alias("joined"), "left")
    return found if before is None else found.unionByName(before.where("left IS NOT NULL"))


def fan_out_at(replies: DataFrame, known: DataFrame) -> DataFrame:
    """D-05: a copy of each session reply for everyone whose stay covers its time,
    both ends included, the sender among them; personal replies go to their
    connection. A connection that was there twice gets one copy. ``replies`` may
    hold equal rows: each is copied."""
    cols = replies.columns
    sent = replies.where("scope = 'session'").withColumn("__reply", F.monotonically_increasing_id())
    to = known.select(F.col("session_id").alias("__session"), F.col("connection_id").alias("recipient"), "joined", "left")
    inside = (F.col("session_id") == F.col("__session")) & (F.col("joined") <= _time("ts")) & (_time("ts") <= _time("left"))
    copies = sent.join(to, inside).dropDuplicates(["__reply", "recipient"]).select("recipient", *cols)
    return copies.unionByName(replies.where("scope = 'personal'").select(F.col("connection_id").alias("recipient"), *cols))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def serve_rooms(replies: DataFrame, path: str, checkpoint: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    """A stream of ``replies`` (as of ``messages.route``) fanned out to the members
    of their sessions: ``path``/sent holds the copies, ``path``/stays the stays.

    A trigger reads the stays of the trigger before and writes its own copies and
    stays under its number; run again after a failure it overwrites just these, so
    nothing is sent twice or lost. Stays that ended longer than ``late`` before
    the newest reply are dropped; a reply that comes later finds those still there.
    The copies are those of ``fan_out_at`` over the whole table, if joins and
    leaves don't come later than replies that they concern.
    """

    def serve(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stays_of = lambda k: f"{path}/stays/{k}"
        batch = batch.persist()
        try:
            earlier = stays_of(number - 1)
            before = spark.read.schema(STAY).parquet(earlier) if _exists(spark, earlier) else None
            known = stays(batch, before)
            newest = batch.agg(F.max("ts").alias("newest"))
            ended = F.col("left") < F.col("newest") - F.expr(f"INTERVAL {late}")
            # one row beside all stays: the newest time
            kept = known.join(F.broadcast(newest)).where(~F.coalesce(ended, F.lit(False))).drop("newest")
            kept.write.mode("overwrite").parquet(stays_of(number))
            # a stay that is dropped now may still cover replies of this trigger
            fan_out_at(batch, known).write.mode("overwrite").parquet(f"{path}/sent/trigger={number}")
            _delete(spark, stays_of(number - 2))
        finally:
            batch.unpersist()

    out = replies.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()


def present(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, connection_id) of the connections that are in a session after the last trigger."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stays")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    last = max(int(f.getPath().getName()) for f in found)
    return spark.read.schema(STAY).parquet(f"{path}/stays/{last}").where("left IS NULL").select("session_id", "connection_id")
