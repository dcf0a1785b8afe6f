"""Results that follow a stream of answers (A-05, A-08, A-23, A-28, B-31, C-15, C-16).

Each is a keyed table that a batch of new facts changes where its keys fall. The
number of the last batch stands in the table's manifest, written in one step with
the change, so a batch that runs again adds nothing twice. What is kept can be
merged: counts, the newest answers, the attempts of an item. Facts may come late
and in any order; after any split into batches the table is that of all facts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lorikeet.operators.performance import modality_counts, overall_score
from lorikeet.operators.recommend import adaptation
from lorikeet.operators.scoring import attempt_rows
from lorikeet.sources.keyed import DEAL, KeyedTable

COUNTS = ("verbal_attempts", "verbal_success", "selection_attempts", "selection_success")
ROLLUP = "child_id long, category_id int, " + ", ".join(f"{c} long" for c in COUNTS)
NEWEST = (
    "session_id long, activity_id long, item_id long, is_correct boolean, response_type string, response_text string,"
    " created_at timestamp_ntz"
)
ATTEMPTS = "attempt_id long, session_id long, item_id long, transcript string, ts timestamp_ntz"


class Rollup:
    """A-05: counts by child and category under ``path``; A-08 follows from them."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, ROLLUP, ["child_id", "category_id"], buckets)

    def add(self, answers: DataFrame, sessions: DataFrame, batch: int) -> int | None:
        """Fold in the facts of a batch; a fact belongs to one batch."""
        facts = answers.select("session_id", "response_type", "is_correct").join(
            sessions.select("session_id", "child_id", "category_id"), "session_id"
        )
        new = facts.groupBy("child_id", "category_id").agg(*modality_counts())

        def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
            sums = [F.sum(c).alias(c) for c in COUNTS]
            return old.unionByName(changes.select(*old.columns)).groupBy("child_id", "category_id").agg(*sums)

        return self.table.change(new, merged, batch)

    def read(self) -> DataFrame:
        """The rows of ``performance_rollup``, as of the last batch."""
        return self.table.read().withColumn("overall_score", overall_score())


class Adaptations:
    """C-15, C-16, A-23 while sessions run: of each session the newest answers by
    event time, ``n`` of them at most; a late answer takes its place among them."""

    #: What is kept of an answer.
    COLUMNS = tuple(c.split()[0] for c in NEWEST.split(", "))

    def __init__(self, spark, path: str, buckets: int = 64, n: int = 5):
        self.table, self.n = KeyedTable(spark, path, NEWEST, ["session_id"], buckets), n

    def add(self, answers: DataFrame, batch: int | None = None) -> int | None:
        """Take in ``answers``; those with an activity_id that their session has already
        are the same answer, of which the largest row counts. Old and new rows are
        shuffled once, and written where they were merged."""
        newest_first = Window.partitionBy(*DEAL, "session_id").orderBy(F.desc_nulls_last("created_at"), F.desc("activity_id"))

        def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
            rows = self.table.dealt(old.unionByName(changes.select(*old.columns)))
            rows = _once(rows, "activity_id", [*DEAL, "session_id"])
            return rows.withColumn("__n", F.row_number().over(newest_first)).where(F.col("__n") <= self.n).drop("__n")

        return self.table.change(answers.where("session_id IS NOT NULL").select(*self.COLUMNS), merged, batch, dealt=True)

    def read(self, items: DataFrame) -> DataFrame:
        """The rows of ``adaptation``, as of the last batch."""
        return adaptation(self.table.read(), items)


class Attempts:
    """A-28, B-31: attempts by session and item. A late attempt moves the numbers of
    those after it, so numbers follow from all attempts of the item."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, ATTEMPTS, ["session_id", "item_id"], buckets)

    def add(self, attempts: DataFrame, batch: int | None = None) -> int | None:
        """Take in ``attempts``; one attempt_id is one attempt, however often it comes."""

        def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
            return _once(old.unionByName(changes.select(*old.columns)), "attempt_id")

        return self.table.change(attempts, merged, batch)

    def read(self, items: DataFrame) -> DataFrame:
        """The rows of ``attempt_rows``, as of the last batch."""
        return attempt_rows(self.table.read(), items)


def _once(rows: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """One row for each ``key`` (of each ``within``), the largest; rows without one
    stay as they are."""
    by = [*within, key]
    rest = [c for c in rows.columns if c not in by]
    largest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in rest])
    return rows.withColumn("__once", F.row_number().over(largest)).where((F.col("__once") == 1) | F.col(key).isNull()).drop("__once")


def follow(stream: DataFrame, add: Callable[[DataFrame, int], object], table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``add(batch, number)`` for each trigger of a stream, and drop old versions.
    The query's checkpoint and the table belong together: numbers rise in both."""

    def each(batch: DataFrame, number: int) -> None:
        add(batch, number)
        table.vacuum(2)

    out = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": "1 second"})).start()
