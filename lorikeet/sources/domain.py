"""The domain tables, derived from the star-schema parquet that is at hand.

Each table is a lazy DataFrame; what a query doesn't use is pruned from the scan.
``VIEWS`` holds the same definitions as SQL, for checks against another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorikeet.operators.ranking import id_slice, numbered
from lorikeet.sources.tables import scan

#: The moment that "now" means: the day after the last session day.
AS_OF = "2001-08-02 00:00:00"


#: Phonemes of the words of item names.
PHONEMES = {
    "large": "L AA R JH", "small": "S M AO L", "red": "R EH D", "cold": "K OW L D", "hot": "HH AA T", "new": "N UW", "blue": "B L UW",
    "old": "OW L D", "gizmo": "G IH Z M OW", "ring": "R IH NG", "gear": "G IH R", "widget": "W IH JH IH T", "plate": "P L EY T",
    "bolt": "B OW L T", "rod": "R AA D", "anvil": "AE N V AH L",
}


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, table: str) -> DataFrame:
        return scan(self.spark, f"{self.sf_dir}/{table}.parquet", table)

    @cached_property
    def children(self) -> DataFrame:
        return self._read("customer").select(
            F.col("c_custkey").alias("child_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("caregiver_id")
        )

    @cached_property
    def caregivers(self) -> DataFrame:
        return self._read("nation").select(
            F.col("n_nationkey").alias("caregiver_id"), F.col("n_name").alias("username")
        )

    @cached_property
    def activity_categories(self) -> DataFrame:
        kinds = self._read("part").select(F.col("p_type").alias("name")).distinct()
        # a handful of rows: their numbering is one small task
        return kinds.select(
            (F.row_number().over(Window.orderBy("name")) - 1).alias("category_id"),
            "name",
            F.when(F.col("name").isin("ECONOMY", "SMALL"), "easy")
            .when(F.col("name").isin("STANDARD", "MEDIUM"), "medium")
            .otherwise("hard")
            .alias("difficulty_level"),
            F.when(F.col("name").isin("ECONOMY", "STANDARD", "PROMO"), "personalized").otherwise("generic").alias("type"),
        )

    @cached_property
    def activity_items(self) -> DataFrame:
        kinds = self.activity_categories.select("category_id", F.col("name").alias("p_type"))
        size = F.col("p_size")
        return self._read("part").join(kinds, "p_type").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("name"),
            "category_id",
            F.when(size <= 15, "easy").when(size <= 30, "medium").when(size <= 45, "hard").alias("difficulty_level"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("img/"), F.col("p_partkey"))).alias("image_url"),
            F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("audio/"), F.col("p_partkey"))).alias("audio_url"),
        )

    @cached_property
    def child_category(self) -> DataFrame:
        urgent = self._read("orders").where("o_orderpriority = '1-URGENT'")
        return urgent.select(
            F.col("o_custkey").alias("child_id"), (F.col("o_orderkey") % 6).cast("int").alias("category_id")
        ).distinct()

    @cached_property
    def therapy_sessions(self) -> DataFrame:
        start = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))")
        end = F.expr("start_time + make_dt_interval(0, 0, cast(10 + session_id % 50 as int))")
        return (
            self._read("orders")
            .select(
                F.col("o_orderkey").alias("session_id"),
                F.col("o_custkey").alias("child_id"),
                (F.col("o_orderkey") % 6).cast("int").alias("category_id"),
                start.alias("start_time"),
                F.col("o_orderstatus").alias("status"),
            )
            .select(
                "session_id",
                "child_id",
                "category_id",
                "start_time",
                F.when(F.col("status") != "P", end).alias("end_time"),
                F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("session_id") % 3 + 1).cast("int")).alias("current_level"),
                (F.col("status") == "F").alias("is_completed"),
            )
        )

    def _lines(self, lines: DataFrame, *more: str) -> DataFrame:
        return lines.select(
            F.col("l_orderkey").alias("session_id"),
            F.col("l_partkey").alias("item_id"),
            F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False).alias("is_correct"),
            F.when(F.col("l_linestatus") == "F", "verbal")
            .when(F.col("l_linenumber") == 1, "generic")
            .otherwise("nonverbal")
            .alias("response_type"),
            F.when(F.col("l_tax") != 0, F.col("l_discount") * 10).alias("pronunciation_score"),
            F.col("l_quantity").alias("response_time_seconds"),
            *more,
        )

    @cached_property
    def answers(self) -> DataFrame:
        """The attempts without their ids and times, which need an order among the
        lines of a session; for operators that count or sum. ``stored_at`` is the
        place of an attempt in the table's files, along which sums of doubles run."""
        lines = self._read("lineitem")
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return self._lines(lines.withColumn("stored_at", place), "stored_at")

    @cached_property
    def session_activities(self) -> DataFrame:
        lines = self._read("lineitem")
        each = Window.partitionBy("l_orderkey").orderBy(*lines.columns)
        rows = self._lines(lines.withColumn("seq", F.row_number().over(each)), "seq")
        starts = self.therapy_sessions.select("session_id", "start_time")
        return rows.join(starts, "session_id").select(
            (F.col("session_id") * 1000 + F.col("seq")).alias("activity_id"),
            *[c for c in rows.columns if c != "seq"],
            F.expr("start_time + make_dt_interval(0, 0, seq)").alias("created_at"),
        )

    @cached_property
    def caregiver_feedback(self) -> DataFrame:
        owners = self._read("orders").select(F.col("o_orderkey").alias("of_session"), F.col("o_custkey").alias("child_id"))
        events = self._read("events").withColumn("of_session", F.expr("event_id div 3"))
        return events.join(owners, "of_session").select(
            F.col("event_id").alias("feedback_id"),
            F.when(F.col("event_type") != "error", F.col("of_session")).alias("session_id"),
            "child_id",
            (F.col("event_id") % 5 + 1).cast("int").alias("rating"),
            F.col("event_type").alias("feedback_type"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def gaze_tracking(self) -> DataFrame:
        return self._read("events").select(
            F.col("event_id").alias("gaze_id"),
            F.expr("event_id div 3").alias("session_id"),
            F.col("user_id").alias("child_id"),
            (F.col("event_id") % 600 * 1000).alias("session_duration"),
            F.col("value").alias("on_screen_percentage"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Events as messages of a connection for each user: a handshake, what
        children and caregivers send, pings, and now and then a disconnect."""
        e, at = self._read("events"), F.col("event_id") % 11
        kind = F.when(at == 0, "disconnect").when(at.isin(1, 6), "initialize_session").when(at == 2, "caregiver_command").when(at.isin(3, 8), "ping").when(at == 4, "other")
        kind = kind.otherwise("child_response")
        of = lambda name, value: F.when(kind == name, value)
        return e.select(
            F.concat(F.lit("u"), F.col("user_id")).alias("connection_id"),
            kind.alias("type"),
            of("initialize_session", F.when(at == 1, F.concat(F.lit("s"), F.expr("event_id div 100")))).alias("session_id"),
            of("child_response", F.col("event_id").cast("string")).alias("item_id"),
            of("child_response", F.col("event_type")).alias("response"),
            of("child_response", F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("score"),
            of("caregiver_command", F.col("event_type")).alias("command"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def lexicon(self) -> DataFrame:
        """Phonemes of the words that item names are made of: a fixed small table."""
        return self.spark.createDataFrame([(w, p.split()) for w, p in PHONEMES.items()], "word string, phonemes array<string>")

    @cached_property
    def utterances(self) -> DataFrame:
        """Item names said as the name of the next item of the same category."""
        named = self.activity_items.select("category_id", "item_id", "name")
        placed = numbered(named, ["category_id"], id_slice("item_id"), ["item_id"])
        following = placed.select("category_id", (F.col("place") - 1).alias("place"), F.col("name").alias("actual"))
        return placed.join(following, ["category_id", "place"]).select("item_id", F.col("name").alias("expected"), "actual")

VIEWS = {
    "children": "SELECT c_custkey AS child_id, c_name AS name, c_nationkey AS caregiver_id FROM customer",
    "activity_categories": """
        SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS category_id, name,
               CASE WHEN name IN ('ECONOMY', 'SMALL') THEN 'easy' WHEN name IN ('STANDARD', 'MEDIUM') THEN 'medium'
                    ELSE 'hard' END AS difficulty_level,
               CASE WHEN name IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'personalized' ELSE 'generic' END AS type
        FROM (SELECT DISTINCT p_type AS name FROM part)""",
    "activity_items": """
        SELECT p_partkey AS item_id, p_name AS name, category_id,
               CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 45 THEN 'hard' END
                 AS difficulty_level,
               CASE WHEN p_partkey % 3 = 0 THEN 'img/' || p_partkey END AS image_url,
               CASE WHEN p_partkey % 2 = 0 THEN 'audio/' || p_partkey END AS audio_url
        FROM part JOIN activity_categories c ON p_type = c.name""",
    "child_category": """
        SELECT DISTINCT o_custkey AS child_id, CAST(o_orderkey % 6 AS INTEGER) AS category_id
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "therapy_sessions": """
        SELECT o_orderkey AS session_id, o_custkey AS child_id, CAST(o_orderkey % 6 AS INTEGER) AS category_id,
               o_orderdate + to_hours(o_orderkey % 24) AS start_time,
               CASE WHEN o_orderstatus <> 'P'
                    THEN o_orderdate + to_hours(o_orderkey % 24) + to_minutes(10 + o_orderkey % 50) END AS end_time,
               CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS current_level,
               o_orderstatus = 'F' AS is_completed
        FROM orders""",
    "session_activities": """
        SELECT l_orderkey * 1000 + seq AS activity_id, session_id, l_partkey AS item_id,
               CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false END AS is_correct,
               CASE WHEN l_linestatus = 'F' THEN 'verbal' WHEN l_linenumber = 1 THEN 'generic' ELSE 'nonverbal' END
                 AS response_type,
               CASE WHEN l_tax <> 0 THEN l_discount * 10 END AS pronunciation_score,
               l_quantity AS response_time_seconds, start_time + to_minutes(seq) AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey,
                l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
                AS seq FROM lineitem) l
        JOIN therapy_sessions ON l_orderkey = session_id""",
    "caregiver_feedback": """
        SELECT event_id AS feedback_id, CASE WHEN event_type <> 'error' THEN o_orderkey END AS session_id,
               o_custkey AS child_id, CAST(event_id % 5 + 1 AS INTEGER) AS rating, event_type AS feedback_type,
               ts AS created_at
        FROM events JOIN orders ON event_id // 3 = o_orderkey""",
    "utterances": """
        SELECT * FROM (SELECT item_id, name AS expected,
          lead(name) OVER (PARTITION BY category_id ORDER BY item_id) AS actual FROM activity_items)
        WHERE actual IS NOT NULL""",
    "child_performance": """
        SELECT child_id, category_id, va AS verbal_attempts, vs AS verbal_success, sa AS selection_attempts,
               ss AS selection_success,
               CASE WHEN va + sa = 0 THEN 0.0 ELSE (vs * CAST(0.7 AS DOUBLE) + ss * CAST(0.3 AS DOUBLE))
                 / (va * CAST(0.7 AS DOUBLE) + sa * CAST(0.3 AS DOUBLE)) END AS overall_score
        FROM (SELECT child_id, category_id,
                count(*) FILTER (WHERE response_type = 'verbal') AS va,
                count(*) FILTER (WHERE response_type = 'verbal' AND is_correct) AS vs,
                count(*) FILTER (WHERE response_type = 'nonverbal') AS sa,
                count(*) FILTER (WHERE response_type = 'nonverbal' AND is_correct) AS ss
              FROM session_activities JOIN therapy_sessions USING (session_id) GROUP BY ALL)""",
}


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the domain tables in front."""
    views = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items())
    return f"WITH {views}\n{sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH {views},\n{sql.lstrip()[4:]}"
