"""Sessions: overview, history, feedback, attempt numbers, rates so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.operators.performance import safe_ratio, session_minutes


def newest(df: DataFrame, key: str, at: str, tie: str, n: int) -> DataFrame:
    """T-02: the ``n`` newest rows of each key, ties by the larger ``tie``."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_feedback(feedback: DataFrame) -> DataFrame:
    """J-09: of each session the first feedback by time, then id. The reference
    order is arbitrary; a session has few rows, so they are reduced, not sorted."""
    pick = F.min_by(F.struct("feedback_id", "rating", "feedback_type", "created_at"), F.struct("created_at", "feedback_id"))
    return feedback.where("session_id IS NOT NULL").groupBy("session_id").agg(pick.alias("f")).select("session_id", "f.*")


def session_totals(activities: DataFrame) -> DataFrame:
    """Counts of each session that has attempts (A-14): unknown answers are wrong."""
    return activities.groupBy("session_id").agg(
        F.count("*").alias("total_activities"), F.count_if("is_correct").alias("correct_answers")
    )


def session_overview(
    sessions: DataFrame, activities: DataFrame, items: DataFrame, children: DataFrame, categories: DataFrame
) -> DataFrame:
    """A-10, A-11, A-13: one row for every session, also without attempts.

    The mean response time leaves out unknown and zero times. An item may be both
    a strength and a weakness; names are distinct and sorted. advice is the level
    of the accuracy: basics (under 50), practice (under 75), ready.
    """
    named = activities.join(items.select("item_id", F.col("name").alias("item_name")), "item_id", "left")
    good = F.coalesce("is_correct", F.lit(False))
    facts = named.groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("correct"),
        F.avg(F.nullif("response_time_seconds", F.lit(0.0))).alias("response"),
        F.array_sort(F.collect_set(F.when(good, F.col("item_name")))).alias("strong"),
        F.array_sort(F.collect_set(F.when(~good, F.col("item_name")))).alias("weak"),
    )
    zero, none = F.lit(0), F.array().cast("array<string>")
    accuracy = safe_ratio("correct", "total") * 100
    return (
        sessions.join(facts, "session_id", "left")
        .join(children.select("child_id", F.col("name").alias("child_name")), "child_id", "left")
        .join(categories.select("category_id", F.col("name").alias("category_name")), "category_id", "left")
        .select(
            "session_id",
            "child_name",
            "category_name",
            "start_time",
            F.coalesce(session_minutes(), F.lit(0.0)).alias("duration_minutes"),
            F.coalesce("total", zero).alias("total_activities"),
            F.coalesce("correct", zero).alias("correct_answers"),
            accuracy.alias("accuracy_percentage"),
            F.coalesce("response", F.lit(0.0)).alias("average_response_time"),
            F.coalesce("strong", none).alias("strengths"),
            F.coalesce("weak", none).alias("areas_for_improvement"),
            F.when(accuracy < 50, "basics").when(accuracy < 75, "practice").otherwise("ready").alias("advice"),
            F.coalesce(F.size("weak") > 3, F.lit(False)).alias("few_at_a_time"),
        )
    )


def session_history(
    sessions: DataFrame, activities: DataFrame, feedback: DataFrame, categories: DataFrame, limit: int = 10
) -> DataFrame:
    """C-21: the newest sessions of each child with score and first feedback. The
    window is cut before the joins, so only what is listed is joined."""
    recent = newest(sessions, "child_id", "start_time", "session_id", limit)
    return (
        recent.join(session_totals(activities), "session_id", "left")
        .join(first_feedback(feedback).drop("created_at"), "session_id", "left")
        .join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left")
        .select(
            "child_id",
            "rank",
            "session_id",
            F.to_date("start_time").alias("date"),
            "category",
            session_minutes().alias("duration_minutes"),
            safe_ratio("correct_answers", "total_activities").alias("score"),
            F.col("rating").alias("feedback_rating"),
            "feedback_type",
        )
    )


def performance_details(performance: DataFrame, categories: DataFrame) -> DataFrame:
    """A-15: accuracy by modality; a category that isn't known is General."""
    named = performance.join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left")
    return named.select(
        "child_id",
        F.coalesce("category", F.lit("General")).alias("category"),
        "overall_score",
        safe_ratio("verbal_success", "verbal_attempts").alias("verbal_accuracy"),
        safe_ratio("selection_success", "selection_attempts").alias("selection_accuracy"),
    )


def feedback_history(feedback: DataFrame, sessions: DataFrame, categories: DataFrame, limit: int = 5) -> DataFrame:
    """C-25: the newest feedback of each child with the category of its session."""
    recent = newest(feedback, "child_id", "created_at", "feedback_id", limit)
    of = sessions.select("session_id", "category_id").join(
        categories.select("category_id", F.col("name").alias("category")), "category_id", "left"
    )
    return recent.join(of.drop("category_id"), "session_id", "left").select(
        "child_id", "rank", "feedback_id", "session_id", "rating", "feedback_type", "created_at", "category"
    )


def attempt_numbers(activities: DataFrame) -> DataFrame:
    """A-28: attempts of an item in a session, numbered by time, then id."""
    order = Window.partitionBy("session_id", "item_id").orderBy("created_at", "activity_id")
    return activities.select("activity_id", "session_id", "item_id", F.row_number().over(order).alias("attempt_number"))


def success_so_far(activities: DataFrame) -> DataFrame:
    """A-24: share of correct answers among the known ones of a session."""
    return activities.groupBy("session_id").agg(F.avg(F.col("is_correct").cast("int")).alias("success_rate"))


def recent_rate(activities: DataFrame, n: int = 5) -> DataFrame:
    """A-23: share of correct answers among the newest ``n`` of a session."""
    last = newest(activities, "session_id", "created_at", "activity_id", n)
    return last.groupBy("session_id").agg(
        (F.count_if("is_correct") / F.count("*")).alias("recent_rate"), F.count("*").alias("n_recent")
    )


def placeholder_audio(name: Column, base: str = "audio/") -> Column:
    """S-17: the address of a recording that is still to be made."""
    return F.concat(F.lit(base), F.lower(name), F.lit(".mp3"))
