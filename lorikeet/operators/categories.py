"""Category statistics of every child (A-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.operators.ranking import put_to_each


def category_stats(
    children: DataFrame,
    categories: DataFrame,
    interests: DataFrame,
    items: DataFrame,
    activities: DataFrame,
    sessions: DataFrame,
    kind: str,
) -> DataFrame:
    """A row for every child and category of ``kind``: whether the child chose it,
    items, sessions with attempts, share correct in percent (null without an
    attempt), last attempt. The category is the item's, not the session's. Rows
    of one child in the order (display_priority, name).

    Attempts are aggregated by child and category before they meet the grid of
    children and categories, whose right side is a handful of rows.
    """
    wanted = categories.where(F.col("type") == kind).select("category_id", "name", "difficulty_level")
    counts = items.groupBy("category_id").agg(F.count("item_id").alias("item_count"))
    attempts = (
        activities.select("activity_id", "session_id", "item_id", "is_correct", "created_at")
        .join(items.select("item_id", "category_id"), "item_id")
        .join(wanted.select("category_id"), "category_id", "left_semi")
        .join(sessions.select("session_id", "child_id"), "session_id")
        .groupBy("child_id", "category_id")
        .agg(
            F.count("activity_id").alias("tried"),
            F.countDistinct("session_id").alias("total_attempts"),
            F.count_if("is_correct").alias("correct"),
            F.max("created_at").alias("last_attempt_date"),
        )
    )
    chosen = interests.select("child_id", "category_id").distinct().withColumn("chosen", F.lit(True))
    every = wanted.join(counts, "category_id", "left")
    grid = put_to_each(children.select("child_id"), every, "child_id")
    joined = grid.join(chosen, ["child_id", "category_id"], "left").join(attempts, ["child_id", "category_id"], "left")
    selected = F.coalesce("chosen", F.lit(False))
    return joined.select(
        "child_id",
        "category_id",
        "name",
        "difficulty_level",
        selected.alias("is_selected"),
        F.when(selected, 1).otherwise(2).alias("display_priority"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("total_attempts", F.lit(0)).alias("total_attempts"),
        (F.try_divide("correct", "tried") * 100).alias("latest_performance"),
        "last_attempt_date",
    )
