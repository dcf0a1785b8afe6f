"""Roll-ups of attempts: by child and category, by item, as feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.functions.sums import exact_avg

VERBAL, NONVERBAL = "verbal", "nonverbal"
#: Weights of spoken and of selected answers in a score.
VERBAL_WEIGHT, SELECTION_WEIGHT = 0.7, 0.3


def modality_counts() -> list[Column]:
    """Attempts and successes by modality; other response types count in neither,
    and an unknown answer is not a success."""
    verbal, chosen = F.col("response_type") == VERBAL, F.col("response_type") == NONVERBAL
    return [
        F.count_if(verbal).alias("verbal_attempts"),
        F.count_if(verbal & F.col("is_correct")).alias("verbal_success"),
        F.count_if(chosen).alias("selection_attempts"),
        F.count_if(chosen & F.col("is_correct")).alias("selection_success"),
    ]


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def overall_score() -> Column:
    good = F.col("verbal_success") * VERBAL_WEIGHT + F.col("selection_success") * SELECTION_WEIGHT
    tried = F.col("verbal_attempts") * VERBAL_WEIGHT + F.col("selection_attempts") * SELECTION_WEIGHT
    return F.when(F.col("verbal_attempts") + F.col("selection_attempts") == 0, 0.0).otherwise(good / F.nullif(tried, F.lit(0.0)))


def performance_rollup(activities: DataFrame, sessions: DataFrame) -> DataFrame:
    """A-05, A-06: one row for each child and session category, null included."""
    facts = activities.select("session_id", "response_type", "is_correct").join(
        sessions.select("session_id", "child_id", "category_id"), "session_id"
    )
    counted = facts.groupBy("child_id", "category_id").agg(*modality_counts())
    return counted.withColumn("overall_score", overall_score())


def item_performance(activities: DataFrame, sessions: DataFrame) -> DataFrame:
    """A-07: success by child and item, over all attempts of any type."""
    facts = activities.select("session_id", "item_id", "response_type", "is_correct").join(
        sessions.select("session_id", "child_id"), "session_id"
    )
    counted = facts.groupBy("child_id", "item_id").agg(*modality_counts(), F.count("*").alias("total_attempts"))
    return counted.withColumn(
        "success_rate", (F.col("verbal_success") + F.col("selection_success")) / F.col("total_attempts")
    )


def attempt_counts(activities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts by child, session category and item, from which both roll-ups follow."""
    facts = activities.select("session_id", "item_id", "response_type", "is_correct").join(
        sessions.select("session_id", "child_id", "category_id"), "session_id"
    )
    return facts.groupBy("child_id", "category_id", "item_id").agg(*modality_counts(), F.count("*").alias("total_attempts"))


def rollups_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``performance_rollup`` and ``item_performance`` give, from ``attempt_counts``."""
    sums = [F.sum(c).alias(c) for c in ("verbal_attempts", "verbal_success", "selection_attempts", "selection_success")]
    rollup = counts.groupBy("child_id", "category_id").agg(*sums).withColumn("overall_score", overall_score())
    by_item = counts.groupBy("child_id", "item_id").agg(*sums, F.sum("total_attempts").alias("total_attempts"))
    rate = (F.col("verbal_success") + F.col("selection_success")) / F.col("total_attempts")
    return rollup, by_item.withColumn("success_rate", rate)


def skill_vector(children: DataFrame, performance: DataFrame) -> DataFrame:
    """A-08: six numbers for every child, zeros for one without a roll-up."""
    sums = performance.groupBy("child_id").agg(
        *[F.sum(c).alias(c) for c in ("verbal_attempts", "verbal_success", "selection_attempts", "selection_success")],
        exact_avg("overall_score").alias("avg_score"),
        F.countDistinct("category_id").alias("n_categories"),
    )
    zero = F.lit(0)
    return children.select("child_id").join(sums, "child_id", "left").select(
        "child_id",
        F.coalesce("verbal_attempts", zero).alias("verbal_attempts"),
        F.coalesce("selection_attempts", zero).alias("selection_attempts"),
        safe_ratio("verbal_success", "verbal_attempts").alias("verbal_rate"),
        safe_ratio("selection_success", "selection_attempts").alias("selection_rate"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.coalesce("n_categories", zero).alias("n_categories"),
    )


def session_minutes(end: str = "end_time", start: str = "start_time") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end}) / 60000000.0D")


def average_session_minutes(sessions: DataFrame) -> DataFrame:
    """A-16: mean length of the finished sessions of a child."""
    done = sessions.where("end_time IS NOT NULL")
    return done.groupBy("child_id").agg(exact_avg(session_minutes()).alias("avg_minutes"))


def difficulty_rank(col: str = "difficulty_level", other: int = 4) -> Column:
    """P-15: easy, medium, hard as 1, 2, 3; anything else as ``other``."""
    c = F.col(col)
    return F.when(c == "easy", 1).when(c == "medium", 2).when(c == "hard", 3).otherwise(other)


def average_difficulty(sessions: DataFrame, categories: DataFrame) -> DataFrame:
    """A-17: mean rank of the distinct categories of a child's sessions."""
    tried = sessions.select("child_id", "category_id").distinct()
    ranks = categories.select("category_id", difficulty_rank(other=1).alias("rank"))
    return tried.join(ranks, "category_id").groupBy("child_id").agg(F.avg("rank").alias("category_difficulty"))


def ml_features(children: DataFrame, performance: DataFrame, sessions: DataFrame, categories: DataFrame) -> DataFrame:
    """A-18, C-18: the classifier's six features and the confidence of a child."""
    vector = skill_vector(children, performance)
    return (
        vector.join(average_difficulty(sessions, categories), "child_id", "left")
        .join(average_session_minutes(sessions), "child_id", "left")
        .select(
            "child_id",
            F.col("verbal_rate").alias("verbal_accuracy"),
            F.col("selection_rate").alias("selection_accuracy"),
            F.coalesce("category_difficulty", F.lit(1.0)).alias("category_difficulty"),
            F.coalesce("avg_minutes", F.lit(0.0)).alias("time_spent"),
            F.col("avg_score").alias("success_rate"),
            (F.col("verbal_attempts") + F.col("selection_attempts")).alias("previous_attempts"),
            (F.col("verbal_rate") * 0.6 + F.col("selection_rate") * 0.4).alias("confidence_score"),
        )
    )


def child_profile(children: DataFrame, performance: DataFrame) -> DataFrame:
    """A-25: strengths, challenges, recommended level, preferred modality.

    The modality is known only when both were seen, and is verbal only if that
    rate is strictly better; attempts in any category count.
    """
    score = F.col("overall_score")
    grouped = performance.groupBy("child_id").agg(
        F.array_sort(F.collect_list(F.when(score >= 0.7, F.col("category_id")))).alias("strengths"),
        F.array_sort(F.collect_list(F.when(score <= 0.3, F.col("category_id")))).alias("challenges"),
        exact_avg("overall_score").alias("avg_score"),
        *[F.sum(c).alias(c) for c in ("verbal_attempts", "verbal_success", "selection_attempts", "selection_success")],
    )
    mean = F.coalesce("avg_score", F.lit(0.0))
    both = (F.col("verbal_attempts") > 0) & (F.col("selection_attempts") > 0)
    verbal = F.try_divide("verbal_success", "verbal_attempts") > F.try_divide("selection_success", "selection_attempts")
    empty = F.array().cast("array<int>")
    return children.select("child_id").join(grouped, "child_id", "left").select(
        "child_id",
        F.coalesce("strengths", empty).alias("strengths"),
        F.coalesce("challenges", empty).alias("challenges"),
        mean.alias("avg_score"),
        F.when(mean > 0.75, "hard").when(mean > 0.5, "medium").otherwise("easy").alias("recommended_level"),
        F.when(both, F.when(verbal, VERBAL).otherwise(NONVERBAL)).alias("preferred_modality"),
    )
