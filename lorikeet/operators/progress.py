"""Progress: session scores, weekly trend, areas to improve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.functions.sums import exact_avg, exact_sum


def in_window(sessions: DataFrame, as_of: str, days: int) -> DataFrame:
    """P-04: sessions that start within the ``days`` up to ``as_of``, both included."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return sessions.where(F.col("start_time").between(now - F.expr(f"INTERVAL {int(days)} DAYS"), now))


def session_scores(sessions: DataFrame, activities: DataFrame) -> DataFrame:
    """A-12: sum of the known pronunciation scores over all attempts of a session;
    sessions without attempts have no row. Where attempts have a ``stored_at``
    scores are added along it, as a reader of the table adds them; else their sum
    is rounded once, so that either way it doesn't depend on how rows arrive."""
    score = F.coalesce("pronunciation_score", F.lit(0.0))
    if "stored_at" in activities.columns:
        along = Window.partitionBy("session_id").orderBy("stored_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = activities.select("session_id", "stored_at", F.sum(score).over(along).alias("so_far"))
        total = F.max_by("so_far", "stored_at")
    else:
        sums, total = activities.select("session_id", score.alias("score")), exact_sum("score")
    means = sums.groupBy("session_id").agg((total / F.count("*")).alias("score"))
    return sessions.join(means, "session_id").select("child_id", "session_id", "category_id", "start_time", "score")


def week_end(at: str | Column) -> Column:
    """The Sunday that ends the week of a time."""
    return F.next_day(F.date_sub(F.to_date(at), 1), "SU")


def progress_trend(children: DataFrame, sessions: DataFrame, activities: DataFrame, as_of: str, days: int) -> DataFrame:
    """C-23: slope of the weekly means, (last - first) / number of weeks between,
    empty ones included; one week is insufficient, no session no data."""
    scores = session_scores(in_window(sessions, as_of, days), activities)
    weekly = scores.groupBy("child_id", week_end("start_time").alias("week")).agg(exact_avg("score").alias("mean"))
    ends = weekly.groupBy("child_id").agg(
        F.min_by("mean", "week").alias("starting_score"),
        F.max_by("mean", "week").alias("current_score"),
        (F.datediff(F.max("week"), F.min("week")) / 7 + 1).cast("int").alias("n_weeks"),
    )
    slope = (F.col("current_score") - F.col("starting_score")) / F.col("n_weeks")
    many = F.col("n_weeks") > 1
    return children.select("child_id").join(ends, "child_id", "left").select(
        "child_id",
        F.coalesce("n_weeks", F.lit(0)).alias("n_weeks"),
        F.when(F.col("n_weeks").isNull(), "no data")
        .when(~many, "insufficient data")
        .when(slope > 0, "improving")
        .when(slope < 0, "declining")
        .otherwise("stable")
        .alias("trend"),
        F.when(many, F.abs(slope)).otherwise(0.0).alias("rate"),
        F.when(many, F.col("current_score")).alias("current_score"),
        F.when(many, F.col("starting_score")).alias("starting_score"),
    )


def improvement_areas(
    children: DataFrame, sessions: DataFrame, activities: DataFrame, categories: DataFrame,
    as_of: str, short_days: int = 7, long_days: int = 30, low: float = 0.6, top: int = 3,
) -> DataFrame:
    """C-24: the categories of most low sessions of the short window (ties by
    name) and the one with the lowest mean of the long window (ties by name)."""
    scores = session_scores(in_window(sessions, as_of, max(short_days, long_days)), activities).join(
        categories.select("category_id", F.col("name").alias("category")), "category_id"
    )
    recent = in_window(scores, as_of, short_days).where(F.col("score") < low)
    counts = recent.groupBy("child_id", "category").agg(F.count("*").alias("n"))
    order = Window.partitionBy("child_id").orderBy(F.desc("n"), "category")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    often = ranked.groupBy("child_id").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"])).alias(
            "recent_challenges"
        )
    )
    means = in_window(scores, as_of, long_days).groupBy("child_id", "category").agg(exact_avg("score").alias("mean"))
    lowest = means.groupBy("child_id").agg(F.min_by("category", F.struct("mean", "category")).alias("long_term_focus"))
    return children.select("child_id").join(often, "child_id", "left").join(lowest, "child_id", "left")
