"""Sums that don't depend on the order of rows."""

import math
import random

from pyspark.sql import functions as F

from lorikeet.functions.sums import exact_avg, exact_sum
from lorikeet.operators import performance as P
from lorikeet.operators import progress as G

AT = "2001-07-01 00:00:00"


def in_order(spark, rows, schema):
    """One partition, so rows are added as they stand."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_sums_are_rounded_once(spark):
    r = random.Random(5)
    kinds = [r.random, lambda: r.uniform(-5, 5), lambda: round(r.random(), 2) * 10, lambda: r.random() * 1e-4]
    groups = {g: [r.choice(kinds)() for _ in range(r.choice([1, 2, 3, 7, 50]))] for g in range(200)}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, x double")
    got = rows.groupBy("g").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).collect()
    assert {r["g"]: (r["s"], r["m"]) for r in got} == {g: (math.fsum(xs), math.fsum(xs) / len(xs)) for g, xs in groups.items()}


def test_nulls_large_values_and_values_that_are_not_finite(spark):
    of = lambda *xs: tuple(spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x"), exact_avg("x")).first())
    assert of(None) == (None, None)
    assert of(None, 0.5, 4096.0) == (4096.5, 2048.25)
    assert of(math.inf, 0.5)[0] == math.inf and math.isnan(of(math.nan, 0.5)[0])


def test_session_scores_in_any_order(spark):
    sessions = spark.createDataFrame([(1, 1, 0, AT)], "session_id int, child_id int, category_id int, at string")
    sessions = sessions.select("session_id", "child_id", "category_id", F.to_timestamp_ntz("at").alias("start_time"))
    scores = []
    for xs in ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1]):
        answers = in_order(spark, [(1, x) for x in xs], "session_id int, pronunciation_score double")
        scores.append(G.session_scores(sessions, answers).first()["score"])
    assert scores[0] == scores[1] == math.fsum([0.1, 0.2, 0.3]) / 3


def test_profiles_in_any_order(spark):
    """The level hangs on a mean of exactly a half."""
    children = spark.createDataFrame([(1,)], "child_id int")
    levels = set()
    for xs in ([0.1, 0.7, 0.7], [0.7, 0.7, 0.1]):
        rows = [(1, k, x, 1, 1, 1, 0) for k, x in enumerate(xs)]
        perf = in_order(
            spark, rows,
            "child_id int, category_id int, overall_score double, verbal_attempts long, verbal_success long, selection_attempts long, selection_success long",
        )
        levels.add((P.child_profile(children, perf).first()["avg_score"], P.skill_vector(children, perf).first()["avg_score"]))
    assert levels == {(math.fsum([0.1, 0.7, 0.7]) / 3,) * 2}


def test_session_scores_follow_the_stored_order(spark):
    """Along ``stored_at`` 0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1, however rows arrive."""
    sessions = spark.createDataFrame([(1, 1, 0, AT)], "session_id int, child_id int, category_id int, at string")
    sessions = sessions.select("session_id", "child_id", "category_id", F.to_timestamp_ntz("at").alias("start_time"))
    for xs in ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1]):
        rows = [(1, x, i) for i, x in enumerate(xs)]
        for arrived in (rows, rows[::-1]):
            answers = in_order(spark, arrived, "session_id int, pronunciation_score double, stored_at int")
            assert G.session_scores(sessions, answers).first()["score"] == (xs[0] + xs[1] + xs[2]) / 3
