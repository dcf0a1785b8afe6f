"""Edge cases on a small hand-made domain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorikeet.operators import classifier
from lorikeet.operators import performance as P
from lorikeet.operators import progress as G
from lorikeet.operators import recommend as R
from lorikeet.operators import sessions as S
from lorikeet.operators.similarity import similar_children
from lorikeet.sources import tables as W

T0 = dt.datetime(2024, 1, 1)
ACT = (
    "activity_id long, session_id long, item_id long, is_correct boolean, response_type string,"
    " pronunciation_score double, response_time_seconds double, created_at timestamp_ntz"
)
SES = (
    "session_id long, child_id long, category_id int, start_time timestamp_ntz, end_time timestamp_ntz,"
    " current_level string, is_completed boolean"
)


def session(sid, child, category, day=0, minutes=10, done=True, level="easy"):
    start = T0 + dt.timedelta(days=day)
    return (sid, child, category, start, start + dt.timedelta(minutes=minutes) if minutes else None, level, done)


def act(aid, sid, item=1, ok=True, kind="verbal", score=None, time=None):
    return (aid, sid, item, ok, kind, score, time, T0 + dt.timedelta(minutes=aid))


@pytest.fixture()
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_rollup(make):
    sessions = make([session(1, 1, 7), session(2, 2, None), session(3, 3, 7)], SES)
    acts = make(
        [act(1, 1), act(2, 1, ok=False), act(3, 1, kind="nonverbal"), act(4, 1, kind="nonverbal"),
         act(5, 2, kind="select"), act(6, 2, kind="generic"), act(7, 1, ok=None, kind="other")], ACT)
    got = {(r["child_id"], r["category_id"]): r for r in P.performance_rollup(acts, sessions).collect()}
    assert got[1, 7]["overall_score"] == pytest.approx(0.65)
    assert got[2, None]["overall_score"] == 0.0 and got[2, None]["verbal_attempts"] == 0
    assert set(got) == {(1, 7), (2, None)}
    items = {r["child_id"]: r for r in P.item_performance(acts, sessions).collect()}
    assert items[1]["total_attempts"] == 5 and items[1]["success_rate"] == pytest.approx(0.6)


def test_times_scores_and_rates(make):
    sessions = make([session(1, 1, 7), session(2, 1, 7, minutes=None, done=False)], SES)
    acts = make([act(1, 1, time=0.0, score=0.8), act(2, 1, ok=False), act(3, 1, ok=None, time=4.0), act(4, 1, time=6.0)], ACT)
    items = make([(1, "ball", 7, None)], "item_id long, name string, category_id int, difficulty_level string")
    children = make([(1, "A")], "child_id long, name string")
    cats = make([(7, "toys", "easy")], "category_id int, name string, difficulty_level string")
    got = {r["session_id"]: r for r in S.session_overview(sessions, acts, items, children, cats).collect()}
    assert got[1]["average_response_time"] == 5.0 and got[1]["accuracy_percentage"] == 50.0
    assert got[1]["strengths"] == got[1]["areas_for_improvement"] == ["ball"]
    assert got[2]["total_activities"] == 0 and got[2]["duration_minutes"] == 0.0 and got[2]["advice"] == "basics"
    assert G.session_scores(sessions, acts).first()["score"] == pytest.approx(0.2)
    assert S.success_so_far(acts).first()["success_rate"] == pytest.approx(2 / 3)
    assert [r["attempt_number"] for r in S.attempt_numbers(acts).orderBy("activity_id").collect()] == [1, 2, 3, 4]


def test_profile_and_path(make):
    perf = make([(1, 0, 0.9, 2, 2, 2, 1), (1, 1, 0.2, 0, 0, 0, 0)],
                "child_id long, category_id int, overall_score double, verbal_attempts long, verbal_success long, selection_attempts long, selection_success long")
    children = make([(1,), (2,)], "child_id long")
    got = {r["child_id"]: r for r in P.child_profile(children, perf).collect()}
    assert (got[1]["strengths"], got[1]["challenges"], got[1]["recommended_level"], got[1]["preferred_modality"]) == ([0], [1], "medium", "verbal")
    assert (got[2]["strengths"], got[2]["recommended_level"], got[2]["preferred_modality"]) == ([], "easy", None)
    cats = make([(0, "b", "hard"), (1, "a", "easy"), (2, "c", "medium"), (3, "d", "easy")], "category_id int, name string, difficulty_level string")
    path = R.learning_path(P.child_profile(children, perf), cats)
    rows = sorted((r["child_id"], r["priority"], r["category_id"], r["target_score"]) for r in path.collect())
    assert rows == [(1, 1, 0, 0.9), (1, 2, 2, 0.7), (1, 3, 1, 0.5), (2, 1, 1, 0.7), (2, 2, 3, 0.7)]
    zero = {r["child_id"]: r for r in P.skill_vector(children, perf).collect()}[2]
    assert tuple(zero)[1:] == (0, 0, 0.0, 0.0, 0.0, 0)


def test_plans_rules_and_dispatch(make):
    cats = make([(0, "b", "easy"), (1, "a", "hard"), (2, "c", "easy"), (3, "d", "easy"), (4, "e", "easy")], "category_id int, name string, difficulty_level string")
    items = make([(i, f"i{i}", i % 5, ("easy", "medium", "hard", None)[i % 4]) for i in range(60)], "item_id long, name string, category_id int, difficulty_level string")
    children = make([(1,), (2,)], "child_id long")
    perf = make([(1, 0, 0.5), (1, 1, 0.2)], "child_id long, category_id int, overall_score double")
    none = make([], "child_id long, item_id long, success_rate double")
    plans = {r["child_id"]: r for r in R.session_plan(children, perf, cats, items, none).collect()}
    assert plans[1]["category_id"] == 1 and plans[1]["item_ids"] == [16, 36, 56] and plans[2]["category_id"] == 0 and len(plans[2]["item_ids"]) == 5
    got = {r["child_id"]: r for r in R.rule_recommendations(children, perf, cats, items).collect()}
    assert [(a["category"], a["items"]) for a in got[1]["next_activities"]] == [("b", ["i5", "i25", "i45"]), ("a", ["i6", "i26", "i46"])]
    assert [(a["category"], a["items"]) for a in got[2]["next_activities"]] == [("b", ["i0", "i5", "i10"]), ("c", ["i2", "i7", "i12"]), ("d", ["i3", "i8", "i13"])]
    assert got[2]["practice_more"] == [] and got[2]["encouragement"] == "new_learner"
    assert R.recommend(children, cats, perf, items, none).columns == R.category_recommendations(children, cats, perf).columns
    assert {r["category_id"] for r in R.recommend(children, cats, perf, items, none, 1).collect()} == {1}


def test_targets(make):
    path = make([(1, i, t) for i, t in enumerate((0.7, 0.7, 0.95, 0.3))], "child_id long, category_id int, target_score double")
    perf = make([(1, i, s) for i, s in enumerate((0.8, 0.3, 0.99, 0.1))], "child_id long, category_id int, overall_score double")
    got = [r["target_score"] for r in R.updated_targets(path, perf).orderBy("category_id").collect()]
    assert got == pytest.approx([0.8, 0.6, 1.0, 0.3])


def test_category_recommendations(make):
    cats = make([(0, "a", "easy"), (1, "b", "hard"), (2, "c", "hard")], "category_id int, name string, difficulty_level string")
    perf = make([(1, 1, 0.2), (1, 2, 0.75)], "child_id long, category_id int, overall_score double")
    got = R.category_recommendations(make([(1,)], "child_id long"), cats, perf).orderBy("rank").collect()
    assert [r["category_id"] for r in got] == [1, 0]


def test_trend(make):
    days = [(1, 0, 0.1), (2, 7, 0.2), (3, 28, 0.9)]
    sessions = make([session(i, 1, 7, day=d) for i, d, _ in days], SES)
    acts = make([act(i, i, score=s) for i, _, s in days], ACT)
    got = G.progress_trend(make([(1,), (2,)], "child_id long"), sessions, acts, "2024-02-01 00:00:00", 60)
    rows = {r["child_id"]: r for r in got.collect()}
    assert (rows[1]["n_weeks"], rows[1]["trend"]) == (5, "improving") and rows[1]["rate"] == pytest.approx(0.16)
    assert rows[2]["trend"] == "no data"


def test_similar(make):
    names = ["a", "b"]
    vectors = make([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 0.0, 0.0), (4, 2.0, 1.0)], "child_id long, a double, b double")
    got = similar_children(vectors, vectors.where("child_id IN (1, 3)"), 3, names, pivots=2, slice_rows=1).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["child_id"], []).append((r["similar_id"], r["similarity"]))
    assert by[1] == [(2, 1.0), (4, 0.8), (3, None)] and by[3] == [(1, None), (2, None), (4, None)]


def test_a_table_is_put_to_each_row_without_a_cross_join(spark, make):
    from lorikeet.operators.ranking import put_to_each

    rows, small = make([(1,), (2,), (None,), (2,)], "id long"), make([("a",), ("b",), (None,)], "name string")
    got = put_to_each(rows, small, "id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, n) for i in (1, 2, None, 2) for n in ("a", "b", None)), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert put_to_each(rows, small.limit(0), "id").count() == 0


def test_numbers_within_a_hot_key(spark):
    from pyspark.sql import Window

    from lorikeet.operators import ranking

    rows = spark.range(3000).select(F.col("id").alias("item_id"), F.expr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END").alias("key"))
    bucket = F.floor(F.col("item_id") / 64)
    got = ranking.numbered(rows, ["key"], bucket, ["item_id"])
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("item_id")).cast("long"))
    assert sorted(map(tuple, got.select("item_id", "place").collect())) == sorted(map(tuple, plain.select("item_id", "place").collect()))
    assert rows.groupBy("key", bucket).count().agg(F.max("count")).first()[0] <= 64


def test_options(make):
    items = make([(i, i % 2) for i in range(9)], "item_id long, category_id int")
    rows = R.answer_options(items).collect()
    for item in range(9):
        mine = [r for r in rows if r["item_id"] == item]
        assert len({r["option_id"] for r in mine}) == len(mine) == 4 and sum(r["is_answer"] for r in mine) == 1
        assert {r["option_id"] % 2 for r in mine} == {item % 2} and sorted(r["place"] for r in mine) == [1, 2, 3, 4]


def test_adaptation(make):
    acts = make([act(i, 1, ok=i > 4) for i in range(1, 7)], ACT).withColumn("response_text", F.lit("bat"))
    items = make([(1, "cat")], "item_id long, name string")
    r = R.adaptation(acts, items).first()
    assert (r["recent_rate"], r["action"], r["focus_sound"], r["modality"]) == (0.4, "continue", "b→c", "verbal_challenge")


def test_tables(make, spark, tmp_path):
    old = make([(1, None, 0.5), (2, 1, 0.1)], "child_id long, category_id int, score double")
    new = make([(1, None, 0.7), (3, 2, 0.9)], "child_id long, category_id int, score double")
    got = {tuple(r) for r in W.upserted(old, new, ["child_id", "category_id"]).collect()}
    assert got == {(1, None, 0.7), (2, 1, 0.1), (3, 2, 0.9)}
    assert {tuple(r) for r in W.replaced(old, new, "child_id").collect()} == {(1, None, 0.7), (2, 1, 0.1), (3, 2, 0.9)}
    assert W.deletable(old, new, "child_id").first()["child_id"] == 2
    assert {tuple(r) for r in W.updated(old, make([(2, 0.4)], "child_id long, score double"), "child_id").collect()} == {(1, None, 0.5), (2, 1, 0.4)}
    several = make([(2, 0.4), (2, 0.3), (2, None)], "child_id long, score double")
    assert {tuple(r) for r in W.updated(old, several, "child_id").collect()} == {(1, None, 0.5), (2, 1, 0.4)}
    assert [r["child_id"] for r in W.owned(old, "category_id", 1).collect()] == [2]
    path = str(tmp_path / "t")
    W.append(old, path)
    W.append(new, path)
    assert spark.read.parquet(path).count() == 4 and W.lookup(spark.read.parquet(path), "child_id", 3).count() == 1
    part = str(tmp_path / "p")
    W.write_replacing(old, part, "child_id")
    W.write_replacing(new, part, "child_id")
    assert {(r["child_id"], r["score"]) for r in spark.read.parquet(part).collect()} == {(1, 0.7), (2, 0.1), (3, 0.9)}
    csv, schema = str(tmp_path / "c"), "child_id long, category_id int, score double"
    assert W.read_training(spark, csv, schema).count() == 0
    W.append_training(old, csv)
    W.append_training(new, csv)
    assert W.read_training(spark, csv, schema).count() == 4
    files = make([("a/x.WAV", 10), ("a/y.txt", 10), ("z.mp3", 6 * 1024 * 1024)], "path string, length long")
    assert [r["path"] for r in W.valid_audio(files).collect()] == ["a/x.WAV"]


def test_classifier_on_children_it_has_not_seen(make):
    """The category follows from the features by a rule; a third of the children is held out."""
    import random

    rng = random.Random(2)
    cols = ", ".join(f"{f} double" for f in classifier.FEATURES)
    rows = []
    for i in range(600):
        x = [rng.random() for _ in classifier.FEATURES]
        rows.append((i, *x, "Food" if x[0] + x[4] > 1.1 else "Toys" if x[1] > 0.5 else "Animals"))
    known = make(rows, f"child_id long, {cols}, recommended_category string")
    model = classifier.train(known.where("child_id % 3 <> 0"))
    held = known.where("child_id % 3 = 0")
    got = classifier.predict(held, model).join(held, "child_id").collect()
    right = sum(r["ml_recommendation"] == r["recommended_category"] for r in got) / len(got)
    largest = max(sum(r[-1] == c for r in rows) for c in ("Food", "Toys", "Animals")) / len(rows)
    assert len(got) == 200 and right > 0.85 > largest + 0.2


def test_combined_with_a_model(make):
    rules = make([(1, "a"), (2, "b")], "child_id long, encouragement string")
    learnt, features = make([(1, "Food")], "child_id long, ml_recommendation string"), make([(1, 0.5), (2, 0.25)], "child_id long, confidence_score double")
    got = {r["child_id"]: tuple(r)[1:] for r in R.combined_recommendations(rules, learnt, features).collect()}
    assert got == {1: ("a", "Food", 0.5), 2: ("b", None, 0.25)}


def test_classifier(make, tmp_path):
    cols = ", ".join(f"{f} double" for f in classifier.FEATURES)
    rows = make([(i, *[float(i % 2)] * 6, "Food" if i % 2 else "Toys") for i in range(40)], f"child_id long, {cols}, recommended_category string")
    model = classifier.train(rows)
    classifier.save(model, str(tmp_path / "m"))
    got = {r["child_id"]: r["ml_recommendation"] for r in classifier.predict(rows, classifier.load(str(tmp_path / "m"))).collect()}
    assert all(got[i] == ("Food" if i % 2 else "Toys") for i in range(40))
    levels = classifier.predict(make([(1, 0.9), (2, 0.7), (3, 0.1)], "child_id long, success_rate double"), None)
    assert [r[1] for r in levels.orderBy("child_id").collect()] == ["Actions", "Objects", "Animals"]
