"""Reports that refer to item lists, spelt out at the sink."""

from lorikeet.operators import report as T


def tables(spark):
    children = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "Cy"), (4, None)], "child_id long, name string")
    performance = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.25), (2, 10, 1.0), (3, 30, 0.0), (3, 99, 0.5)], "child_id long, category_id int, overall_score double")
    categories = spark.createDataFrame([(10, "Toys", "easy"), (20, "Food", None), (30, "Empty", "hard")], "category_id int, name string, difficulty_level string")
    sessions = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00")], "session_id long, child_id long, start_time string")
    feedback = spark.createDataFrame([(5, 1, 4, "x", "2024-01-02 00:00:00")], "feedback_id long, session_id long, rating int, feedback_type string, created_at string")
    items = spark.createDataFrame(
        [(i, f"item {i}", 10, "hard" if i % 2 else "") for i in range(25)] + [(100, "bread", 20, None), (101, "milk", 20, "easy"), (102, "lost", None, None), (-3, "first", 10, None)],
        "item_id long, name string, category_id int, difficulty_level string",
    )
    return children, performance, categories, sessions, feedback, items


def test_lists_are_whole_and_spelt_out_once(spark, tmp_path):
    children, performance, categories, sessions, feedback, items = tables(spark)
    blocks = T.item_blocks(items, categories, 10)
    assert {(r["category_id"], r["block"], r["n_items"]) for r in blocks.collect()} == {(10, 0, 10), (10, 1, 10), (10, 2, 6), (20, 0, 2)}
    reports = T.child_reports(children, performance, categories, sessions, feedback, items, 10)
    whole = {r["child_id"]: r["report"] for r in reports.collect()}
    lists = {r["category_id"]: r["list_id"] for r in T.item_lists(blocks).collect()}
    assert whole[1] == f"Learner: Ann\nScores:\nFood 25% [2 items: {lists[20]}]\nToys 50% [26 items: {lists[10]}]\nLatest rating: 4"
    assert whole[2] == f"Learner: Bo\nScores:\nToys 100% [26 items: {lists[10]}]" and whole[3] == "Learner: Cy\nScores:\nEmpty 0%"
    T.write_reports(reports, blocks, str(tmp_path / "out"), 3)
    rows = spark.read.parquet(str(tmp_path / "out")).where("child_id = 1").orderBy("child_id", "line", "block").collect()
    level = lambda i: "hard" if i % 2 else "easy"
    toys = "; ".join(["first (easy)", *[f"item {i} ({level(i)})" for i in range(25)]])
    text = [r["text"] for r in rows]
    assert "; ".join(text[5:8]) == toys and [r["block"] for r in rows] == [-1, -1, -1, 0, -1, 0, 1, 2, -1]
    head = whole[1].split("\n")
    assert text[:5] == [*head[:3], "bread; milk (easy)", head[3]] and text[8] == head[4]


def test_content_names_the_list(spark):
    *_, categories, sessions, feedback, items = tables(spark)
    same = items.where("category_id = 10").selectExpr("item_id", "name", "category_id * 3 AS category_id", "coalesce(nullif(difficulty_level, ''), 'easy') AS difficulty_level")
    lists = {r["category_id"]: (r["list_id"], r["n_items"]) for r in T.item_lists(T.item_blocks(items.unionByName(same), categories, 7)).collect()}
    assert lists[10] == lists[30] and lists[10] != lists[20]
    assert T.item_blocks(items.limit(0), categories).count() == 0
