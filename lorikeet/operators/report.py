"""Text reports of a child for a reviewer (B-32).

The items of a category are the same for every child that has it, so they are put
together once, in blocks of bounded size, and named by their content. A report
refers to the list of its category; it is spelt out where it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.functions.text import percent
from lorikeet.operators.ranking import id_slice, numbered
from lorikeet.operators.recommend import effective_difficulty
from lorikeet.operators.sessions import first_feedback, newest

#: Items in one block of text.
BLOCK = 1000


def item_blocks(items: DataFrame, categories: DataFrame, block: int = BLOCK) -> DataFrame:
    """(category_id, block, n_items, text, block_id): all items of each category by
    id with the level of each (its own, else the category's), ``block`` to a row;
    block_id is the SHA-256 of the text."""
    level = F.col("difficulty_level").alias("category_level")
    known = items.join(categories.select("category_id", level), "category_id")
    placed = numbered(known, ["category_id"], id_slice("item_id"), ["item_id"])
    given = F.coalesce(F.concat(F.lit(" ("), effective_difficulty(), F.lit(")")), F.lit(""))  # no level: the name alone
    shown = F.struct("place", F.concat(F.coalesce("name", F.lit("")), given).alias("text")).alias("item")
    rows = placed.select("category_id", F.floor((F.col("place") - 1) / block).cast("int").alias("block"), shown)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), "; ")
    made = rows.groupBy("category_id", "block").agg(F.count("*").alias("n_items"), joined.alias("text"))
    return made.withColumn("block_id", F.sha2("text", 256))


def item_lists(blocks: DataFrame) -> DataFrame:
    """(category_id, list_id, n_items): list_id is the SHA-256 of the ids of the
    category's blocks, in order; of the texts only these ids come together."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("block", "block_id"))), lambda x: x["block_id"])
    found = blocks.select("category_id", "block", "block_id", "n_items").groupBy("category_id")
    return found.agg(F.sha2(F.array_join(ids, ","), 256).alias("list_id"), F.sum("n_items").alias("n_items"))


def child_reports(
    children: DataFrame, performance: DataFrame, categories: DataFrame, sessions: DataFrame, feedback: DataFrame, items: DataFrame, block: int = BLOCK
) -> DataFrame:
    """(child_id, report): the child, its categories by name with score and, in
    brackets, the number and list_id of all their items (``item_lists``), and the
    first feedback of its latest session; without a roll-up no feedback is known."""
    lists = item_lists(item_blocks(items, categories, block))
    named = categories.select("category_id", "name").join(lists, "category_id", "left")
    shown = F.concat(F.lit(" ["), F.col("n_items").cast("string"), F.lit(" items: "), F.col("list_id"), F.lit("]"))
    text = F.concat(F.concat_ws(" ", "name", percent(F.col("overall_score"))), F.coalesce(shown, F.lit("")))
    lines = performance.join(named, "category_id").select("child_id", F.struct("name", text.alias("line")).alias("line"))
    listed = lines.groupBy("child_id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]).alias("lines"))
    latest = newest(sessions.select("session_id", "child_id", "start_time"), "child_id", "start_time", "session_id", 1)
    rated = latest.join(first_feedback(feedback).select("session_id", "rating"), "session_id").select("child_id", "rating")
    joined = children.select("child_id", "name").join(listed, "child_id", "left").join(rated, "child_id", "left")
    head = F.concat(F.lit("Learner: "), "name")
    body = F.coalesce(F.concat(F.lit("\nScores:\n"), F.array_join("lines", "\n")), F.lit("\nNo scores yet"))
    note = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\nLatest rating: "), F.col("rating").cast("string")))
    return joined.select("child_id", F.concat(head, body, F.coalesce(note, F.lit(""))).alias("report"))


def report_rows(reports: DataFrame, blocks: DataFrame) -> DataFrame:
    """(child_id, line, block, text): the reports with every list spelt out, a row for
    each line and each block of a list; read by child_id, line and block (-1: the
    line itself) they are the whole text. Items meet children only here, at the sink."""
    lists = item_lists(blocks).select("category_id", "list_id")
    known = blocks.join(lists, "category_id").select("list_id", "block", "text").dropDuplicates(["list_id", "block"])
    lines = reports.select("child_id", F.posexplode(F.split("report", "\n")).alias("line", "text"))
    named = lines.withColumn("list_id", F.nullif(F.regexp_extract("text", r"\[\d+ items: ([0-9a-f]{64})\]$", 1), F.lit("")))
    spelt = named.where("list_id IS NOT NULL").select("child_id", "line", "list_id").join(known, "list_id")
    own = named.select("child_id", "line", F.lit(-1).alias("block"), "text")
    return own.unionByName(spelt.select("child_id", "line", "block", "text"))


def write_reports(reports: DataFrame, blocks: DataFrame, path: str, ranges: int = 200) -> None:
    """The spelt-out reports as Parquet, dealt into ranges of children, each in the
    order in which it is read."""
    rows = report_rows(reports, blocks).repartitionByRange(ranges, "child_id", "line", "block")
    rows.sortWithinPartitions("child_id", "line", "block").write.parquet(path)
