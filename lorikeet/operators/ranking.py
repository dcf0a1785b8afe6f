"""Row numbers within keys of any size, and tables put to each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring ids that are numbered by one task.
WIDTH = 1 << 16


def id_slice(column: str) -> Column:
    """A bucket for ``numbered`` of rows ordered by an integer id."""
    return F.floor(F.col(column) / WIDTH)


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], out: str = "place") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... within ``keys`` along ``bucket`` and, within a
    bucket, along ``order``. ``bucket`` must rise along the order.

    Rows of a key are counted by bucket first, so only rows of one bucket are
    sorted together and a key may hold any share of the rows. Neither keys nor
    bucket may be null.
    """
    rows = df.withColumn("__bucket", bucket)
    by = [*keys, "__bucket"]
    along = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    offsets = counts.select(*by, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumn(out, F.row_number().over(inside)).join(offsets, by)
    return placed.withColumn(out, (F.col(out) + F.col("__offset")).cast("long")).drop("__bucket", "__offset")


def put_to_each(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Every row of ``rows`` beside every row of ``small``, where that is the result.

    Both meet on a salt, so it is a join like any other: the planner broadcasts
    ``small`` where its size is known to allow it, else rows are dealt to as many
    salts as there are shuffle partitions, each of which has a copy of ``small``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).join(copies, "__salt").drop("__salt")
