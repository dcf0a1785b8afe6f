"""Reading, writing and changing tables.

Parquet has no in-place change, so an update is a new table made by a join, and
a write goes to a fresh path or to whole partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.schemas import SCHEMAS, SOURCES


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """S-01: a domain table, or one that the domain is derived from, with its fixed schema (S-02)."""
    return spark.read.schema((SCHEMAS | SOURCES)[table]).parquet(path)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """S-03, S-04: the row of a key, at most one."""
    return df.where(F.col(key) == value).limit(1)


def append(df: DataFrame, path: str) -> None:
    """S-05."""
    df.write.mode("append").parquet(path)


def owned(df: DataFrame, owner: str, caller) -> DataFrame:
    """P-02: the rows of ``df`` whose column ``owner`` is the caller."""
    return df.where(F.col(owner) == F.lit(caller))


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """S-06: ``df`` where rows of ``changes`` replace the columns they set (not null).
    Of several changes of one key each column takes the largest value, so no row
    is ever doubled; null keys change nothing."""
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in changes.columns if c != key])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in new.columns else F.col(c) for c in df.columns])


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """S-07: ``df`` without the rows whose key is in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def deletable(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """S-08: the rows that no fact refers to."""
    return df.join(facts.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def replaced(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """S-09, S-11: for every key in ``new`` its rows there instead of those in ``df``."""
    return deleted(df, new, key).unionByName(new)


def write_replacing(new: DataFrame, path: str, partition: str) -> None:
    """S-09 on disk: the partitions that ``new`` has are written anew, others stay."""
    new.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], updated_at: str | None = None) -> DataFrame:
    """S-10: the roll-up after ``new`` is merged in: known keys take the new values,
    others are added, the rest stays. Null keys match each other."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, cond, "full_outer")
    fresh = F.coalesce(F.col("b.__new"), F.lit(False))
    out = [F.when(fresh, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    return joined.select(*out, *[F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values])


def read_training(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-12: CSV with a header and a given schema; a path that is not there is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def append_training(df: DataFrame, path: str) -> None:
    """S-12: rows added to the CSV folder; earlier files stay as they are."""
    df.write.mode("append").option("header", True).csv(path)


def valid_audio(files: DataFrame, max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """S-16: audio files by name and size, of a ``binaryFile`` scan without content."""
    named = F.lower("path").rlike(r"\.(wav|mp3|m4a|ogg|webm|flac)$")
    return files.select("path", "length").where(named & (F.col("length") <= max_bytes))


def with_constraints(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie in their ranges, such as a rating of 1 to 5."""
    for column, (low, high) in ranges.items():
        df = df.where(F.col(column).between(low, high))
    return df
