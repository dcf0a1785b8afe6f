"""Shared helpers: scratch tables, prefix sums, null-safe keys, memory of Python workers."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder of its own (tests);
    a cluster must name one, since executors share no local disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lorikeet-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables of the application that are still there, and the scope that new ones belong to.
_all: list[str] = []
_scope: contextvars.ContextVar[list[str]] = contextvars.ContextVar("scope", default=_all)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with its scope."""
    path = f"{scratch_dir(spark)}/lorikeet/{name}-{uuid.uuid4().hex}"
    _scope.get().append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made inside go at the end, but for the paths that are put
    into the list; those pass to the scope around. For code that reads its results
    out inside, such as by writing them."""
    kept: list[str] = []
    mine: list[str] = []
    outer = _scope.set(mine)
    try:
        yield kept
    finally:
        _scope.reset(outer)
        _scope.get().extend(p for p in mine if p in kept)
        for path in mine:
            if path not in kept:
                drop_path(spark, path)


def _drop_all() -> None:
    """At the end of the application: results are lazy, so their tables stay till then."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_all):
            drop_path(spark, path)


atexit.register(_drop_all)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends
    there, and losing an executor costs no more than a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; the scratch tables that it made go."""
    with scratch_scope(spark) as kept:
        path = scratch_path(spark, name)
        kept.append(path)
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, whatever the store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for scope in (_scope.get(), _all):
        if path in scope:
            scope.remove(path)


#: What empties the caches that a Python worker keeps from task to task.
_caches: list[Callable[[], None]] = []


def kept_in_worker(clear: Callable[[], None]) -> None:
    """``clear`` empties a cache that outlives its task; tasks of other operators call it."""
    _caches.append(clear)


def _forget_others(own: Callable[[], None] | None) -> None:
    for clear in _caches:
        if clear is not own:
            clear()


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where Arrow and
    the C library would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def frugal(each: Callable[[Iterator], Iterator], own: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``each``, for workers that an executor uses for one operator after another:
    what others keep there goes before a task (all but the cache that ``own``
    empties), and what the task has freed goes back when it ends."""

    def run(batches: Iterator) -> Iterator:
        _forget_others(own)
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def null_key(col: Column | str) -> Column:
    """A string that differs for every value and for null, so that plain
    equality joins, groupings and windows share one partitioning."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def sum_before(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``keys`` that come
    earlier, where rows are ordered by ``bucket`` and, within it, by ``order``.

    A key of any size is spread over its buckets: totals by (key, bucket) are
    summed first, and only rows of one bucket are sorted together. ``keys`` and
    ``bucket`` must not be null.
    """
    by = [*keys, bucket]
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by)
        .agg(F.sum(value).alias("__bucket_sum"))
        .select(*by, F.coalesce(F.sum("__bucket_sum").over(along), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, by, "left")
        .withColumn(out, F.col(out) + F.col("__offset"))
        .drop("__offset")
    )
