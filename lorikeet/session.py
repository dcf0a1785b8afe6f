"""The session that the library expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC and ANSI semantics; the rest is left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "lorikeet", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once a session, so that functions
    run on executors which have no copy of it; Spark serves the archive."""
    context = spark.sparkContext
    if not getattr(context, "_lorikeet_shipped", False):
        root, folder = Path(__file__).parent, tempfile.mkdtemp(prefix="lorikeet-")
        archive = os.path.join(folder, "lorikeet.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, os.path.join("lorikeet", file.relative_to(root)))
        atexit.register(shutil.rmtree, folder, True)  # executors that start later fetch it too
        context.addPyFile(archive)
        context._lorikeet_shipped = True
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query keeps, in ``spark.checkpoint.dir``; it
    goes at the end of the application. Where the setting is missing a local master
    gets a temporary folder, and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lorikeet-")
    path = f"{found.rstrip('/')}/lorikeet/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, for results that are used several times;
    its lineage ends there, and the planner knows its size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
