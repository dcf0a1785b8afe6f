"""Tables that are changed by key, touching only the buckets that change (S-09, S-10).

Rows are dealt to buckets by a hash of their key; each bucket is a folder. A change
reads the buckets that its keys fall into, writes their new contents to a folder
of its own and then names them in a new manifest, in one step. So readers and lost
runs see the table as it was, and the files of all other buckets stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from lorikeet.sources.tables import upserted

#: The column that names the folders of buckets, and the one that parts a bucket's keys.
_BUCKET, _PART = "lorikeet_bucket", "lorikeet_part"
#: What ``KeyedTable.dealt`` adds; groups and windows of a key that name it first need no other shuffle.
DEAL = (_BUCKET, _PART)


class ConflictError(RuntimeError):
    """Another change was made since the manifest was read."""


class KeyedTable:
    """A table under ``path`` with the columns of ``schema``, changed by ``keys``.

    The number of buckets is that of the table's first change. Null keys are keys
    like any other. A change gives the version that it makes; changes that start
    from one version exclude each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/manifests") if n.isdigit())

    def manifest(self) -> dict:
        """{version, buckets, last_batch, folders: {bucket: folder}} as of now."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": self._buckets, "last_batch": None, "folders": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{versions[-1]}").first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """The new manifest under its number, whole or not at all."""
        made, final = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{manifest['version']}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # renaming to a name that is taken fails or, in some stores, puts it inside; the check covers the latter
        if self._fs.exists(final) or not self._fs.rename(made, final):
            self._fs.delete(made, False)
            raise ConflictError(f"version {manifest['version']} of {self.path} was made by another change")

    def _load(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(manifest["folders"].items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._load(self.manifest())

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.struct(k) for k in self.keys]), F.lit(n)).cast("int").alias(_BUCKET)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``DEAL``, shuffled by them: all rows of a key
        lie in one task, those of a bucket in so many that tasks are as many as shuffle
        partitions. For a merge that keeps them so, whose result isn't shuffled again."""
        n = self.manifest()["buckets"]
        parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n)
        part = F.pmod(F.xxhash64(F.lit(_PART), *[F.struct(k) for k in self.keys]), F.lit(parts)).cast("int")
        return rows.withColumns({_BUCKET: self._bucket(n), _PART: part}).repartition(*DEAL)

    def change(
        self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, dealt: bool = False
    ) -> int | None:
        """Put ``merge(rows of the buckets touched, changes)`` in place of these
        buckets. ``changes`` holds the keys; merge gives the columns of the table
        and leaves the keys of other rows as they are. With ``batch``, numbers must
        rise: one that was applied before, or is lower, changes nothing (None). A merge
        of ``dealt`` rows leaves them where they are, and they are written there.

        The driver sees the numbers of the buckets touched."""
        was = self.manifest()
        if batch is not None and was["last_batch"] is not None and batch <= was["last_batch"]:
            return None
        bucket = self._bucket(was["buckets"])
        changes = changes.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = {str(r[0]) for r in changes.select(bucket).distinct().collect()}
            rows = merge(self._load(was, touched), changes).select(*self.schema.names)
            folder = uuid.uuid4().hex
            rows = rows.withColumn(_BUCKET, bucket)
            (rows if dealt else rows.repartition(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        finally:
            changes.unpersist()
        made = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/data/{folder}") if n.startswith(f"{_BUCKET}=")}
        if not set(made) <= touched:
            raise ValueError("merge gave rows of buckets that no change falls into")
        kept = {b: f for b, f in was["folders"].items() if b not in touched}
        last = was["last_batch"] if batch is None else batch
        self._commit({"version": was["version"] + 1, "buckets": was["buckets"], "last_batch": last, "folders": kept | made})
        return was["version"] + 1

    def upsert(self, new: DataFrame, batch: int | None = None) -> int | None:
        """S-10: known keys take the new values, others are added. Of several new
        rows of one key the largest counts."""
        values = [c for c in self.schema.names if c not in self.keys]
        one = new.groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("__v")).select(*self.keys, "__v.*")
        return self.change(one, lambda old, rows: upserted(old, rows, self.keys), batch)

    def replace(self, new: DataFrame, batch: int | None = None) -> int | None:
        """S-09: for every key in ``new`` its rows there, instead of those that it had."""
        return self.change(new, lambda old, rows: _without(old, rows, self.keys).unionByName(rows.select(*old.columns)), batch)

    def delete(self, gone: DataFrame, batch: int | None = None) -> int | None:
        """S-07: all rows of the keys in ``gone`` go."""
        return self.change(gone.select(*self.keys), lambda old, rows: _without(old, rows, self.keys), batch)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what the newest ``keep`` versions don't name, such as what lost
        runs have left. Not while a change runs or an older version is read."""
        versions = self._versions()
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{v}"), False)
        named = set()
        for v in versions[-keep:]:
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{v}").first()[0]
            named |= set(json.loads(text)["folders"].values())
        for folder in self._names(f"{self.path}/data"):
            inside = [f"{folder}/{n}" for n in self._names(f"{self.path}/data/{folder}")]
            if not named & set(inside):
                self._fs.delete(self._at(f"{self.path}/data/{folder}"), True)
                continue
            for at in inside:
                if at not in named and f"{_BUCKET}=" in at:
                    self._fs.delete(self._at(f"{self.path}/data/{at}"), True)


def _without(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't among those of ``gone``; null keys match each other."""
    a, b = old.alias("a"), gone.select(*keys).distinct().alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, cond, "left_anti")
