"""Exact dedup with an index of cuckoo filters over live digests.

The index deals digests to slices by hash. Of each slice it keeps a cuckoo
filter, a small table of 16-bit tags, and in tables beside it the content: the
live digests with the document that stays, and every live document. A digest
that the filter doesn't know is new for certain; a hit is verified against the
content of its slice, so that a tag in common never drops a text. Digests enter
the filter once and leave it when their last document is deleted. A filter that
overflows is built again, twice as large, from the keys stored beside it.
"""

from __future__ import annotations

import dataclasses
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.common import written

#: Tags in a bucket, moves that one insertion may take, and buckets of a new filter.
SLOTS, MOST_KICKS, FIRST_BUCKETS = 4, 200, 1024
#: Documents of a slice, on average, when an index is made; one task holds a slice's digests.
SLICE_ROWS = 100_000
#: A text with more than one in so many rows is looked up in a table of its own, of fewer rows than this.
HOT_SHARE = 1000
#: What orders the documents of a text: rows without doc_id last, then doc_id, insertion and row.
KEEPER = ["missing", "doc_id", "batch", "row"]
_KEYS = "slice int, digest binary, missing boolean, doc_id long, batch int, row long, copies long"
_PASSED = f"kind string, {_KEYS}, buckets int, table binary"
_FILTERS = "slice int, buckets int, table binary"


class CuckooFilter:
    """A set of digests by tags of 16 bits, each in one of two buckets.

    The second bucket follows from the first and the tag, so a tag can move
    without its digest, and a deletion takes out one such tag. Only digests that
    are in may be deleted.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS, table: bytes | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets, self.table = buckets, array("H", table or bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return tag, home, self._other(tag, home)

    def _other(self, tag: int, bucket: int) -> int:
        return bucket ^ (tag * 0x9E3779B1 >> 7) & (self.buckets - 1)

    def _slot(self, tag: int, bucket: int) -> int:
        """Where the tag is in the bucket, or -1."""
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.table[at] == tag:
                return at
        return -1

    def __contains__(self, digest: bytes) -> bool:
        tag, home, other = self._places(digest)
        return self._slot(tag, home) >= 0 or self._slot(tag, other) >= 0

    def insert(self, digest: bytes) -> bool:
        """Whether there was room; if not, the filter is as before."""
        tag, home, other = self._places(digest)
        for bucket in (home, other):
            if (at := self._slot(0, bucket)) >= 0:
                self.table[at] = tag
                return True
        bucket, moved = other, []
        for kick in range(MOST_KICKS):
            at = SLOTS * bucket + (kick + tag) % SLOTS
            moved.append((at, self.table[at]))
            tag, self.table[at] = self.table[at], tag
            bucket = self._other(tag, bucket)
            if (free := self._slot(0, bucket)) >= 0:
                self.table[free] = tag
                return True
        for at, before in reversed(moved):
            self.table[at] = before
        return False

    def delete(self, digest: bytes) -> bool:
        """Take out one tag of the digest; whether there was one."""
        tag, home, other = self._places(digest)
        for bucket in (home, other):
            if (at := self._slot(tag, bucket)) >= 0:
                self.table[at] = 0
                return True
        return False

    @classmethod
    def holding(cls, digests: Iterable[bytes], buckets: int = FIRST_BUCKETS) -> CuckooFilter:
        """A filter of distinct digests, with as many buckets as they need."""
        keys = list(digests)
        while True:
            made = cls(buckets)
            if all(map(made.insert, keys)):
                return made
            buckets *= 2


def _filter_of(filters: pd.DataFrame) -> CuckooFilter:
    return CuckooFilter(int(filters["buckets"].iloc[0]), filters["table"].iloc[0]) if len(filters) else CuckooFilter()


def _filter_row(slice_: int, found: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"slice": [slice_], "buckets": [found.buckets], "table": [found.table.tobytes()]})


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of an Arrow batch with one digest become one row, so that a text with any
    share of the rows sends a row a batch."""
    for rows in batches:
        rows = rows.sort_values(KEEPER)
        first = rows.drop_duplicates("digest")
        yield first.assign(copies=first["digest"].map(rows.groupby("digest")["copies"].sum()))


def _pass(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """One slice: digests that miss the filter enter it and are new. Hits are
    verified here against those, and are new where they are none of them and
    nothing is stored; else they have yet to be verified against the stored content."""
    known, stored = _filter_of(filters), len(filters) > 0
    fresh: dict[bytes, list] = {}
    maybe: dict[bytes, list] = {}
    unplaced: set[bytes] = set()
    for digest, *keeper, copies in rows[["digest", *KEEPER, "copies"]].itertuples(index=False, name=None):
        hit = digest in known or digest in unplaced
        found = maybe if stored and hit and digest not in fresh else fresh
        if found is fresh and digest not in fresh and not known.insert(digest):
            if stored:  # the keys are in the content: built again from there
                unplaced.add(digest)
            else:
                known = CuckooFilter.holding([*fresh, digest], 2 * known.buckets)
        before = found.setdefault(digest, [keeper, 0])
        before[0] = min(before[0], keeper)
        before[1] += copies
    out = [
        pd.DataFrame(
            [(kind, digest, *keeper, copies) for digest, (keeper, copies) in found.items()],
            columns=["kind", "digest", *KEEPER, "copies"],
        )
        for kind, found in (("new", fresh), ("maybe", maybe))
    ]
    out.append(_filter_row(key[0], known).assign(kind="overflow" if unplaced else "filter"))
    columns = ["kind", "slice", "digest", *KEEPER, "copies", "buckets", "table"]
    out = pd.concat([o.assign(slice=key[0]).reindex(columns=columns).astype(object) for o in out if len(o)])
    return out.where(out.notna(), None)


def _enter(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """A slice's filter with verified digests put in; without its table if there's no room."""
    known = _filter_of(filters)
    if all([known.insert(d) for d in rows["digest"]]):
        return _filter_row(key[0], known)
    return pd.DataFrame({"slice": [key[0]], "buckets": [known.buckets], "table": [None]})


def _leave(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    known = _filter_of(filters)
    for digest in rows["digest"]:
        known.delete(digest)
    return _filter_row(key[0], known)


def _hits(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    known = _filter_of(filters)
    return rows[[d in known for d in rows["digest"]]]


def _rebuilt(key: tuple, overflown: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    return _filter_row(key[0], CuckooFilter.holding(keys["digest"], 2 * int(overflown["buckets"].iloc[0])))


def _together(left: DataFrame, right: DataFrame, apply, schema: str) -> DataFrame:
    return left.groupBy("slice").cogroup(right.groupBy("slice")).applyInPandas(apply, schema)


def normalised(text: Column | str) -> Column:
    """The text with each run of white space as one space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclasses.dataclass(frozen=True)
class CuckooIndex:
    """The index as it is after some insertions and deletions, which give new ones.

    ``filters`` (slice, buckets, table) has a row a slice; ``live`` the live digests
    with the document that stays and the number of documents; ``members`` the live
    documents. SHA-256 stands for the text. All tables are written ones.
    """

    slices: int
    batch: int = 0
    filters: DataFrame | None = None
    live: DataFrame | None = None
    members: DataFrame | None = None

    @classmethod
    def sized(cls, spark: SparkSession, rows: int, slice_rows: int = SLICE_ROWS) -> CuckooIndex:
        """An empty index, cut for about so many documents."""
        return cls(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // slice_rows)))

    def digests(self, docs: DataFrame) -> DataFrame:
        """(slice, digest, missing, doc_id, batch, row) of ``docs`` (doc_id, text, ...), written."""
        rows = docs.select(
            F.unhex(F.sha2(normalised("text").cast("binary"), 256)).alias("digest"), F.col("doc_id").cast("long").alias("id")
        )
        rows = rows.select(
            F.expr(f"cast(pmod(xxhash64(digest), {self.slices}) as int)").alias("slice"),
            "digest",
            F.col("id").isNull().alias("missing"),
            F.coalesce("id", F.lit(0)).alias("doc_id"),
            F.lit(self.batch).alias("batch"),
            F.monotonically_increasing_id().alias("row"),
        )
        return written(rows, "digests")

    def insert(self, docs: DataFrame) -> tuple[CuckooIndex, DataFrame]:
        """The index with all rows of ``docs``, and their digests for ``decisions``."""
        rows = self.digests(docs)
        spark = docs.sparkSession
        combined = rows.withColumn("copies", F.lit(1).cast("long")).mapInPandas(_combine, _KEYS)
        filters = spark.createDataFrame([], _FILTERS) if self.filters is None else self.filters
        passed = written(_together(filters, combined, _pass, _PASSED), "passed")
        keys = ["slice", "digest", *KEEPER, "copies"]
        new = passed.where("kind = 'new'").select(*keys)
        made = passed.where("kind IN ('filter', 'overflow')").select("slice", "buckets", "table", "kind")
        if self.filters is None:
            return CuckooIndex(self.slices, self.batch + 1, made.drop("kind"), new, rows), rows
        live, filters = self.live, made
        untouched = self.filters.join(made, "slice", "left_anti").withColumn("kind", F.lit("filter"))
        filters = untouched.unionByName(made)
        hits = passed.where("kind = 'maybe'").select(*keys)
        if hits.limit(1).count():
            stored = self.live.select("slice", "digest", F.lit(True).alias("stored"))
            verified = written(hits.join(stored, ["slice", "digest"], "left"), "verified")
            unknown = verified.where("stored IS NULL").select(*keys)
            more = verified.where("stored").select(
                "slice", "digest", F.struct(*KEEPER).alias("__keeper"), F.col("copies").alias("__copies")
            )
            joined = live.join(more, ["slice", "digest"], "left")
            keeper = F.least(F.struct(*KEEPER), F.coalesce("__keeper", F.struct(*KEEPER)))
            joined = joined.select("slice", "digest", keeper.alias("k"), (F.col("copies") + F.coalesce("__copies", F.lit(0))).alias("copies"))
            live = joined.select("slice", "digest", "k.*", "copies").unionByName(unknown)
            entered = unknown.select("slice").distinct()
            some = filters.where("kind = 'filter'").join(entered, "slice", "left_semi").drop("kind")
            put = _together(some, unknown.join(some, "slice", "left_semi"), _enter, _FILTERS)
            put = put.withColumn("kind", F.when(F.col("table").isNull(), "overflow").otherwise("filter"))
            put = written(put, "entered")
            filters = filters.join(put, "slice", "left_anti").unionByName(put)
        live = written(live.unionByName(new), "live")
        grown = CuckooIndex(self.slices, self.batch + 1, filters, live, written(self.members.unionByName(rows), "members"))
        return grown._resized(), rows

    def _resized(self) -> CuckooIndex:
        """Filters that overflowed, built again from the digests stored for their slices."""
        overflown = self.filters.where("kind = 'overflow'").select("slice", "buckets")
        keys = self.live.join(overflown, "slice", "left_semi").select("slice", "digest")
        built = _together(overflown, keys, _rebuilt, _FILTERS)
        kept = self.filters.where("kind = 'filter'").drop("kind")
        return dataclasses.replace(self, filters=written(kept.unionByName(built), "filters"))

    def delete(self, docs: DataFrame) -> CuckooIndex:
        """The index without the live rows that have a doc_id and text of ``docs``;
        what isn't live is passed over."""
        if self.filters is None:
            return self
        at = ["slice", "digest", "missing", "doc_id"]
        asked = self.digests(docs).select(*at).distinct()
        hits = written(_together(self.filters, asked, _hits, "slice int, digest binary, missing boolean, doc_id long"), "hits")
        touched = written(self.members.join(hits, at, "left_semi").select("slice", "digest").distinct(), "touched")
        members = written(self.members.join(hits, at, "left_anti"), "members")
        again = members.join(touched, ["slice", "digest"], "left_semi").groupBy("slice", "digest")
        again = again.agg(F.min(F.struct(*KEEPER)).alias("k"), F.count("*").alias("copies"))
        again = written(again.select("slice", "digest", "k.*", "copies"), "again")
        live = self.live.join(touched, ["slice", "digest"], "left_anti").unionByName(again)
        dead = touched.join(again, ["slice", "digest"], "left_anti")
        filters = written(_together(self.filters, dead, _leave, _FILTERS), "filters")
        return CuckooIndex(self.slices, self.batch + 1, filters, written(live, "live"), members)

    def holds(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, live) for ``docs``: misses of the filters aren't looked up."""
        rows = self.digests(docs)
        if self.filters is None:
            return rows.select(_doc_id(), "digest", F.lit(False).alias("live"))
        hits = _together(self.filters, rows.select("slice", "digest").distinct(), _hits, "slice int, digest binary")
        verified = hits.join(self.live.select("slice", "digest"), ["slice", "digest"], "left_semi").withColumn("live", F.lit(True))
        found = rows.join(verified, ["slice", "digest"], "left")
        return found.select(_doc_id(), "digest", F.coalesce("live", F.lit(False)).alias("live"))

    def decisions(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of the rows of an insertion."""
        groups = self.live.select(
            "slice",
            "digest",
            F.struct(F.when(~F.col("missing"), F.col("doc_id")).alias("keep_id"), "copies", "batch", "row").alias("g"),
        )
        # fewer than HOT_SHARE texts can have so many rows each: a proven bound
        most = self.live.agg(F.sum("copies")).first()[0] or 0
        hot = groups.where(F.col("g.copies") > most / HOT_SHARE)
        found = rows.join(F.broadcast(hot.withColumnRenamed("g", "h")), ["slice", "digest"], "left")
        cold = groups.where(F.col("g.copies") <= most / HOT_SHARE)
        rest = found.where("h IS NULL").drop("h").join(cold, ["slice", "digest"]).unionByName(
            found.where("h IS NOT NULL").withColumnRenamed("h", "g")
        )
        return rest.select(
            _doc_id(),
            F.col("g.keep_id").alias("keep_id"),
            F.col("g.copies").alias("group_size"),
            ((F.col("g.batch") == F.col("batch")) & (F.col("g.row") == F.col("row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def _doc_id() -> Column:
    return F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id")


def op12_exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``
    (doc_id, text, ...), put into an empty index.

    Texts are equal when identical with each run of white space as one space; null
    is empty. The row with the smallest doc_id stays; rows without one come last,
    and of rows that share it one stays, so each text has one row that is kept.
    Other columns are ignored; an empty table gives an empty table.
    """
    index, rows = CuckooIndex.sized(docs.sparkSession, docs.count()).insert(docs)
    return index.decisions(rows)


OP12_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
