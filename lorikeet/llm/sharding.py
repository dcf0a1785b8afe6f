"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard. At each level every child draws an
exponential variate from a hash of the row's key and the child's name, with its
weight as the rate, and the least draw wins; so a child gets rows in proportion
to its weight, and changing a weight moves rows only into or out of the subtrees
whose weights change.

A shard added later keeps a draw of its own beside those of the founding tree: a
subtree's draw is the least of its founding draw and those of shards added in
it. The least of exponentials has the sum of the weights as its rate, so shares
stay exact, and a row moves only when the new shard's draw wins: into that shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.common import sum_before


@dataclass(frozen=True)
class ShardTree:
    """weights[region][rack][shard]: positive weights of the founding shards,
    numbered in that order; added: weights of later shards, numbered after them."""

    weights: Sequence[Sequence[Sequence[float]]]
    added: Sequence[float] = field(default=())

    def __post_init__(self):
        flat = [w for region in self.weights for rack in region for w in rack] + list(self.added)
        if not flat or min(flat) <= 0:
            raise ValueError("a tree needs shards, all of positive weight")

    @property
    def founding(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


#: 40 shards: 2 regions of 4 racks of 5 shards.
TREE = ShardTree([[[1.0] * 5] * 4] * 2)


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the upper 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / float(weight)


def _least(key: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """struct(draw, child) of the child with the least draw."""
    return F.array_min(
        F.array(*[
            F.struct(_draw(key, n, w).alias("draw"), F.lit(i).alias("child"))
            for i, (n, w) in enumerate(zip(names, weights))
        ])
    )


def _choose(at: Column, options: Sequence[Column]) -> Column:
    out = F.when(at == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(at == i, option)
    return out


def place(df: DataFrame, key: str, tree: ShardTree, out: str = "shard") -> DataFrame:
    """``df`` with the number of the shard of each row, which the key and the tree
    decide; equal keys share a shard, and so do all null keys."""
    k, w = F.col(key), tree.weights
    region = _least(k, [f"{r}" for r in range(len(w))], [sum(map(sum, x)) for x in w])
    df = df.withColumn("__region", region)
    rack = _choose(
        F.col("__region.child"),
        [_least(k, [f"{r}/{q}" for q in range(len(x))], [sum(y) for y in x])["child"] for r, x in enumerate(w)],
    )
    df = df.withColumn("__rack", rack)
    base, regions = 0, []
    for r, x in enumerate(w):
        racks = []
        for q, y in enumerate(x):
            racks.append(_least(k, [f"{r}/{q}/{s}" for s in range(len(y))], y)["child"] + F.lit(base))
            base += len(y)
        regions.append(_choose(F.col("__rack"), racks))
    df = df.withColumn(out, _choose(F.col("__region.child"), regions))
    if tree.added:
        late = _least(k, [f"+{i}" for i in range(len(tree.added))], tree.added)
        df = df.withColumn("__late", late).withColumn(
            out,
            F.when(F.col("__late.draw") < F.col("__region.draw"), F.col("__late.child") + tree.founding).otherwise(
                F.col(out)
            ),
        ).drop("__late")
    return df.drop("__region", "__rack")


def shard(docs: DataFrame, tree: ShardTree = TREE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus 16. The doc_id and the tree
    decide the shard, so repeated doc_ids share one and null doc_ids share
    another; equal texts follow their doc_ids. slot is gapless from 0 in each
    shard, in an order by a hash of doc_id and text, then both; it is counted by
    (shard, hash slice), so that no shard is sorted in one task, nor the rows of
    one doc_id. Rows equal in both are interchangeable. Other columns are ignored;
    an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(1).alias("__one"),
    ).withColumn("__slice", F.expr("pmod(xxhash64(doc_id, text_crc32, size), 256)"))
    placed = place(rows, "doc_id", tree)
    order = ["doc_id", "text_crc32", "size"]
    return sum_before(placed, ["shard"], "__slice", order, "__one", "slot").drop("__slice", "__one")


def op6_shard(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all documents:
    see ``shard`` for nulls, empty texts, ties and repeated rows."""
    placed = place(shard(docs, TREE), "doc_id", ShardTree(TREE.weights, [1.0]), "grown_shard")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
