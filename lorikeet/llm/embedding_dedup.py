"""Embedding near-duplicates by int8-quantised tile products.

Vectors of a label are split into parts by hash and compared part against part
in tiles. In a tile, unit vectors are quantised to 8-bit integers with a scale
each, and their products are taken as one matrix product. What quantising takes
off a vector is known exactly, so each pair has a rigorous bound on the error of
its product; only pairs that may reach the threshold are computed again in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.common import written, written_alone
from lorikeet.llm.graph import connected_components
from lorikeet.llm.simhash import _Forest

#: Cosine from which two vectors link.
THRESHOLD = 0.98
#: Distinct vectors of a label on each side of a tile.
TILE = 2048
#: Rows of a tile whose products are held at once.
_BLOCK = 512
#: Above the rounding of sums of a few thousand double products of unit vectors.
_SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers, scale, norm of what they stand for, norm of what they lose)."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(unit - stands, axis=1)


def tile_links(vectors: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Index arrays (i, j) of the pairs of ``first`` x ``second`` with cosine at
    or above the threshold, block after block; finite non-zero double vectors."""
    peak = np.abs(vectors).max(axis=1)
    scaled = vectors / peak[:, None]
    norms = np.linalg.norm(scaled, axis=1)
    unit = scaled / norms[:, None]
    codes, scale, stands, lost = quantise(unit)
    # 8-bit products of up to 1,000 components are exact in single precision
    kind = np.float32 if vectors.shape[1] <= 1000 else np.float64
    right = codes[second].astype(kind)
    for lo in range(0, len(first), _BLOCK):
        rows = first[lo : lo + _BLOCK]
        product = (codes[rows].astype(kind) @ right.T).astype(np.float64) * scale[rows, None] * scale[second]
        error = lost[rows, None] * (stands[second] + lost[second]) + stands[rows, None] * lost[second]
        a, b = np.nonzero(product + error + _SLACK >= threshold)
        i, j = rows[a], second[b]
        exact = np.einsum("ij,ij->i", scaled[i], scaled[j]) / (norms[i] * norms[j])
        yield i[exact >= threshold], j[exact >= threshold]


_FOUND = "node long, no_id boolean, least long, links long, parent long, parent_no_id boolean, parent_least long"


def _tile(threshold: float):
    """One tile: a row for each vector with links, where links weighs a neighbour
    by its copies and parent joins the tile's components."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(rows["embedding"].tolist(), np.float64)
        node, copies, part = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["part"].to_numpy()
        no_id = rows["no_id"].to_numpy(bool)
        least = rows["least"].to_numpy()
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))
        for a, b in tile_links(vectors, first, second, threshold):
            if i == j:
                a, b = a[a < b], b[a < b]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.unite(a, b)
        found = np.flatnonzero(links)
        root = forest.root[found]
        return pd.DataFrame({
            "node": node[found], "no_id": no_id[found], "least": least[found], "links": links[found],
            "parent": node[root], "parent_no_id": no_id[root], "parent_least": least[root],
        })

    return each


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``
    (vec_id, embedding, label, ...).

    Only vectors of one label and length are compared, by cosine in double
    precision. A null label, and a vector that is null, empty, zero or holds a
    null or a component that isn't finite, links with nothing. Equal vectors of a
    label are one class from the start with its copies counted, so a class of any
    size adds one row to the tiles. n_links counts other rows; component_id is
    the smallest vec_id reachable, kept marks it. Rows are what links, not
    vec_ids: rows that share a vec_id or have none are as any others; component_id
    is null, and kept true, where no vector of a component has one. Labels without
    a pair, and empty tables, give no tile. Other columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").alias("label")
    )
    usable = F.expr(
        "label IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)"
        " AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    )
    # null when not usable: such rows join with nothing below
    form = F.md5(F.concat_ws(",", F.size("embedding"), F.col("label"), F.col("embedding").cast("string")))
    keyed = rows.withColumn("form", F.when(F.coalesce(usable, F.lit(False)), form))
    def classed() -> DataFrame:
        # written once: sizes, tiles and the result all read it
        classes = (
            keyed.where("form IS NOT NULL")
            .groupBy("form")
            .agg(
                F.min("vec_id").isNull().alias("no_id"),
                F.coalesce(F.min("vec_id"), F.lit(0)).alias("least"),
                F.count("*").alias("copies"),
                F.first("embedding").alias("embedding"),
                F.first("label").alias("label"),
            )
        )
        # numbered once, when written: classes may share their least vec_id
        classes = classes.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()})
        classes = written(classes, "vectors")
        sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
        sizes = written(sizes, "labels")  # so that its size is known when the join is planned
        parted = classes.join(sizes, ["label", "dim"]).withColumn(
            "part", F.expr("cast(pmod(xxhash64(form), parts) as int)")
        )
        tiles = parted.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")).select(
            "label", "dim", "node", "no_id", "least", "copies", "embedding", "part", F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
        )
        found = written(
            tiles.groupBy("label", "dim", "i", "j").applyInPandas(_tile(threshold), _FOUND), "tiles"
        )
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        # ordered by vec_id, so that a component's least node names its least vec_id
        ends = found.where("node <> parent").select(
            F.struct("no_id", "least", "node").alias("a"),
            F.struct(F.col("parent_no_id").alias("no_id"), F.col("parent_least").alias("least"), F.col("parent").alias("node")).alias("b"),
        )
        parts = connected_components(ends).select(
            F.col("node.node").alias("part"), F.when(~F.col("component.no_id"), F.col("component.least")).alias("component")
        )
        return (
            classes.select("form", "node", F.when(~F.col("no_id"), F.col("least")).alias("rep"), "copies")
            .join(links, "node", "left")
            .join(parts, F.col("node") == F.col("part"), "left")
            .select("form", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
        )

    known = written_alone(vectors.sparkSession, "classes", classed)
    out = keyed.drop("label", "embedding").join(known, "form", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op8_embeddings(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors: see ``near_duplicates``
    for nulls, vectors that don't count, copies and repeated rows."""
    return near_duplicates(vectors)


OP8_SQL = """
WITH RECURSIVE every AS (
  SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), v AS (
  SELECT * FROM every
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
), l AS (
  SELECT a.row AS a, b.row AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r(row, reached) AS (
  SELECT row, row FROM every UNION SELECT r.row, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
  SELECT r.row, min(e.vec_id) AS component_id FROM r JOIN every e ON e.row = r.reached GROUP BY r.row
)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM every JOIN c USING (row) LEFT JOIN (SELECT a AS row, count(*) AS k FROM l GROUP BY a) USING (row)
"""
