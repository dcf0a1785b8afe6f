"""Nearest children by cosine of their skill vectors (C-02, J-13).

Children with equal vectors are one class, of which the first ids suffice. Classes
lie on the unit sphere and are cut into compact slices by a k-d tree, each with the
box of its members. A slice whose box is farther from a class than the k-th best of
its own slice can't hold a better neighbour, and is never compared with it; a class
finds the others by a descent through boxes of boxes. So a class meets a few slices
of bounded size, however many there are.
"""

from __future__ import annotations

import decimal
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.operators.ranking import numbered
from lorikeet.session import kept

VECTOR = ("verbal_attempts", "selection_attempts", "verbal_rate", "selection_rate", "avg_score", "n_categories")
#: Sampled vectors for each cell, by which cells are cut, and classes of a slice.
PIVOTS, SLICE = 16, 1024
#: A tree has at most 2 to this power cells, so that its cuts and boxes stay small.
_DEPTH = 13
#: Above the rounding of squared distances, and of similarities to nine places.
_SLACK, _UNIT = 2e-9, 1e-9


def _sum_of_products(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def _columns(side: str, names: Sequence[str]) -> list[Column]:
    return [F.col(f"{side}.{n}") for n in names]


def _least_ids(rows: DataFrame, n: int) -> DataFrame:
    """One row: the ``n`` least child_ids."""
    return rows.select("child_id").orderBy("child_id").limit(n).agg(F.array_sort(F.collect_list("child_id")).alias("ids"))


def classes_of(vectors: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """(class, ids, norm, *names): distinct vectors with their ``k`` + 1 least ids,
    of which the first names the class."""
    order = Window.partitionBy(*names).orderBy("child_id")
    least = vectors.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1)
    found = least.groupBy(*names).agg(F.array_sort(F.collect_list("child_id")).alias("ids"))
    cols = [F.col(n) for n in names]
    return found.select(F.element_at("ids", 1).alias("class"), "ids", F.sqrt(_sum_of_products(cols, cols)).alias("norm"), *names)


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of the inner nodes of a k-d tree, level by level: each cuts its
    part of the sample in halves along the axis in which it is widest."""
    axis, value = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    parts = [sample]
    for node in range(2**depth - 1):
        part = parts[node]
        if len(part):
            axis[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
            value[node] = np.median(part[:, axis[node]])
        low = part[:, axis[node]] <= value[node]
        parts += [part[low], part[~low]]
    return axis, value


def sliced(classes: DataFrame, names: Sequence[str], pivots: int = PIVOTS, slice_rows: int = SLICE) -> DataFrame:
    """Classes that aren't zero with their place on the sphere (unit), their cell, a
    leaf of a k-d tree, and their slice: the cell, or where it has more than
    ``slice_rows`` classes, even parts of it. The tree is cut by a few vectors by
    hash for each cell; which they are decides how even cells are, not what is found."""
    some = classes.where("norm > 0").withColumn("unit", F.array(*[F.col(n) / F.col("norm") for n in names]))
    n = some.count()
    depth = min(_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) * 1.6 / slice_rows)))))
    step = max(1, n // (pivots << depth))
    sample = some.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).select(*[F.col("unit")[i].alias(f"u{i}") for i in range(len(names))])
    table = sample.toArrow()
    axis, value = _cuts(np.column_stack([c.to_numpy() for c in table.columns]) if table.num_rows else np.zeros((0, len(names))), depth)

    @F.pandas_udf("int")
    def leaf(unit: pd.Series) -> pd.Series:
        u, at = np.stack(unit.to_numpy()) if len(unit) else np.zeros((0, len(names))), np.zeros(len(unit), dtype=np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (u[np.arange(len(u)), axis[at]] > value[at])
        return pd.Series(at - (2**depth - 1))

    rows = some.withColumn("cell", leaf("unit"))
    rows = numbered(rows, ["cell"], F.floor(F.col("unit")[0] * 1024), ["class"])
    sizes = rows.groupBy("cell").agg(F.count("*").alias("__size"))
    parts = F.ceil(F.col("__size") / slice_rows)
    return rows.join(sizes, "cell").withColumn("slice", F.floor((F.col("place") - 1) * parts / F.col("__size")).cast("int")).drop("place", "__size")


class _Boxes:
    """The boxes of slices, in the order of the tree, under boxes of ``fan`` boxes each."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, most: np.ndarray, fan: int):
        self.ids, self.fan, self.levels = ids, max(fan, 2), [(least, most)]
        while len(least) > self.fan:
            starts = np.arange(0, len(least), self.fan)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((least, most))

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point the slices whose boxes are within the squared distance
        ``reach``: (number of the point, id of the slice)."""
        n = len(self.levels[-1][0])
        point, box = np.repeat(np.arange(len(points)), n), np.tile(np.arange(n), len(points))
        for level in reversed(range(len(self.levels))):
            least, most = self.levels[level]
            gap = np.maximum(np.maximum(least[box] - points[point], points[point] - most[box]), 0.0)
            near = (gap * gap).sum(axis=1) <= reach[point]
            point, box = point[near], box[near]
            if level:
                below = len(self.levels[level - 1][0])
                box = (box[:, None] * self.fan + np.arange(self.fan)).ravel()
                point = np.repeat(point, self.fan)[box < below]
                box = box[box < below]
        return point, self.ids[box]


def _boxes_of(rows: DataFrame, fan: int) -> _Boxes:
    """A bounded number of slices: their boxes fit every task."""
    ends = rows.select("cell", "slice", F.posexplode("unit").alias("axis", "u")).groupBy("cell", "slice", "axis")
    found = ends.agg(F.min("u").alias("least"), F.max("u").alias("most")).toPandas().sort_values(["cell", "slice", "axis"])
    n = int(found["axis"].max()) + 1 if len(found) else 1
    ids = (found["cell"].to_numpy(dtype=np.int64)[::n] << 32) + found["slice"].to_numpy(dtype=np.int64)[::n]
    return _Boxes(ids, found["least"].to_numpy().reshape(-1, n), found["most"].to_numpy().reshape(-1, n), fan)


def _scored(asked: DataFrame, members: DataFrame, on: Column, names: Sequence[str]) -> DataFrame:
    """(class, ids, similarity, floor) for all members met: every pair, the plain way."""
    cosine = _sum_of_products(_columns("a", names), _columns("b", names)) / F.nullif(F.col("a.norm") * F.col("b.norm"), F.lit(0.0))
    pairs = asked.alias("a").join(members.alias("b"), on)
    return pairs.select(F.col("a.class").alias("class"), F.col("b.ids").alias("ids"), F.round(cosine, 9).alias("similarity"), F.col("a.floor").alias("floor"))


def _best(pairs: DataFrame, n: int) -> DataFrame:
    """Of each class the ``n`` ids of highest similarity, ties by id."""
    flat = pairs.where("similarity >= floor").select("class", "similarity", F.explode("ids").alias("id"))
    order = Window.partitionBy("class").orderBy(F.desc("similarity"), "id")
    return flat.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine places as ``F.round``: half up by the shortest decimal form."""
    y = np.abs(x) * 1e9
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5):
        out[i] = float(decimal.Decimal(repr(abs(float(x[i])))).scaleb(9).to_integral_value(decimal.ROUND_HALF_UP))
    return np.copysign(out / 1e9, x) + 0.0


def _nearest_in(asked: DataFrame, members: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    """(class, id, similarity): of each asked class the ``n`` best ids, ties by id, of
    the slice (to_cell, to_slice) that it is to be compared with, of those not under
    its floor. A slice and what asks for it meet in one task, some rows at a time."""
    names = list(names)

    def found(asks: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        out = {"class": [], "id": [], "similarity": []}
        if len(asks) and len(slice_):
            b, norms = slice_[[f"of_{c}" for c in names]].to_numpy(dtype=float), slice_["of_norm"].to_numpy()
            lists = [np.asarray(x) for x in slice_["of_ids"]]
            ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
            starts, units = np.cumsum(sizes) - sizes, b / norms[:, None]
            for at in range(0, len(asks), 512):
                part = asks.iloc[at : at + 512]
                a, norm, floor = part[names].to_numpy(dtype=float), part["norm"].to_numpy(), part["floor"].to_numpy()
                near = (a / norm[:, None]) @ units.T
                enough = floor - 2 * _UNIT
                if (floor < -1).any():
                    k = min(n, len(b))
                    enough = np.maximum(enough, np.partition(near, len(b) - k, axis=1)[:, len(b) - k] - 2 * _UNIT)
                i, j = np.nonzero(near >= enough[:, None])
                # as the SQL adds them, in the order of the names
                dot = a[i, 0] * b[j, 0]
                for c in range(1, len(names)):
                    dot = dot + a[i, c] * b[j, c]
                score = _rounded(dot / (norm[i] * norms[j]))
                fit = score >= floor[i]
                i, j, score = i[fit], j[fit], score[fit]
                times = sizes[j]
                i, score = np.repeat(i, times), np.repeat(score, times)
                flat = ids[np.repeat(starts[j] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                order = np.lexsort((flat, -score, i))
                i, score, flat = i[order], score[order], flat[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < n
                out["class"].append(part["class"].to_numpy()[i[best]])
                out["id"].append(flat[best])
                out["similarity"].append(score[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    type_ = members.schema["class"].dataType.simpleString()
    left = asked.select("to_cell", "to_slice", "class", "floor", "norm", *names).groupBy("to_cell", "to_slice")
    # both come of the same table, so one side's columns are renamed
    right = members.select(*[F.col(c).alias(f"of_{c}") for c in ("cell", "slice", "ids", "norm", *names)]).groupBy("of_cell", "of_slice")
    return left.cogroup(right).applyInPandas(found, f"class {type_}, id {type_}, similarity double")


def slices_to_compare(asked: DataFrame, rows: DataFrame, own: DataFrame, n: int, k: int) -> DataFrame:
    """``asked`` classes beside each other slice that their k-th best by ``own``
    slice doesn't rule out, by boxes of ``n`` boxes each."""
    worst = own.groupBy("class").agg(F.count("*").alias("n"), F.min("similarity").alias("worst"))
    floor = F.when(F.col("n") > k, F.col("worst")).otherwise(F.lit(-2.0))
    known = asked.drop("floor", "ids").join(worst, "class").withColumn("floor", floor).drop("worst")
    boxes = _boxes_of(rows, n)

    @F.pandas_udf("array<bigint>")
    def near(unit: pd.Series, floor: pd.Series, own_id: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(unit), 2048):  # so that points beside boxes stay small
            points, ids = np.stack(unit.to_numpy()[at : at + 2048]), own_id.to_numpy()[at : at + 2048]
            # of unit vectors the squared distance is 2 - 2 cos
            point, met = boxes.within(points, 2 - 2 * (floor.to_numpy()[at : at + 2048] - _UNIT) + _SLACK)
            point, met = point[met != ids[point]], met[met != ids[point]]
            order = np.argsort(point, kind="stable")
            out += np.split(met[order], np.searchsorted(point[order], np.arange(1, len(points))))
        return pd.Series(out, dtype=object)

    own_id = F.shiftleft(F.col("cell").cast("long"), 32) + F.col("slice")
    met = known.withColumn("to", F.explode(near("unit", "floor", own_id))).drop("unit")
    return met.withColumns({"to_cell": F.shiftright("to", 32).cast("int"), "to_slice": F.col("to").bitwiseAND(F.lit(2**32 - 1)).cast("int")}).drop("to")


def similar_children(
    vectors: DataFrame, targets: DataFrame | None = None, k: int = 5, names: Sequence[str] = VECTOR, pivots: int = PIVOTS, slice_rows: int = SLICE
) -> DataFrame:
    """(child_id, rank, similar_id, similarity): of each child in ``targets``
    (child_id), or of every child, the ``k`` others with the highest cosine; ties
    by id, undefined similarities (a zero vector) last. ``vectors`` has one row a
    child; null components count as zero. Vectors, classes and the best of each own
    slice are written to the shared folder first, since they are used several times."""
    rows = vectors.select("child_id", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    rows = kept(rows, "vectors")
    classes = kept(classes_of(rows, k, names), "classes")
    placed = kept(sliced(classes, names, pivots, slice_rows).withColumn("floor", F.lit(-2.0)), "slices")
    asked = placed
    if targets is not None:
        wanted = rows.join(targets.select("child_id"), "child_id", "left_semi")
        # equal doubles are equal bits here: -0.0 counts as 0.0 in both
        asked = placed.join(wanted.select(*names).distinct(), list(names), "left_semi")
    else:
        wanted = rows
    members = placed.select("cell", "slice", "class", "ids", "norm", *names)
    there = asked.withColumns({"to_cell": F.col("cell"), "to_slice": F.col("slice")})
    own = kept(_nearest_in(there, members, k + 1, names), "own")
    others = _nearest_in(slices_to_compare(asked, placed, own, pivots, k), members, k + 1, names)
    both = own.unionByName(others).withColumns({"ids": F.array("id"), "floor": F.lit(-2.0)})
    best = _best(both.select("class", "ids", "similarity", "floor"), k + 1)
    best = best.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("id"), "similarity"))).alias("best"))
    best = best.join(classes.select("class", *names), "class").drop("class")
    # a zero vector is like none: the least ids stand for all children, and behind all others
    zero = F.lit(True)
    for n in names:
        zero = zero & (F.col(n) == 0)
    unlike = lambda ids: F.transform(ids, lambda i: F.struct(F.lit(None).cast("int").alias("place"), i.alias("id"), F.lit(None).cast("double").alias("similarity")))
    ends = _least_ids(rows, k + 1).select(F.col("ids").alias("all_ids")).join(_least_ids(rows.where(zero), k + 1).select(F.col("ids").alias("zero_ids")))
    found = wanted.join(best, list(names), "left").join(F.broadcast(ends))
    list_ = F.when(zero, unlike(F.col("all_ids"))).otherwise(F.concat("best", unlike(F.col("zero_ids"))))
    list_ = F.slice(F.filter(list_, lambda x: x["id"] != F.col("child_id")), 1, k)
    out = found.select("child_id", F.posexplode(list_).alias("at", "x"))
    return out.select("child_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("similar_id"), F.col("x.similarity").alias("similarity"))
