"""Nearest children by bounds against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorikeet.operators import similarity as N
from lorikeet.operators.similarity import similar_children

NAMES = ["a", "b", "c", "d"]


def brute(rows, targets, k):
    out = set()
    for i, x in rows:
        if i not in targets:
            continue
        scored = []
        for j, y in rows:
            if i != j:
                norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
                scored.append((-round(sum(p * q for p, q in zip(x, y)) / norm, 9) if norm else 5, j))
        out |= {(i, rank, j, None if s == 5 else -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)}
    return out


def made(seed, n):
    """Clusters, a third of equal vectors, multiples of one another, and zeros."""
    rng, rows = random.Random(seed), []
    centres = [[rng.gauss(0, 1) for _ in NAMES] for _ in range(12)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            x = [3.0, 1.0, 0.0, 2.0]
        elif kind < 0.4:
            x = [rng.choice([2, 5, 8]) * v for v in (1.0, 0.25, 4.0, -1.0)]
        elif kind < 0.43:
            x = [0.0] * 4
        else:
            x = [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]
        rows.append((7 * i % 1009, x))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *x) for i, x in rows], "child_id long, a double, b double, c double, d double").repartition(3)


@pytest.mark.parametrize(("seed", "n", "k", "pivots", "slice_rows"), [(1, 300, 5, 16, 16), (2, 120, 3, 2, 1), (3, 6, 5, 16, 256), (4, 200, 1, 1, 7)])
def test_equals_all_pairs_for_every_child(spark, seed, n, k, pivots, slice_rows):
    rows = made(seed, n)
    got = similar_children(frame(spark, rows), None, k, NAMES, pivots, slice_rows).collect()
    assert len(got) == n * min(k, n - 1)
    assert {tuple(r) for r in got} == brute(rows, {i for i, _ in rows}, k)


def test_targets_nulls_and_empty_tables(spark):
    rows = made(5, 150)
    targets = {i for i, _ in rows if i % 10 == 0}
    asked = spark.createDataFrame([(i,) for i in targets], "child_id long")
    df = frame(spark, rows)
    assert {tuple(r) for r in similar_children(df, asked, 4, NAMES, 8, 10).collect()} == brute(rows, targets, 4)
    holes = df.withColumn("b", F.when(F.col("child_id") % 3 > 0, F.col("b")))
    filled = [(i, [x[0], x[1] if i % 3 > 0 else 0.0, *x[2:]]) for i, x in rows]
    assert {tuple(r) for r in similar_children(holes, asked, 4, NAMES, 8, 10).collect()} == brute(filled, targets, 4)
    assert similar_children(df.limit(0), None, 4, NAMES).count() == 0
    one = similar_children(df.limit(1), None, 4, NAMES)
    assert one.count() == 0


def test_few_slices_are_compared(spark):
    """In three dimensions and 40 clusters, most pairs are ruled out by bounds."""
    rng = random.Random(6)
    rows = []
    for i in range(2000):
        if i % 50 == 0:
            centre = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, *[c + rng.gauss(0, 0.01) for c in centre]))
    names = NAMES[:3]
    df = spark.createDataFrame(rows, "child_id long, a double, b double, c double")
    placed = N.sliced(N.classes_of(df, 5, names), names, 16, 32).withColumn("floor", F.lit(-2.0))
    members = placed.select("cell", "slice", "class", "ids", "norm", *names)
    same = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.slice") == F.col("b.slice"))
    own = N._best(N._scored(placed, members, same, names), 6)
    more = N.slices_to_compare(placed, placed, own, 16, 5)
    sizes = placed.groupBy(F.col("cell").alias("to_cell"), F.col("slice").alias("to_slice")).agg(F.count("*").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 32
    pairs = more.drop("n").join(sizes, ["to_cell", "to_slice"]).agg(F.sum("n")).first()[0]
    share = (pairs + 2000 * 32) / 2000**2
    print("share of pairs compared", share)
    assert share < 0.2


def met_by_each(spark, n):
    """How many classes each is compared with, of ``n`` made roll-ups: two counts,
    and small parts beside them, so that all lie near one arc of the sphere."""
    rng, names = random.Random(7), [*NAMES, "e"]
    made_ = [(i, float(rng.randint(5, 40)), float(rng.randint(5, 40)), rng.random(), rng.random(), float(rng.randint(1, 6))) for i in range(n)]
    df = spark.createDataFrame(made_, "child_id long, a double, b double, c double, d double, e double")
    placed = N.sliced(N.classes_of(df, 5, names), names, 16, 32).withColumn("floor", F.lit(-2.0)).cache()
    members = placed.select("cell", "slice", "class", "ids", "norm", *names)
    same = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.slice") == F.col("b.slice"))
    own = N._best(N._scored(placed, members, same, names), 6).cache()
    more = N.slices_to_compare(placed, placed, own, 16, 5)
    sizes = placed.groupBy(F.col("cell").alias("to_cell"), F.col("slice").alias("to_slice")).agg(F.count("*").alias("n"))
    return more.drop("n").join(sizes, ["to_cell", "to_slice"]).agg(F.sum("n")).first()[0] / n


def test_few_classes_are_met_along_an_arc(spark):
    """Rings around far pivots would leave 302 of 6000 to be compared."""
    met = met_by_each(spark, 6000)
    print("classes met by each of 6000", met)
    assert met < 150


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    x = [0.1234567885, 0.9999999995, -0.1234567885, 0.5, -1e-12, 1.0, 0.12345678949999, 0.0000000005]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert N._rounded(np.array(x)).tolist() == want
