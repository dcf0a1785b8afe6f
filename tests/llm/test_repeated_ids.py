"""Operators on ids that repeat, are null, or are too large for a double."""

import hashlib
import random

import numpy as np
import pytest

from lorikeet.llm import embedding_dedup, multiset_hash, simhash


def row_components(rows, linked):
    """The least id (null last) of what each row reaches, by all pairs of rows."""
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a], rows[b]):
                root[top(a)] = top(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[top(i)] = min(least.get(top(i), row[0]), row[0])
    return [least.get(top(i)) for i in range(len(rows))]


def test_op1_rows_link_whatever_their_ids(spark):
    near = lambda k: " ".join(f"w{i}" for i in range(3000)) + f" end{k}"
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "e f g h"), (9, "e f g h"), (None, near(0)), (None, near(1)), (8, near(2)), (7, "x y z"), (None, "q r"), (3, "e f g h")]
    got = simhash.op1_simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [(d, simhash.simhash(t, 4) % (1 << 64)) for d, t in rows]
    want = row_components(prints, lambda a, b: bin(a[1] ^ b[1]).count("1") <= 4)
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in got), key=repr) == sorted(((*p, c) for p, c in zip(prints, want)), key=repr)
    assert {r[2] for r in got if r[0] is None} == {8, None}


@pytest.mark.parametrize("tile", [2048, 3])
def test_op8_counts_rows_whatever_their_ids(spark, tile):
    rng = random.Random(3)
    rows = [(3, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [0.0, 1.0]), (5, [0.001, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.001])]
    rows += [(None, [-1.0, 0.0]), (2, [-1.0, 0.01]), (None, [0.0, 0.0]), (None, None)]
    rows += [(rng.choice([None, 1, 11, 12, 13]), [rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(40)]
    rows += [rows[11], rows[20], (-4, rows[30][1])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, label int")

    def linked(a, b):
        if not (a[1] and b[1] and any(a[1]) and any(b[1])):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98

    links = [sum(linked(a, b) for j, b in enumerate(rows) if i != j) for i, a in enumerate(rows)]
    parts = row_components(rows, linked)
    want = [(r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, parts)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [2, 20_000])
def test_op4_orders_exact_integers(spark, rows):
    ids = [*range(1 << 60, (1 << 60) + 60), *range(-(1 << 62), -(1 << 62) + 20), -(1 << 63), (1 << 63) - 1, 0, 7, -1, 1 << 53, (1 << 53) + 1]
    texts = {i: f"text of {i}\n" + "words " * (i % 5) for i in ids}
    mixed = random.Random(5).sample(ids, len(ids))
    docs = spark.createDataFrame([(i, texts[i]) for i in mixed], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["edited_sha256"] for r in multiset_hash.op4_fingerprint(docs, range_rows=rows).collect()}
    order = sorted(ids, reverse=True)
    for i, follows in zip(order, order[1:] + order[:1]):
        t, k = texts[i], len(texts[i]) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - k] + texts[follows][:k]).encode()).hexdigest()


def test_op4_crowded_ids_among_large_ones(spark):
    """One id holds a third of the rows; the others lie within one double of it."""
    at = 1 << 60
    rows = [(at + i, f"t{i}") for i in range(100)] + [(at + 50, f"copy {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = {}
    for r in multiset_hash._ranged(docs, 3).select("doc_id", "__range").collect():
        ranges.setdefault(r[0], set()).add(r[1])
    order = sorted(ranges, reverse=True)
    assert all(max(ranges[a]) <= min(ranges[b]) for a, b in zip(order, order[1:]))
    assert len(ranges[at + 50]) > 5
    assert len({min(v) for v in ranges.values()}) > 20
