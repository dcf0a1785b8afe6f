"""What the pipeline's stages leave in Python workers, which they share."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lorikeet.llm import common, packing, toxicity


def test_fit_takes_little_beside_its_rows():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(60_000, 500, replace=False)).astype(np.int32) for _ in range(4000)]
    y = np.arange(4000) % 2
    tracemalloc.start()
    made = toxicity.fit(sets, y, 0.5, n=60_000, steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * sum(s.nbytes for s in sets)  # ten times and more with wide copies of all rows
    wide = toxicity.fit([s.astype(np.int64) for s in sets], y, 0.5, n=60_000, steps=1)
    assert made.bias == wide.bias and (made.w == wide.w).all() and (made.v == wide.v).all()


def test_rows_are_learnt_from_in_order():
    at = pa.chunked_array([[[5], []], [], [[1, 2, 3]]], pa.list_(pa.int32()))
    sets, y = toxicity._in_order(pa.table({"doc_id": [9, 2, 4], "y": [0, 1, 1], "at": at}))
    assert [s.tolist() for s in sets] == [[], [1, 2, 3], [5]] and y.tolist() == [1, 1, 0]


def test_other_operators_tasks_drop_the_tokenizer():
    held = packing._tokenizer(packing.default_tokenizer(), 10)
    assert list(common.frugal(iter, packing._forget)([1, 2])) == [1, 2]
    assert packing._tokenizer(packing.default_tokenizer(), 10) is held
    assert list(common.frugal(iter)([1, 2])) == [1, 2]
    assert packing._tokenizer.cache_info().currsize == 0


def test_slots_start_no_python_worker(spark):
    pieces = spark.range(50).selectExpr("id AS doc_id", "0 AS piece", "100 + id AS length")
    packed = packing.pack(pieces)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    ends = {}
    for r in packed.collect():
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(map(len, ends.values())) == 50 and packing.pack(pieces.limit(0)).count() == 0
