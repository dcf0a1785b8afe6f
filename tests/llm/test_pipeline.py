"""The corpus pipeline, stage by stage, against plain versions of each."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorikeet.llm import packing, pii, toxicity
from lorikeet.llm.common import read
from tests.llm.test_llm_operators import alike, components, shingle_set


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        out.append(docs.collect())
    return out


def test_stages_by_brute_force(spark, sf_dir, stages):
    docs, clean, single, private, mixed, packed = stages
    columns = read(spark, sf_dir, "documents").columns
    assert all(list(r.asDict()) == columns for rows in stages[:-1] for r in rows)

    machine = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

    def score(text):
        at = {b for w in set(toxicity._words(text.lower())) for b in toxicity.buckets_of(w)}
        return machine.score(np.array(sorted(at), int))

    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in docs if score(r["text"]) < toxicity.CUT}

    sets = {r["doc_id"]: shingle_set(r["text"]) for r in clean}
    want = components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    assert {r["doc_id"] for r in single} == {i for i, c in want.items() if i == c}
    assert len(single) < len(clean)

    names = pii.Pseudonyms(pii.key_of(spark))
    assert {r["doc_id"]: r["text"] for r in private} == {r["doc_id"]: names.mask(r["text"])[0] for r in single}

    size = {r["doc_id"]: len(r["text"].split()) for r in private}
    taken = collections.Counter()
    for r in mixed:
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(sum(size.values()), abs=len({r["source"] for r in private}))

    words = packing.WordTokenizer(packing.default_tokenizer())
    want = collections.Counter()
    for r, ids in zip(mixed, words.encode_all([r["text"] for r in mixed])):
        ids += (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            want[r["doc_id"], k, zlib.crc32(ids[a : a + 4 * 4096])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want
    bins = collections.Counter()
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 1


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[-1])


#: Names that operators use, or could use, for columns of their own.
CLASHING = (
    "score", "n_replaced", "size", "source_size", "target", "taken", "row", "comp", "rep", "keys", "sketch", "bands", "same", "p", "q", "slice",
    "key", "cut", "skey", "before", "rest", "epochs", "y", "at", "component_id", "node", "length", "piece", "u", "v", "n",
)


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 9000, "en", None, 18000), (4, "mail ab.c@d.org now", "en", "s", 19)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = list(CLASHING)
    docs = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clashing])
    ends = {}
    for keep, start in (("clashing", docs), ("plain", plain), ("empty", docs.limit(0))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf_dir)
            assert name == "packing" or out.columns == start.columns
            now = spark.createDataFrame(out.collect(), out.schema)
            if keep == "clashing" and name != "packing":  # a row keeps the values that it came with
                assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in now.collect() for c in clashing)
            if keep == "clashing" and name == "pii":
                texts = {r["doc_id"]: r["text"] for r in now.collect()}
                assert set(texts) == {1, None, 3, 4} and texts[4] != rows[5][1] and texts[4].endswith("@d.org now") and texts[3] == rows[4][1]
        ends[keep] = collections.Counter((r["doc_id"], r["piece"], r["length"]) for r in now.collect())
    assert ends["clashing"] == ends["plain"] and not ends["empty"]
