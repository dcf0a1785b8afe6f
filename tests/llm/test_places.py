"""Shards by a plain walk of the tree; archives of pages without ids."""

import hashlib
import math
import random
import struct

from lorikeet.llm import sharding, warc


def draw(key, name, weight):
    """-ln(u) / weight with u from the upper 53 bits of Spark's hash of key and name."""
    from xxhash import xxh64_intdigest

    h = 42 if key is None else xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxh64_intdigest(name.encode(), h)
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def slow_place(key, tree):
    """The child with the least draw, level by level; a later shard if its draw is less than the region's."""
    w = tree.weights
    regions = [draw(key, f"{r}", sum(map(sum, x))) for r, x in enumerate(w)]
    r = min(range(len(w)), key=regions.__getitem__)
    q = min(range(len(w[r])), key=lambda i: draw(key, f"{r}/{i}", sum(w[r][i])))
    s = min(range(len(w[r][q])), key=lambda i: draw(key, f"{r}/{q}/{i}", w[r][q][i]))
    found = sum(len(y) for x in w[:r] for y in x) + sum(map(len, w[r][:q])) + s
    late = [draw(key, f"+{i}", x) for i, x in enumerate(tree.added)]
    if late and min(late) < regions[r]:
        return tree.founding + late.index(min(late))
    return found


def test_shards_are_those_of_a_plain_walk(spark):
    rng = random.Random(2)
    keys = [None, 0, -1, (1 << 63) - 1, -(1 << 63)] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(800)] + list(range(200))
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    uneven = sharding.ShardTree([[[1.0, 3.0], [2.0]], [[0.5]], [[1.0] * 3, [4.0, 4.0]]], [2.0, 0.25])
    for tree in (sharding.TREE, sharding.ShardTree(sharding.TREE.weights, [1.0]), uneven):
        got = [(r["doc_id"], r["shard"]) for r in sharding.place(df, "doc_id", tree).collect()]
        assert sorted(got, key=repr) == sorted(((k, slow_place(k, tree)) for k in keys), key=repr)


def test_op6_takes_the_shards_of_the_tree(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(300)] + [(None, None)], "doc_id long, text string")
    grown = sharding.ShardTree(sharding.TREE.weights, [1.0])
    for r in sharding.op6_shard(docs).collect():
        assert r["shard"] == slow_place(r["doc_id"], sharding.TREE) and r["grown_shard"] == slow_place(r["doc_id"], grown)


def test_op9_pages_without_ids(spark):
    long, short = "x" * 1500, "y"
    pages = [(1, "http://a.org/", long), (None, "http://a.org/", long), (7, None, long), (None, "http://b.org/", short), (None, None, None), (3, "http://c.org/", short)]
    lonely = "z" * 2000
    pages += [(None, "http://d.org/", lonely), (None, "http://d.org/2", lonely)]
    got = warc.op9_warc(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((len(t or ""), digest(t)) for _, _, t in pages)
    of = lambda t: sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest(t)), key=repr)
    assert (7, "response", None) in of(long) and (1, "revisit", 7) in of(long) and len(of(long)) == 3
    assert of(short) == [(3, "response", None), (None, "response", None)] and of(None) == [(None, "response", None)]
    assert [k for _, k, _ in of(lonely)].count("response") >= 1
