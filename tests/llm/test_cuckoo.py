"""The cuckoo index against sets and plain grouping."""

import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest

from lorikeet.llm import cuckoo
from lorikeet.llm.cuckoo import CuckooFilter, CuckooIndex, op12_exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept int"
normal = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
digest = lambda t: hashlib.sha256(normal(t).encode()).digest()


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], SCHEMA).repartition(3)


def groups(docs):
    """(doc_id, keep_id, group_size, digest) of each row, and one kept row a text."""
    members = {}
    for d, t in docs:
        members.setdefault(digest(t), []).append(d)
    keep = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(d, keep[digest(t)], len(members[digest(t)]), digest(t).hex()) for d, t in docs], Counter({k.hex(): 1 for k in members})


def check(got, docs):
    want, kept = groups(docs)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == sorted(want, key=repr)
    assert Counter(r[4] for r in got if r[3]) == kept
    assert all(r[0] == r[1] for r in got if r[3])


def test_filter_follows_a_set():
    draw, held, made = random.Random(1), set(), CuckooFilter(256)
    for step in range(4000):
        if held and draw.random() < 0.3:
            gone = draw.choice(sorted(held))
            held.discard(gone)
            assert made.delete(gone)
        elif len(held) < 850:
            new = hashlib.sha256(str(step).encode()).digest()
            held.add(new)
            assert made.insert(new)
    assert all(h in made for h in held)
    assert sum(t != 0 for t in made.table) == len(held)
    strangers = [hashlib.sha256(f"s{i}".encode()).digest() for i in range(20000)]
    assert sum(s in made for s in strangers) < 20


def test_filter_that_is_full_stays_as_it_was_and_grows_from_keys():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(100)]
    made, put = CuckooFilter(4), []
    for key in keys:
        before = made.table.tobytes()
        if not made.insert(key):
            assert made.table.tobytes() == before
            break
        put.append(key)
    assert 8 <= len(put) <= 16 and all(k in made for k in put)
    grown = CuckooFilter.holding(keys, 4)
    assert grown.buckets >= 32 and all(k in grown for k in keys)


DOCS = [
    (5, "a  b"), (3, "a\tb"), (3, "a b"), (9, "a\n\nb"), (None, "a b"), (None, None), (7, ""), (8, " "), (8, " \r\n"), (None, "only"),
    (None, "only"), (2, "x" * 100_000), (4, "x" * 100_000 + " "), (2, "x" * 100_000), (10, "a b"),
]


def test_equals_grouping(spark):
    check(op12_exact_dedup(frame(spark, DOCS)).collect(), DOCS)
    assert op12_exact_dedup(frame(spark, [])).count() == 0


def test_hot_text_and_false_hits(spark):
    """So many texts that some share a tag with another: none is lost."""
    docs = [(i, "hot") for i in range(20_000)] + [(i, f"text {i % 45_000}") for i in range(20_000, 70_000)]
    got = op12_exact_dedup(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    check(got, docs)


def entries(rows):
    return pd.DataFrame([(digest(t), False, i, 0, i, 1) for i, t in rows], columns=["digest", *cuckoo.KEEPER, "copies"])


def few_tags(monkeypatch):
    """Three tags, so that most hits are false."""
    places = lambda self, d: (1 + d[0] % 3, d[1] % self.buckets, d[1] % self.buckets ^ (1 + d[0] % 3))
    monkeypatch.setattr(CuckooFilter, "_places", places)
    monkeypatch.setattr(CuckooFilter, "_other", lambda self, tag, bucket: bucket ^ tag)


def test_hits_are_verified_within_an_insertion(monkeypatch):
    few_tags(monkeypatch)
    rows = [(i, f"t{i % 300}") for i in range(900)]
    out = cuckoo._pass((0,), pd.DataFrame(columns=["slice", "buckets", "table"]), entries(rows))
    new = out[out["kind"] == "new"]
    assert sorted(zip(new["digest"], new["copies"])) == sorted((digest(f"t{i}"), 3) for i in range(300))
    assert set(out["kind"]) == {"new", "filter"}
    table = memoryview(out[out["kind"] == "filter"]["table"].iloc[0]).cast("H")
    assert sum(t != 0 for t in table) == 300


def live(index):
    return {bytes(r["digest"]): (None if r["missing"] else r["doc_id"], r["copies"]) for r in index.live.collect()}


def state(docs):
    found = {}
    for d, t in docs:
        found.setdefault(digest(t), []).append(d)
    return {k: (min((d for d in v if d is not None), default=None), len(v)) for k, v in found.items()}


def test_insertions_and_deletions_in_batches(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        index = CuckooIndex.sized(spark, 10)
        first = [(i, f"text {i % 40}") for i in range(10, 100)]
        index, _ = index.insert(frame(spark, first))
        # more keys than the filters of the first insertion have room for
        second = DOCS + [(i, f"text {i % 10000}") for i in range(20, 9000)]
        index, rows = index.insert(frame(spark, second))
        assert live(index) == state(first + second)
        assert {r["buckets"] for r in index.filters.collect()} == {2048}
        got = index.decisions(rows).collect()
        assert len(got) == len(second)
        assert sum(r["kept"] for r in got) == len({digest(t) for _, t in second} - {digest(t) for _, t in first})
        gone = [(d, t) for d, t in first + second if d is not None and d % 3 == 0] + [(1, "never there"), (11, "text 12")]
        index = index.delete(frame(spark, gone))
        rest = [x for x in first + second if (x[0], digest(x[1])) not in {(d, digest(t)) for d, t in gone}]
        assert live(index) == state(rest)
        tags = sum(t != 0 for r in index.filters.collect() for t in memoryview(r["table"]).cast("H"))
        assert tags == len(state(rest))
        asked = frame(spark, [(0, "text 12"), (1, "never there"), (2, "a b"), (3, first[2][1])])
        assert {r["doc_id"]: r["live"] for r in index.holds(asked).collect()} == {
            0: True, 1: False, 2: True, 3: digest(first[2][1]) in state(rest)
        }
        index, _ = index.insert(frame(spark, gone))
        assert live(index) == state(rest + gone)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hits_on_stored_tags_are_left_to_the_content(monkeypatch):
    few_tags(monkeypatch)
    stored = CuckooFilter.holding([digest(f"s{i}") for i in range(8)], 8)
    filters = pd.DataFrame({"slice": [0], "buckets": [8], "table": [stored.table.tobytes()]})
    out = cuckoo._pass((0,), filters, entries([(i, f"s{i % 60}") for i in range(120)]))
    keys = out[out["kind"].isin(["new", "maybe"])]
    assert sorted(zip(keys["digest"], keys["copies"])) == sorted((digest(f"s{i}"), 2) for i in range(60))
    assert {digest(f"s{i}") for i in range(8)} <= set(keys[keys["kind"] == "maybe"]["digest"])
    assert set(out["kind"]) == {"new", "maybe", "filter"}


@pytest.mark.parametrize("buckets", [3, 1000])
def test_buckets_are_a_power_of_two(buckets):
    with pytest.raises(ValueError):
        CuckooFilter(buckets)
