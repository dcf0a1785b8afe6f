"""Cross-tokenizer alignment against all pairs of tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorikeet.llm.alignment import Alignment, Tokenizers, align, chunks, default_tokenizers, op11_alignment

WORDS = ["hello", "naïve", "日本語", "1234", "don't", "x_y", "I/O", "🙂", "ﬁx", " ", "a\tb", "<s>", "<|endoftext|>", "aaaaaaa"]


def tokens(text, made):
    """(ids of A, ids of B), both empty where the text has no tokens."""
    if not text:
        return [], []
    a, b = made.a.encode(" " + text, add_special_tokens=False).ids, made.b.encode(text)
    raw = (" " + text).encode()
    same = raw == b"".join(made.bytes_a[i] for i in a) == b"".join(made.bytes_b[i] for i in b)
    return (a, b) if same else ([], [])


def ranges(ids, lengths):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(lengths[i])))
        at += len(lengths[i])
    return out


def brute(docs):
    made = Tokenizers(*default_tokenizers())
    found, links = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text, made)
        ra, rb = ranges(a, made.bytes_a), ranges(b, made.bytes_b)
        linked = [(x, y) for x, s, e in ra for y, u, v in rb if s < v and u < e]
        cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups, lo = [], 0
        for hi in cuts:
            side = lambda r: ",".join(str(x) for x, s, e in r if lo <= s and e <= hi)  # noqa: E731, B023
            groups.append(f"{side(ra)}|{side(rb)}")
            lo = hi
        links.update(linked)
        found.append((doc_id, len(a), len(b), groups, linked))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return [
        (d, a, b, len(g), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p), ";".join(g))
        for d, a, b, g, p in found
    ], links, most


DOCS = [
    (1, "hello world hello"), (2, None), (3, ""), (4, " "), (5, "  two  spaces "), (6, "\n\tline \n next\n"), (7, "a▁b word"),
    (8, " ".join(WORDS)), (9, "don't stop<s>"), (10, "trailing  "), (1, "hello world hello"), (None, "hello"),
    (11, "hello " * 300 + "end"), (12, "\x00null \x1c sep \x85 next"), (13, "x" * 500), (14, "é é 　wide​ zero"),
]
SCHEMA = "doc_id long, text string, groups string, n_a int"


@pytest.mark.parametrize("small", [{}, {"batch_entries": 3, "block_cells": 6_000_000, "task_pairs": 2, "kept_chunks": 5}])
def test_equals_all_pairs(spark, small):
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in DOCS], SCHEMA).repartition(3)
    want, links, most = brute(DOCS)
    made = Alignment(docs, **small)
    got = [tuple(r) for r in made.documents().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    pairs = {(r["a"], r["b"]): (r["links"], r["best"]) for r in made.pair_counts().collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in links.items()}
    if small:
        assert made.salts.where("salts > 1").count()


def test_query_digests_groups(spark):
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in DOCS], SCHEMA)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = [tuple(r) for r in op11_alignment(docs).collect()]
    assert sorted(got, key=repr) == sorted([(*w[:-1], digest(w[-1])) for w in brute(DOCS)[0]], key=repr)


def test_empty_table_and_real_documents(spark, sf_dir):
    assert op11_alignment(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 800)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in Alignment(docs).documents().collect()]
    assert sorted(got) == sorted(brute(rows)[0])


def test_chunks_join_to_the_text():
    for _, text in DOCS:
        if text:
            assert " ".join(chunks(text)) == text
            assert all(chunks(text))


def test_align_groups_end_together():
    a, b = np.array([1, 2, 3]), np.array([7, 8])
    links, per_token, of_a, of_b = align(a, b, np.array([0, 1, 2, 1, 0]), np.array([0] * 7 + [1, 3]))
    assert links.tolist() == [[1, 7], [2, 8], [3, 8]] and per_token.tolist() == [1, 1, 1]
    assert of_a.tolist() == [0, 1, 1] and of_b.tolist() == [0, 1]
