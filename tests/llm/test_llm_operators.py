"""The ten operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorikeet.llm import chat, embedding_dedup, entry, graph, mixing, multiset_hash, packing, pii, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def doc_rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture()
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = doc_rows(["a b c d e f", None, "", LONG, "a b c d e f", "\n\n x é"]) + [
        (None, None, None, None, None), (None, "a b c d e f", "en", None, 3), (4, "a b c d e f", "en", "s1", 11),
        (4, "other words here", "en", "s1", 11),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashing = ["size", "target", "taken", "fp", "rep", "component_id", "node", "shard", "slot", "score", "n_replaced", "length", "piece", "u", "v", "key"]
    return df.select("*", *[F.lit("x").alias(c) for c in clashing])


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, linked):
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    out = {}
    for i in ids:
        x = i
        while root[x] != x:
            x = root[x]
        out[i] = x
    return out


# 1: SimHash


def slow_simhash(text, k=4):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_definition():
    for text in ["", None, "One", "a b c", "a b c d", "A b C d e a b c d", "x " * 500, "Été \x1c y\x0bz q r s"]:
        assert simhash.simhash(text, 4) % (1 << 64) == slow_simhash(text)


def test_op1_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op1_simhash(docs).collect()}
    fps = {r["doc_id"]: slow_simhash(r["text"]) for r in docs.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    want = components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_covering_finds_every_close_pair(spark):
    """Random fingerprints with planted neighbours at each distance, in small cells."""
    rng = random.Random(1)
    fps = {}
    for _ in range(40):
        base = rng.getrandbits(64)
        for distance in (0, 1, 2, 3, 4, 5, 6):
            fps[len(fps)] = base ^ sum(1 << b for b in rng.sample(range(64), distance))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    reps = {}
    for i, x in fps.items():
        reps.setdefault(x, i)
    points = spark.createDataFrame([(i, [signed(x)], [signed(x)]) for x, i in reps.items()], "rep long, keys array<bigint>, sketch array<bigint>")
    want = components(sorted(reps.values()), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    for cell in (2048, 2):
        parts = {r["node"]: r["component"] for r in graph.connected_components(simhash.link_edges(points, 4, cell)).collect()}
        assert {i: parts.get(i, i) for i in want} == want


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.connected_components(edges.where("a < 0")).count() == 0


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs, 4).collect()]
    assert len(got) == odd_docs.count()
    by = collections.defaultdict(set)
    for doc_id, fp, comp in got:
        by[doc_id].add((fp, comp))
    assert {c for f, c in by[1] | by[2]} == {1} and {f for f, c in by[1]} == {0}
    assert {c for _, c in by[0]} == {0} and 0 in {c for _, c in by[4]}
    assert simhash.op1_simhash(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs)
    rows = kept.collect()
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in rows) == [0, 1, 3, 4, 5]
    assert {r["doc_id"]: r["text"] for r in rows}[4] == "other words here" and all(r["rep"] == "x" for r in rows)
    twice = odd_docs.where("doc_id IS NULL").union(odd_docs.where("doc_id IS NULL"))
    assert sorted(str(r["text"]) for r in simhash.drop_near_duplicates(twice).collect()) == ["None", "a b c d e f"]
    got = simhash.similar(odd_docs).collect()
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {0, 1} and len(got) == odd_docs.count()


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_likeness_of_shingle_sets(spark):
    """Components of exact likeness: scattered edits, added, removed and replaced
    passages, chains of which the ends are unlike, unrelated texts."""
    rng = random.Random(3)
    texts = []
    for g in range(60):
        base = [f"w{g}x{rng.randrange(60)}" for _ in range(rng.randint(60, 300))]
        new = [f"n{g}x{k}" for k in range(len(base) // 6)]
        at, third = rng.randrange(len(base) - len(new)), len(new) // 2
        texts += [base, edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.5), base + new, new + base]
        texts += [base[:at] + new[:third] + base[at + third :], base[len(new) :], base[: -len(new)]]
    for g in range(10):  # each like the next only
        base = [f"c{g}x{k}" for k in range(200)]
        texts += [base[k : k + 100] for k in range(0, 60, 8)]
    texts = [" ".join(w) for w in texts]
    sets = [shingle_set(t) for t in texts]
    want = components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    near = sum(alike(sets[a], sets[b]) for a in range(len(texts)) for b in range(a))
    assert near > 400 and len(set(want.values())) > 100
    for cell in (2048, 5):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(doc_rows(texts), DOCS), cell=cell).collect()}
        assert got == want


# 2: mixing


def test_targets_by_rounds(spark):
    rng = random.Random(5)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(n)}
        names = sorted(sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, fixed = sum(sizes.values()), {}
        while True:  # share by weight, stop what is above, share the rest again
            open_ = [s for s in names if s not in fixed]
            rest = total - sum(fixed.values())
            share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
            if not over:
                break
            fixed |= {s: 3 * sizes[s] for s in over}
        want = fixed | share
        rows = spark.createDataFrame([(s, s, v) for s, v in sizes.items()], "skey string, source string, source_size long")
        got = {r["skey"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(want)


def test_mix_takes_each_budget(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.expr("if(doc_id % 4 = 0, null, source)"))
    rows = mixing.op2_mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == pytest.approx(rs[0]["target"], abs=1)
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
    again = {r["doc_id"]: r["taken"] for r in mixing.op2_mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    copies = mixing.mixed_documents(docs).groupBy("doc_id").agg(F.sum(mixing.n_words("text")).alias("n"))
    assert {r["doc_id"]: r["n"] for r in copies.collect()} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    odd = mixing.mix(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("size = 0 AND doc_id = 1").agg(F.sum("taken")).first()[0] == 0
    mixed = mixing.mixed_documents(odd_docs.withColumn("source_size", F.lit("y")))
    assert mixed.columns == [*odd_docs.columns, "source_size"]
    assert {(r["size"], r["taken"], r["target"], r["source_size"]) for r in mixed.collect()} == {("x", "x", "x", "y")}
    # a third of all rows the same: each source still gives its target
    same = spark.createDataFrame([(7, "one two three", "b")] * 50 + [(i, "a b c d e", "abc"[i % 3]) for i in range(100)], "doc_id long, text string, source string")
    for frame in (same, same.where("doc_id = 7"), same.where("doc_id <> 7")):
        taken = {r["source"]: r["n"] for r in mixing.mixed_documents(frame).groupBy("source").agg(F.sum(mixing.n_words("text")).alias("n")).collect()}
        named = frame.select("source", F.col("source").alias("skey"), mixing.n_words("text").alias("n")).groupBy("source", "skey").agg(F.sum("n").alias("source_size"))
        assert taken == {r["skey"]: math.floor(r["target"] + 0.5) for r in mixing.targets(named).collect() if r["target"] >= 0.5}
        assert sum(taken.values()) == pytest.approx(mixing.op2_mix(frame).agg(F.sum("taken")).first()[0])
    assert mixing.op2_mix(no_docs).count() == 0


# 3: packing


def check_packing(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.op3_pack(docs).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(model.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    want = collections.Counter()
    for doc_id, copies in ids.items():
        for x in copies:
            for k, a in enumerate(range(0, len(x), 4096)):
                part = np.array(x[a : a + 4096], "<u4")
                want[doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(r["length"] for r in pieces) // 4096)


def test_op3(spark, sf_dir, odd_docs, no_docs):
    used, least = check_packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert used <= least + 1
    check_packing(spark, odd_docs)
    assert packing.op3_pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fullest_is_the_fullest(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
    got = packing.fullest(counts, 50)
    pieces = [k for k, n in counts.items() for _ in range(n)]
    longest = max(counts)
    pieces.remove(longest)
    sums = {longest}
    for p in pieces:
        sums |= {s + p for s in sums if s + p <= 50}
    assert sum(k * n for k, n in got.items()) == max(sums)
    assert all(n <= counts[k] for k, n in got.items()) and got[longest] >= 1


def test_pack_counts_uses_every_piece():
    rng = random.Random(9)
    counts = {rng.randint(1, 4096): rng.randint(1, 50) for _ in range(300)}
    used = collections.Counter()
    for repeats, chosen in packing.pack_counts(counts):
        assert sum(k * n for k, n in chosen.items()) <= 4096
        for k, n in chosen.items():
            used[k] += n * repeats
    assert used == counts


def test_word_tokenizer_equals_the_library():
    words = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["it's 'SA ''t don't ÀÉ 12½", "<|endoftext|> x", "\x1c\x85  q", "ΣΑΣ İ", "é --'s a'll", None, "", "中文 \U0001f600"]
    for text, got in zip(texts, words.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == words.model.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizer_files_go_through_the_library():
    import public_tokenizers

    assert packing._cuts_words(packing.default_tokenizer())
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing._cuts_words(other)
    words = packing._tokenizer(other)
    texts = ["It's 'SA  \n x", None, "<|endoftext|> É", "中文"]
    for text, got in zip(texts, words.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == words.model.encode(text or "", add_special_tokens=False).ids


# 4: multiset fingerprints


def exact_likeness(a, b):
    """Of the multisets of word pairs: 1 less the squared distance by the squared lengths."""

    def pairs(text):
        words = ("\n " + text.replace("\n", " \n ") + " \n").split(" ")
        return collections.Counter(zip(words, words[1:]))

    x, y = pairs(a), pairs(b)
    return 2 * sum(n * y[k] for k, n in x.items()) / (sum(n * n for n in x.values()) + sum(n * n for n in y.values()))


def wide_of(text):
    out = [0] * 4
    for line in text.split("\n"):
        h = hashlib.sha256(line.encode()).hexdigest()
        out = [(o + int(h[15 * i : 15 * i + 15], 16)) % (1 << 60) for i, o in enumerate(out)]
    return "".join(f"{o:016x}" for o in out)


def test_op4(spark, sf_dir, odd_docs, no_docs):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ties = spark.createDataFrame([(i // 40 * 10_000, f"text {i % 7} of\nsome words") for i in range(120)] + [(None, f"n{i}") for i in range(30)] + [(-5, None)], "doc_id long, text string")
    off = 0.0
    for docs, rows in ((plain, 7), (plain, 20_000), (odd_docs, 3), (ties, 5), (ties.where("doc_id IS NULL"), 5), (plain.limit(1), 5)):
        docs = docs.withColumn("__range", F.lit("x")).withColumn("fp", F.lit("y"))
        got = multiset_hash.op4_fingerprint(docs, range_rows=rows).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((i, len(t)) for i, t in texts)
        by_print = {wide_of(t): t for _, t in texts}
        assert len({r["fingerprint"] for r in got}) == len({t for _, t in texts})
        # the order that the edited texts tell: doc_ids fall, then null, and the first follows the last
        left = collections.Counter(texts)
        follows = collections.defaultdict(list)
        order = sorted({i for i, _ in texts}, key=lambda i: (i is None, -(i or 0)))
        for r in got:
            t = by_print[r["fingerprint"][:64]]
            left[r["doc_id"], t] -= 1
            at = order.index(r["doc_id"])
            options = {x for i, x in texts if i in (r["doc_id"], order[(at + 1) % len(order)])}
            k = len(t) // 3
            made = [x for x in options if hashlib.sha256((t[: len(t) - k] + x[:k]).encode()).hexdigest() == r["edited_sha256"]]
            assert made
            e = t[: len(t) - k] + made[0][:k]
            assert r["edited_fingerprint"][:64] == wide_of(e)
            assert (r["near_edited"] == 1) >= (e == t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            follows[r["doc_id"]].append(r)
            if docs.columns[0] == "doc_id" and len(texts) == 200:
                off = max(off, abs(r["near_edited"] - exact_likeness(t, e)), abs(r["near_next"] - exact_likeness(t, made[0])))
        assert not any(left.values())
    assert 0 < off < 0.45
    assert multiset_hash.op4_fingerprint(no_docs).count() == 0


def test_likeness_follows_exact_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(200)
    texts = [r["text"] for r in docs.collect()]
    pairs = [(a, a[: len(a) * k // 10] + b[: len(b) * (10 - k) // 10]) for k, (a, b) in enumerate(zip(texts, texts[1:])) for k in (k % 11,)]
    got = spark.createDataFrame(pairs, "a string, b string").select(multiset_hash.likeness(multiset_hash.fingerprint("a"), multiset_hash.fingerprint("b")).alias("x"), "a", "b").collect()
    errors = np.array([r["x"] - exact_likeness(r["a"], r["b"]) for r in got])
    assert np.abs(errors).mean() < 0.08 and abs(errors.mean()) < 0.03
    long = spark.createDataFrame([("so " * 90_000, "so " * 60_000)], "a string, b string")
    row = long.select(multiset_hash.likeness(multiset_hash.fingerprint("a"), multiset_hash.fingerprint("b")), "a", "b").first()
    assert row[0] == pytest.approx(exact_likeness(row[1], row[2]), abs=0.02)


def test_counters_count_every_bit(spark):
    """Lanes against a count of each bit of Spark's hashes, over more hashes than a short lane holds."""
    texts = ["", "a b\nc", "\n\n", "x  y", "é ü\nz " * 300, "w " * 2000, " ".join(map(str, range(700)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(multiset_hash._pairs("t").alias("hashes"), multiset_hash.fingerprint("t").alias("fp")).collect():
        packed = r["fp"][4:36]
        counts = [x >> s & 0x7FFFFFFF for s in (0, 32) for x in packed]
        assert counts == [sum(h >> b & 1 for h in r["hashes"]) for b in range(64)] and r["fp"][36] == len(r["hashes"])


def test_wide_parts_differ_where_a_64_bit_hash_collides(spark):
    """Two texts that XXH64 takes for one, made by cancelling one lane's change in the next stripe."""
    from xxhash import xxh64_intdigest

    p1, p2, mask, rng = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1, random.Random(1)
    turn = lambda acc, x: ((y := (acc + x * p2) & mask) << 31 | y >> 33) * p1 & mask
    lane = (42 + p1 + p2) & mask
    word = lambda: bytes(rng.randrange(33, 127) for _ in range(8))
    first, second, tail = word(), word(), bytes(48)
    tail = b"." * 24
    while True:
        other = word()
        change = (turn(lane, int.from_bytes(first, "little")) - turn(lane, int.from_bytes(other, "little"))) * pow(p2, -1, 1 << 64)
        cancel = ((int.from_bytes(second, "little") + change) & mask).to_bytes(8, "little")
        if other != first and all(33 <= c < 127 for c in cancel):
            break
    a, b = (x + tail + y + tail for x, y in ((first, second), (other, cancel)))
    assert a != b and xxh64_intdigest(a, 42) == xxh64_intdigest(b, 42)
    row = spark.createDataFrame([(a.decode(), b.decode())], "a string, b string").select(
        (F.xxhash64("a") == F.xxhash64("b")).alias("same"), (multiset_hash.fingerprint("a") == multiset_hash.fingerprint("b")).alias("fp"),
        F.size(F.array_intersect(F.slice(multiset_hash.fingerprint("a"), 1, 4), F.slice(multiset_hash.fingerprint("b"), 1, 4))).alias("shared"),
    ).first()
    assert row.asDict() == {"same": True, "fp": False, "shared": 0}


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("one two\nthree four five\nsix", "three four five", "six\none two", "three four five\nsix\none two")], "a string, b string, c string, d string")
    f = {c: multiset_hash.fingerprint(c) for c in "abcd"}
    row = df.select(
        (f["a"] == f["d"]).alias("order"),
        (multiset_hash.combine(f["b"], f["c"]) == f["a"]).alias("insert"),
        (multiset_hash.combine(f["a"], f["b"], -1) == f["c"]).alias("delete"),
        multiset_hash.likeness(f["a"], f["d"]).alias("same"),
        (f["a"] == f["c"]).alias("other"),
    ).first()
    assert row.asDict() == {"order": True, "insert": True, "delete": True, "same": 1.0, "other": False}


# 5: chat


def test_op5(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    more = spark.createDataFrame(
        [(1000, 0, "us\ner\\", "a\\n <|turn|> </s>[INST]\n<|end|>\n<"), (1000, 1, "assistant", "[/INST]\\</s>\\\\"),
         (1000, 1, "assistant", None), (None, 0, "assistant", "x"), (2000, None, None, "t"), (2000, 5, "user", LONG)],
        "conv_id long, turn long, role string, text string",
    )
    every = rows.unionByName(more)
    turns = collections.defaultdict(list)
    said = "</s>[INST] ok [/INST]"
    for c, t, role, text in [tuple(r) for r in every.collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]:
        turns[c].append((t is None, t or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.op5_chat(every.withColumn("place", F.lit(1))).collect()}
    assert set(got) == set(turns)
    for c, v in turns.items():
        v.sort()
        loss = "".join(x for *_, role, x in v if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(v) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in v).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(x) for *_, x in v)
    assert {r["conv_id"] for r in chat.op5_chat(more.limit(0)).collect()} == {-7}


def test_examples_are_exploded(spark):
    roles = ["user", "assistant", "user", "user", "assistant", "assistant", "user"]
    rows = spark.createDataFrame([(1, i, role, f"t{i}") for i, role in enumerate(roles)] + [(2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    parts = collections.defaultdict(list)
    for r in chat.expand(chat.format_turns(rows)).orderBy("conv_id", "place", F.desc("trainable")).collect():
        parts[r["conv_id"], r["example"]].append((r["place"], r["trainable"]))
    assert parts[1, 0] == [(0, False), (1, True)] and parts[1, 1] == [(1, False), (2, False), (3, False), (4, True)]
    assert parts[1, 2] == [(4, False), (5, True)] and parts[1, 3] == [(5, False), (6, False)] and parts[2, 0] == [(0, False)]
    assert all(sum(t for _, t in p) == (k[1] < 3 and k[0] == 1) for k, p in parts.items())


def test_examples_have_their_prefixes(spark):
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(6)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(rows)
    stream = "".join(r["formatted"] for r in formatted.orderBy("place").collect())
    spans = {r["example"]: r for r in formatted.where("example IS NOT NULL").collect()}
    examples = chat.example_texts(formatted).orderBy("example").collect()
    assert len(examples) == 3
    for r in examples:
        s = spans[r["example"]]
        assert r["context"] == stream[: s["context_end"]]
        assert chat.unescape(r["reply"]) == f"t{2 * r['example'] + 1} <s>" and "<s>" not in r["reply"]
        assert r["reply"] == stream[s["loss_start"] : s["loss_end"]]


def test_op5_reads_examples_with_whole_prefixes(spark):
    roles = ["user", "assistant", "user", "user", "assistant", "assistant", "user"]
    rows = spark.createDataFrame([(1, i, role, f"t{i} <s>") for i, role in enumerate(roles)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(rows)
    stream = "".join(r["formatted"] for r in formatted.where("conv_id = 1").orderBy("place").collect())
    examples = chat.whole_examples(chat.expand(formatted))
    of = lambda c: examples.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("place", F.desc("trainable")).collect()
    *whole, rest = of(1)
    assert [(r["place"], r["example"], r["trainable"]) for r in whole] == [(1, 0, True), (4, 1, True), (5, 2, True)]
    assert [r["text"] for r in whole] == [stream[: r["loss_end"]] for r in whole]
    assert [chat.unescape(r["text"][r["loss_start"] :]) for r in whole] == ["t1 <s>", "t4 <s>", "t5 <s>"]
    assert not rest["trainable"] and rest["text"] == stream[whole[-1]["loss_end"] :]
    assert [r["text"] for r in of(2)] == ["<|turn|>user\nalone<|end|>\n"] and len(of(None)) == 2
    got = {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(examples).collect()}
    assert got[1] == sum(len(r["text"]) for r in of(1)) and set(got) == {1, 2, None}
    # a prefix that isn't the conversation's is noticed
    wrong = examples.withColumn("text", F.when(F.col("place") == 4, F.regexp_replace("text", "t0", "t9")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="doesn't begin with the one before"):
        chat.read_back(wrong).collect()


# 6: sharding


def test_op6(spark, sf_dir, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        texts = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        got = sharding.op6_shard(docs).collect()
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.op6_shard(no_docs).count() == 0


def test_shares_follow_weights_and_moves_are_confined(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    old = sharding.ShardTree([[[1, 1], [2]], [[1, 3]]])
    new = sharding.ShardTree([[[1, 1], [2]], [[1, 5]]])
    grown = sharding.ShardTree(old.weights, [2.0])
    rows = sharding.place(sharding.place(sharding.place(keys, "k", old, "a"), "k", new, "b"), "k", grown, "c").collect()
    share = collections.Counter(r["a"] for r in rows)
    for shard, weight in enumerate((1, 1, 2, 1, 3)):
        assert share[shard] == pytest.approx(40_000 * weight / 8, rel=0.06)
    assert all(r["b"] >= 3 for r in rows if r["a"] != r["b"])  # only into the region that grew, or within it
    assert all(r["c"] == 5 for r in rows if r["a"] != r["c"])
    assert sum(r["c"] == 5 for r in rows) == pytest.approx(40_000 * 2 / 10, rel=0.06)


# 7: toxicity


def test_op7_on_held_out_rows(spark, no_docs, odd_docs):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = words[20] = rng.choice(["insultox", "insultary", "grumblefoo"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(doc_rows(texts), DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.op7_toxicity(docs, known).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r["predicted"] == dict(labels)[r["doc_id"]] for r in held]
    assert len(held) > 300 and np.mean(right) > 0.97
    # labels of held-out rows change nothing
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {tuple(r) for r in toxicity.op7_toxicity(docs, flipped).collect()} == {tuple(r) for r in got}
    kept = toxicity.drop_toxic(odd_docs, known)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.op7_toxicity(no_docs, known).count() == 0
    none = toxicity.op7_toxicity(odd_docs, known.limit(0)).collect()
    assert len(none) == odd_docs.count() and all(0 <= r["score"] < 0.01 and r["predicted"] == 0 for r in none)


def test_a_repeated_doc_id_is_learnt_from_once(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["insultox", "plain", "word", "other"] if i % 4 == 0 else ["plain", "word", "other"]) for _ in range(12))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    hot = docs.union(docs.where("doc_id = 4").crossJoin(spark.range(300)).select("doc_id", "text"))
    once, again = toxicity.train(docs, known), toxicity.train(hot, known)
    assert once.w.any() and once.bias == again.bias
    assert np.array_equal(once.v, again.v) and np.array_equal(once.w, again.w)


def test_a_pair_of_terms_that_tell_nothing_alone(spark):
    """Toxic are the rows that hold both terms or neither; each is as frequent in either class."""
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(2400):
        words = rng.sample(plain, 12)
        first, second = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["zzinsult"] * first + ["qqgroup"] * second), int(first == second)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = docs.select("doc_id", "toxic")
    machine = toxicity.train(docs, known)
    assert all(machine.v[list(toxicity.buckets_of(w))].any() for w in ("zzinsult", "qqgroup"))
    held = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), machine).collect()
    assert len(held) > 500 and np.mean([(r["score"] >= 0.5) == r["toxic"] for r in held]) > 0.95


def test_pairs_weigh_more_than_their_parts():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    machine = toxicity.fit([np.flatnonzero(r) for r in x], y, float(y.mean()), n=6)
    assert machine.score(np.array([0, 1])) > 0.8 > 0.2 > max(machine.score(np.array([0, 2])), machine.score(np.array([1, 3])))


def test_scores_are_sums_over_explicit_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.4, rng.normal(0, 0.3, 50), rng.normal(0, 0.3, (50, 4)))
    for n in (0, 1, 2, 7, 30):
        at = rng.choice(50, n, replace=False)
        z = machine.bias + sum(machine.w[i] for i in at) + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(at) for j in at[:k])
        assert abs(machine.score(at) - 1 / (1 + math.exp(-z))) < 1e-12


def test_held_out_labels_of_real_documents(spark):
    """No bucket is left out, rare insults and their beginnings among them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [(r["predicted"], known[r["doc_id"]]) for r in toxicity.op7_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in known]
    found, toxic = sum(p and y for p, y in got), sum(y for _, y in got)
    print("found", found, "of", toxic, "called", sum(p for p, _ in got))
    assert toxic > 100 and found / toxic >= 0.9 and found / sum(p for p, _ in got) >= 0.95


def test_words_keep_their_digits():
    assert toxicity._words("You id1ot, l0ser_2!") == ["You", "id1ot", "l0ser", "2"]


# 8: embeddings


def test_op8_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        base = rng.normal(size=16)
        for j in range(3):
            noise = (0.0, 0.1, 0.24)[j] * rng.normal(size=16)
            rows.append((len(rows), (base + noise).astype(np.float32).tolist(), int(i % 2)))
    rows += [(9000, rows[0][1], 0), (9001, rows[0][1], 1), (9002, rows[0][1], None), (9003, [2 * x for x in rows[0][1]], 0)]
    rows += [(9004, None, 0), (9005, [0.0] * 16, 0), (9006, [float("nan")] * 16, 0), (9007, [None] * 16, 0), (9008, [], 0), (9009, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    usable = {i: np.array(e, np.float64) for i, e, lab in rows if e and len(e) == 16 and None not in e and np.isfinite(e).all() and any(e) and lab is not None}
    label = {i: lab for i, _, lab in rows}

    def linked(a, b):
        if a not in usable or b not in usable or label[a] != label[b]:
            return False
        x, y = usable[a], usable[b]
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98

    ids = [r[0] for r in rows]
    links = {a: sum(linked(a, b) for b in ids if a != b) for a in ids}
    parts = components(ids, linked)
    for tile in (2048, 50):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == links
        assert {i: r["component_id"] for i, r in got.items()} == parts
        assert all(r["kept"] == (i == parts[i]) for i, r in got.items())
    assert sum(links.values()) > 200
    assert embedding_dedup.op8_embeddings(df.limit(0)).count() == 0


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24)) * rng.choice([1e-3, 1, 50], size=(300, 24))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scale, stands, lost = embedding_dedup.quantise(unit)
    approx = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    bound = lost[:, None] * (stands + lost) + stands[:, None] * lost
    assert (np.abs(unit @ unit.T - approx) <= bound + 1e-12).all() and bound.max() < 0.2


# 9: WARC


def test_op9(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    big = "z" * 1500
    more = spark.createDataFrame(
        [(900, "http://A.example.org:80/x?q=1#f", big), (901, "https://b.example.org/", big), (902, None, None),
         (903, "not a url\r\nX: y", "small"), (904, "http://a.example.org/x?q=1", "small"), (905, "http://[bad", big), (905, "http://[bad", big)],
        "page_id long, url string, html string",
    )
    every = pages.unionByName(more).withColumn("key", F.lit(1))
    payload = [(r["page_id"], (r["html"] or "").encode()) for r in every.collect()]
    last = {}
    for i, p in payload:
        if len(p) >= 1000:
            last[p] = max(i, last.get(p, i))
    want = collections.Counter(
        (i, len(p), hashlib.sha1(p).hexdigest(), "response" if last.get(p, i) == i else "revisit", None if last.get(p, i) == i else last[p])
        for i, p in payload
    )
    assert collections.Counter(tuple(r) for r in warc.op9_warc(every).collect()) == want
    archive = warc.write_archive(every, block=3)
    urls = spark.createDataFrame([("HTTP://a.example.org/x?q=1",), ("http://nowhere.example/",), (None,)], "url string")
    found = warc.lookup(archive, urls)
    assert sorted(r["page_id"] for r in found.collect()) == [900, 902, 904]
    assert {r["page_id"] for r in warc.read_records(archive, found).collect()} == {900, 902, 904}
    assert warc.op9_warc(every.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.B.org:80/x?y#z") == "org,b,www)/x?y"
    assert warc.url_key("https://b.org:8443") == "org,b:8443)/"
    assert warc.url_key("") == "" and warc.url_key("http://[bad") == "http://[bad"


# 10: PII


def test_pseudonyms_keep_format_and_links():
    names = pii.Pseudonyms(b"key")
    text = (
        "card 4111 1111 1111 1111, bad 9807915762804490, call +1 (017) 555-7713 or 555-123-4567, mail Ab.c-7@mail7.example.com,"
        " ip 97.51.17.173 not 999.1.1.1, born 2024-02-29 or 31.12.1999 not 2023-02-30, ssn 123-45-6789,"
        ' iban DE89 3704 0044 0532 0130 00, token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", version 3.0, again 97.51.17.173'
    )
    masked, n = names.mask(text)
    assert n == 12 and names.mask(masked, back=True)[0] == text
    for value in ("4111 1111 1111 1111", "9807915762804490", "555-7713", "555-123-4567", "Ab.c-7@", "97.51.17.173", "2024-02-29", "123-45-6789", "3704 0044", "2abc3ff2"):
        assert value not in masked
    for value in ("999.1.1.1", "2023-02-30", "version 3.0", "@mail7.example.com", "+1 ("):
        assert value in masked
    ips = [w.strip(",") for w in masked.split() if w.count(".") == 3 and w[0].isdigit() and not w.startswith("999")]
    assert len(ips) == 2 and len(set(ips)) == 1
    card = "".join(masked.split("card ")[1].split(",")[0].split())
    assert pii.luhn(card[:-1]) == int(card[-1])
    assert names.mask("x" * 200_000 + " a@b.co" + "y.z" * 20_000)[1] == 1


def test_adjacent_values_are_found_one_by_one():
    """A value beside any other, a year or a word gets the pseudonym that it has alone."""
    names = pii.Pseudonyms(b"key")
    values = [
        "+1 (843) 555-7672", "+44 20 7946 0958", "+18435557672", "555-123-4567", "(843) 555-7672", "170.106.47.218", "2024-02-29", "31.12.1999",
        "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "9807 9157 6280 4490", "BE68 5390 0754 7034", "a.b@mail7.example.com",
        "+33 (0)1 23 45 67 89", "2001:db8:85a3::8a2e:370:7334", "2001:0DB8:0000:0000:0000:0000:0000:0001",
        "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "SE45 5000 0000 0583 9825 7466", "0123456789abcdef0123456789abcdef",
    ]
    alone = {v: names.mask(v) for v in values}
    assert all(n == 1 and masked != v for v, (masked, n) in alone.items())
    for a in values:
        for word in ("CALL", "2024", "170", "999.1.1.1"):
            if word != "170" or not a.startswith(("4111 ", "9807 ")):  # 4-4-4-4-3 is one number
                assert names.mask(f"{a} {word}") == (f"{alone[a][0]} {word}", 1), (a, word)
        for word in ("CALL", "12", "AB12 CD"):
            assert names.mask(f"{word} {a}") == (f"{word} {alone[a][0]}", 1), (a, word)
        for b in values:
            masked, n = names.mask(f"{a} {b}")
            assert (masked, n) == (f"{alone[a][0]} {alone[b][0]}", 2), (a, b)
            assert names.mask(masked, back=True) == (f"{a} {b}", 2)
    number, n = names.mask("4111 1111 1111 1111 170")
    assert n == 1 and number.startswith(alone["4111 1111 1111 1111"][0] + " ") and names.mask(number, back=True)[0] == "4111 1111 1111 1111 170"


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(b"k", "t", size)
    images = [f.apply(x) for x in range(size)]
    assert sorted(images) == list(range(size)) and [f.apply(y, back=True) for y in images] == list(range(size))
    even = lambda x: x % 2 == 0
    assert sorted(f.apply(x, valid=even) for x in range(0, size, 2)) == list(range(0, size, 2))


def test_phone_numbers_are_one_however_they_are_set():
    names = pii.Pseudonyms(b"key")
    for forms in (
        ["+49 170 1234567", "+491701234567", "+49-170-1234567"],
        ["+1 (843) 555-7672", "(843) 555-7672", "843-555-7672", "+18435557672", "+1 843 555 7672"],
        ["+33 (0)1 23 45 67 89", "+33 1 23 45 67 89", "+33123456789"],
    ):
        national = {"".join(c for c in names.mask(f)[0].replace("(0)", "") if c.isdigit())[-9:] for f in forms}
        assert len(national) == 1 and all(names.mask(f)[1] == 1 for f in forms)
    assert names.mask("+33 (0)1 23 45 67 89")[0].startswith("+33 (0)")


def plain_finds(text):
    """Values by rules of their own, one kind after the other: (kind, value)."""
    import ipaddress
    import re

    def real(kind, v):
        if kind == "iban":
            flat = v.replace(" ", "")
            moved = flat[4:] + flat[:4]
            return int("".join(str(ord(c) - 55) if c.isalpha() else c for c in moved)) % 97 == 1
        if kind == "ip":
            try:
                return bool(ipaddress.ip_address(v))
            except ValueError:
                return False
        return True

    shapes = {
        "mail": r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "ip": r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.]*\d)",
        "iban": r"\b[A-Z]{2}\d{2}(?: \d{4}){3,6}(?: \d{1,3})?\b", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d+-])\d{3}-\d{3}-\d{4}(?!\d)",
        "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", "card": r"(?<![\d-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\d-])", "long": r"(?<!\w)\d{16}(?!\w)",
    }
    return [(kind, m) for kind, shape in shapes.items() for m in re.findall(shape, text) if real(kind, m)]


@pytest.mark.parametrize(
    "text, gone",
    [
        ("pay AT611904300234573201 EUR 500", "1904300234573201"), ("pay ES91 2100 0418 4502 0005 1332 EUR", "2100 0418"),
        ("to BE68 5390 0754 7034 THIS", "5390 0754"), ("SE45 5000 0000 0583 9825 7466.", "5000 0000 0583"), ("IE29AIBK93115212345678", "93115212345678"),
        ("write é.ü@exemple.fr now", "é.ü@"), ("call +33 (0)1 23 45 67 89", "1 23 45 67 89"), ("at 2001:db8::ff00:42:8329 now", "ff00:42:8329"),
        ("a@b.co", "a@"), ("mail É.x9@mail.example", "É.x9@"), ("fe80::1ff:fe23:4567:890a", "fe23:4567"),
    ],
)
def test_values_that_once_stayed(text, gone):
    names = pii.Pseudonyms(b"key")
    masked, n = names.mask(text)
    assert n == 1 and gone not in masked and len(masked) == len(text)
    assert names.mask(masked, back=True) == (text, 1)


def test_texts_that_stay():
    names = pii.Pseudonyms(b"key")
    for text in ("std::vector", "at 12:30:45", "AT611904300234573202", "a::b", "add::bad", "00:1a:2b:3c:4d:5e", "version 1.2.3", ""):
        assert names.mask(text) == (text, 0)


def test_op10(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = b"of the test"
    private = pii.pseudonymise(docs.select("doc_id", "text"), key)
    got = {r["doc_id"]: r for r in private.collect()}
    linked, n = {}, 0
    for r in docs.collect():
        masked = got[r["doc_id"]]["text"]
        found = plain_finds(r["text"])
        n += len(found)
        assert got[r["doc_id"]]["n_replaced"] >= len({v for _, v in found}) and not any(v in masked for _, v in found)
        assert (masked != r["text"]) == (got[r["doc_id"]]["n_replaced"] > 0)
        if any(kind == "ip" for kind, _ in found):  # whose length changes
            continue
        assert len(masked) == len(r["text"])
        for kind, value in found:
            at = r["text"].index(value)
            new = masked[at : at + len(value)]
            assert new != value and linked.setdefault((kind, value), new) == new  # one pseudonym in all documents
            assert any(k == kind for k, _ in plain_finds(f" {new} ")), (kind, value, new)  # of the same kind, and valid
    assert n > 50
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(private, key, back=True).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = pii.pseudonymise(odd_docs, count=None).collect()
    assert collections.Counter(map(repr, odd)) == collections.Counter(map(repr, odd_docs.collect()))
    assert pii.pseudonymise(odd_docs).where("n_replaced = 0").count() == odd_docs.count() and pii.op10_pii(no_docs).count() == 0
    some = docs.where("doc_id < 300")
    assert collections.Counter(map(repr, pii.op10_pii(some).collect())) == collections.Counter(map(repr, pii.op10_pii(some.repartition(3)).collect()))


# hot keys


def test_hot_keys_are_spread(spark):
    """A third of all rows has one doc_id, a third none: nothing that one task must hold has more than its share."""
    rows = spark.range(6000).select(
        F.expr("CASE id % 3 WHEN 0 THEN 77 WHEN 1 THEN NULL ELSE id END").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text")
    )
    ranges = multiset_hash._ranged(rows, 100).groupBy("__range").count()
    assert ranges.agg(F.max("count")).first()[0] <= 300 and ranges.count() >= 40
    anchors = spark.range(5000).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("anchor"))
    cells = simhash._cells(anchors, 500)
    sizes = cells.groupBy("anchor", "i", "j").count()
    assert sizes.agg(F.max("count")).first()[0] < 1400 and sizes.count() == 55
    met = cells.where("rep IN (3, 4321)").groupBy("anchor", "i", "j").count().where("count = 2").count()
    assert met >= 1  # every two points meet


def test_scratch_tables_go(spark, tmp_path):
    """Tables that a result doesn't read are gone when it is made."""
    import glob

    from lorikeet.llm import common

    base = common.scratch_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/lorikeet/*"))
    docs = spark.createDataFrame(doc_rows(["a b c d e f g", "a b c d e f g", "x y z"]), DOCS)
    out = simhash.drop_near_duplicates(docs)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{base}/lorikeet/*")) - before}
    assert left == {"simhash-rows", "simhash-found", "simhash-kept"} and out.count() == 2
    with common.scratch_scope(spark):
        assert simhash.drop_near_duplicates(docs).count() == 2
        toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    now = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{base}/lorikeet/*")) - before}
    assert now == left


def test_every_query_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert math.isfinite(len(entry.oracle_sql())) and set(entry.oracle_sql()) <= set(names)
