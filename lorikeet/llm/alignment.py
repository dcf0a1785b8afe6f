"""Cross-tokenizer alignment: tokens of two vocabularies linked by the bytes they share.

Tokens of A and B of one document link where their byte ranges overlap; how
often two ids link in all documents says how well they stand for each other.
Both tokenisations of a text end together before a space that follows a word, so
a text is cut there and each distinct chunk is encoded and aligned once in a
worker. Documents go into batches of a bounded number of chunks; a batch asks
for its distinct id pairs only.

Pairs are dealt by their B id to stripes, each a dense block of counts (B ids of
the stripe x all A ids) that ``np.add.at`` fills and whose row maxima are the
best counts. The batches' pairs are looked up where their stripe's block is, and
the answers return to the batch that holds the links.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.common import written

#: Entries (a document's distinct chunks) that close a batch.
BATCH_ENTRIES = 1 << 18
#: Distinct chunks of a Python worker above which, after a batch, those go that only one of its documents had.
KEPT_CHUNKS = 100_000
#: Counts in the block of a stripe: 64 MB of long integers.
BLOCK_CELLS = 1 << 23
#: Pairs that one task adds up or looks up for a stripe; a stripe with more of them is salted.
TASK_PAIRS = 1 << 26
#: Pairs in one row of a counted stripe.
ROW_PAIRS = 1 << 18

_PARTS = (
    "kind string, batch long, stripe int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string,"
    " x array<int>, y array<int>, n array<long>"
)
_ARROW = pa.schema([
    ("kind", pa.string()), ("batch", pa.int64()), ("stripe", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
])
_COUNTED = pa.schema([
    ("stripe", pa.int32()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))
])
_ANSWERS = pa.schema([
    ("batch", pa.int64()), ("stripe", pa.int32()), ("n", pa.list_(pa.int64())), ("best", pa.list_(pa.int8()))
])
_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string()),
])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_values() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others as characters from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Tokenizer A (a byte-level file of ``tokenizers``) and B (a ``sentencepiece``
    model that adds a space), and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = _byte_values()
        size_a = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [bytes(value.get(c, 0x3F) for c in self.a.id_to_token(i) or "") for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        with open(path_a, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        #: Whether tokens of neither cross from a character that isn't white space to a space.
        self.can_cut = (
            made.get("normalizer") is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and all(t["special"] for t in made.get("added_tokens", []))
            and not any(re.search("[^▁]▁", p) for p in pieces)
            # an identity normaliser keeps these as they are
            and self.b.normalize("Ａ ﬁ  é\n\t ") == "▁Ａ▁ﬁ▁▁é\n\t▁"
        )

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Of each text, with a space before it."""
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


_UNEVEN = re.compile(r"\A |\s | \Z").search
_CUTS = re.compile(r"(?<=\S) (?!\Z)").split


def chunks(text: str) -> list[str]:
    """The text cut at each space that follows something else than white space and
    isn't the last character; no chunk is empty unless the text is."""
    return _CUTS(text) if _UNEVEN(text) else text.split(" ")


def align(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(links, links of each token of a, group of each token of a, of b) for two
    tokenisations of the same bytes; len_a and len_b give the bytes of each id.

    A token of a links with those of b from the first that ends after it starts
    to the last that starts before it ends; a group ends where both end.
    """
    n_a, n_b = len_a[a], len_b[b]
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    first = np.searchsorted(end_b, end_a - n_a, side="right")
    n = np.searchsorted(end_b - n_b, end_a, side="left") - first
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
    links = np.stack([np.repeat(a, n), b[at]], axis=1)
    bounds = np.intersect1d(end_a, end_b, assume_unique=True)
    return links, n, np.searchsorted(bounds, end_a), np.searchsorted(bounds, end_b)


class Chunks:
    """Aligned chunks by number; chunk 0 is the text that has no tokens."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (tokenizers.bytes_a, tokenizers.bytes_b))
        #: Each id as it stands in a group's text: before another of its side, at its side's end, at the group's end.
        self.written = [f"{i}{end}" for i in range(max(len(self.len_a), len(self.len_b))) for end in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.kept = 0  # chunks up to this number are from batches before
        self.equal = array("b", [1])
        self.counts = array("q", [0, 0, 0])  # tokens of A, of B, groups
        self.links, self.ends = array("I"), array("q", [0])
        self.groups: list[str] = [""]  # each group ends with a semicolon

    def keep(self, chosen: np.ndarray) -> None:
        """Forget all chunks but those of the ascending numbers ``chosen``, which become 1, 2, ..."""
        ends, links = np.array(self.ends, np.int64), np.array(self.links, np.uint32)
        counts, equal, groups = np.array(self.counts, np.int64).reshape(-1, 3), self.equal, self.groups
        texts = list(self.number)  # in the order of their numbers
        self.clear()
        n = ends[chosen] - ends[chosen - 1]
        at = np.arange(n.sum()) + np.repeat(ends[chosen - 1] - (np.cumsum(n) - n), n)
        self.number.update((texts[i - 1], k) for k, i in enumerate(chosen.tolist(), 1))
        self.equal.extend(map(equal.__getitem__, chosen.tolist()))
        self.counts.frombytes(counts[chosen].tobytes())
        self.ends.frombytes(np.cumsum(n).tobytes())
        self.links.frombytes(links[at].tobytes())
        self.groups.extend(map(groups.__getitem__, chosen.tolist()))
        self.kept = len(chosen)

    def _same(self, new: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether the bytes of each chunk's tokens of A, and of B, are those of the chunk."""
        raw = [(" " + c).encode("utf-8") for c in new]
        sides = ((self.of.bytes_a, a), (self.of.bytes_b, b))
        made = [[b"".join(map(of.__getitem__, ids)) for ids in found] for of, found in sides]
        return [r == x == y for r, x, y in zip(raw, *made)]

    def add(self, new: list[str]) -> None:
        """Chunks that don't end with white space are encoded as one text, which is
        cut where they end; the others one by one."""
        joined = [c for c in new if not c[-1].isspace()] if self.of.can_cut else []
        if joined and self._add_joined(joined):
            whole = set(joined)
            new = [c for c in new if c not in whole]
        if new:
            a, b = self.of.encode_a(new), self.of.encode_b(new)
            same = self._same(new, a, b)
            if not all(same):
                a, b = ([ids if ok else [] for ids, ok in zip(side, same)] for side in (a, b))
            n = [np.array(list(map(len, side)), np.int64) for side in (a, b)]
            ids = [np.fromiter(itertools.chain.from_iterable(side), np.int64, int(k.sum())) for side, k in zip((a, b), n)]
            self._store(new, same, ids, n)

    def _add_joined(self, new: list[str]) -> bool:
        """Whether it could be done: all bytes are the same and tokens end where chunks do."""
        text = " ".join(new)
        raw = (" " + text).encode("utf-8")
        ends = np.cumsum([len(c.encode("utf-8")) + 1 for c in new])
        ids, n = [], []
        for found, of, lengths in (
            (self.of.encode_a([text])[0], self.of.bytes_a, self.len_a), (self.of.encode_b([text])[0], self.of.bytes_b, self.len_b)
        ):
            if b"".join(map(of.__getitem__, found)) != raw:
                return False
            ids.append(np.array(found, np.int64))
            token_ends = np.cumsum(lengths[ids[-1]])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                return False
            n.append(np.diff(last, prepend=-1))
        self._store(new, [True] * len(new), ids, n)
        return True

    def _store(self, new: list[str], same: list[bool], ids: list[np.ndarray], n: list[np.ndarray]) -> None:
        """Align the tokens ``ids`` of A and B, of which each chunk has ``n``."""
        n_a, n_b = n
        links, per_token, *groups = align(*ids, self.len_a, self.len_b)
        # tokens by group, those of A first, each with what follows it
        key = np.concatenate([2 * groups[0], 2 * groups[1] + 1])
        order = np.argsort(key, kind="stable")
        last = np.diff(key[order], append=-1) != 0
        text = np.concatenate(ids)[order] * 3 + np.where(last, 1 + key[order] % 2, 0)
        parts = list(map(self.written.__getitem__, text.tolist()))
        ends = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
        cuts = (ends[0] + ends[1]).tolist()
        at_group = np.concatenate([groups[0], [groups[0][-1] + 1 if len(ids[0]) else 0]])[ends[0]]
        at_link = np.concatenate([[0], np.cumsum(per_token)])[ends[0]]
        base = len(self.equal)
        self.number.update(zip(new, range(base, base + len(new))))
        self.equal.extend(same)
        self.counts.frombytes(np.stack([n_a, n_b, np.diff(at_group)], axis=1).astype(np.int64).tobytes())
        self.ends.frombytes((at_link[1:] * 2 + len(self.links)).astype(np.int64).tobytes())
        self.links.frombytes(links.astype(np.uint32).tobytes())
        self.groups.extend("".join(parts[i:j]) for i, j in zip(cuts, cuts[1:]))

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The chunk numbers of each text; [0] for a text without tokens."""
        cut = [((chunks(t) if self.of.can_cut else [t]) if t else []) for t in texts]
        new = {c for found in cut for c in found if c not in self.number}
        if new:
            self.add(sorted(new))
        of, equal, out = self.number.__getitem__, self.equal, []
        for text, found in zip(texts, cut):
            at = list(map(of, found))
            if not at:
                at = [0]
            elif not all(map(equal.__getitem__, at)):
                at = [self._whole(text)]
            out.append(at)
        return out

    def _whole(self, text: str) -> int:
        """A text with a chunk whose bytes differ is judged as a whole."""
        if text not in self.number:
            self.add([text])
        at = self.number[text]
        return at if self.equal[at] else 0


@functools.lru_cache(maxsize=1)
def _chunks(path_a: str, path_b: str) -> Chunks:
    """One for each Python worker, so that tasks share the chunks."""
    return Chunks(Tokenizers(path_a, path_b))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _record(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """``rows`` rows; columns not given are null, lists of arrays become array columns."""
    made = []
    for field in schema:
        if field.name not in columns:
            made.append(pa.nulls(rows, field.type))
        elif pa.types.is_list(field.type):
            made.append(_lists(columns[field.name], field.type.value_type))
        else:
            made.append(pa.array(columns[field.name], field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _flat(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


class _Batch:
    """Documents of a batch until it is full."""

    def __init__(self, table: Chunks, n_stripes: int, digest: bool):
        self.table, self.n_stripes, self.digest = table, n_stripes, digest
        self.rows: list[tuple] = []
        self.found: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.entries = 0

    def add(self, doc_id: int | None, at: list[int]) -> None:
        t = self.table
        text = "".join(map(t.groups.__getitem__, at))[:-1]
        if self.digest and at != [0]:
            text = hashlib.sha256(text.encode()).hexdigest()
        found, times = np.unique(np.array(at, np.int64), return_counts=True)
        per, ends = np.frombuffer(t.counts, np.int64).reshape(-1, 3), np.frombuffer(t.ends, np.int64)
        n_a, n_b, n_groups = (per[found] * times[:, None]).sum(axis=0).tolist()
        spans = ends[found] - np.where(found > 0, ends[found - 1], 0)
        del per, ends  # arrays can't grow while they are viewed
        self.rows.append((doc_id, n_a, n_b, n_groups, int((spans * times).sum()) // 2, text))
        self.found.append(found)
        self.times.append(times)
        self.entries += len(found)

    def frequent(self) -> np.ndarray:
        """The chunks that several of the documents have, and those kept before that one has."""
        found, n_docs = np.unique(np.concatenate(self.found), return_counts=True)
        return found[((n_docs > 1) | (found <= self.table.kept)) & (found > 0)]

    def records(self, batch: int) -> Iterator[pa.RecordBatch]:
        """A row for each document (d), one for the chunks' pairs (c), one for the pairs of each stripe (p)."""
        t = self.table
        used, local = np.unique(np.concatenate(self.found), return_inverse=True)
        times = np.bincount(local, np.concatenate(self.times), len(used)).astype(np.int64)
        ends = np.array(t.ends, np.int64)
        lo, hi = np.where(used > 0, ends[used - 1], 0) // 2, ends[used] // 2
        flat = np.array(t.links, np.uint32).astype(np.int64).reshape(-1, 2)
        starts = np.concatenate([[0], np.cumsum(hi - lo)])
        take = np.arange(starts[-1]) - np.repeat(starts[:-1] - lo, hi - lo)
        a, b = flat[take, 0], flat[take, 1]
        key = ((b % self.n_stripes) << 48) | (b << 24) | a
        pairs, index = np.unique(key, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, index, np.repeat(times, hi - lo))
        bounds = np.cumsum([0, *map(len, self.found)])
        doc_id, n_a, n_b, n_groups, n_links, groups = map(list, zip(*self.rows))
        yield _record(
            _ARROW, len(self.rows), kind=["d"] * len(self.rows), batch=[batch] * len(self.rows), doc_id=doc_id, n_a=n_a, n_b=n_b,
            n_groups=n_groups, n_links=n_links, groups=groups, x=[local[i:j] for i, j in zip(bounds, bounds[1:])], y=self.times,
        )
        yield _record(_ARROW, 1, kind=["c"], batch=[batch], x=[index], y=[starts])
        stripe = pairs >> 48
        edges = np.flatnonzero(np.diff(stripe, prepend=-1, append=-1)) if len(pairs) else np.zeros(1, np.int64)
        spans = list(zip(edges, edges[1:]))
        cut = lambda v: [v[i:j] for i, j in spans]
        yield _record(
            _ARROW, len(spans), kind=["p"] * len(spans), batch=[batch] * len(spans), stripe=[int(stripe[i]) for i, _ in spans],
            x=cut(pairs & 0xFFFFFF), y=cut(pairs >> 24 & 0xFFFFFF), n=cut(n),
        )


class Alignment:
    """All ``docs`` (doc_id, text, ...) encoded with two tokenizers and linked.

    Null and empty texts, and those whose joined tokens of A or of B aren't a
    space and the text, have no tokens. Rows are documents of their own, whatever
    their doc_ids (null and repeated ones too); other columns are ignored; an
    empty table gives empty tables. ``digest`` keeps the SHA-256 of the groups
    instead of their text. The tables are made once and written.
    """

    def __init__(
        self, docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, digest: bool = False,
        batch_entries: int = BATCH_ENTRIES, block_cells: int = BLOCK_CELLS, task_pairs: int = TASK_PAIRS, kept_chunks: int = KEPT_CHUNKS,
    ):
        path_a, path_b = (given or default for given, default in zip((tokenizer_a, tokenizer_b), default_tokenizers()))
        made = Tokenizers(path_a, path_b)
        self.size_a, size_b = len(made.bytes_a), len(made.bytes_b)
        self.n_stripes = -(-size_b // max(1, block_cells // self.size_a))
        self.width, self.task_pairs = -(-size_b // self.n_stripes), task_pairs
        n_stripes = self.n_stripes

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _chunks(path_a, path_b)
            base, k = TaskContext.get().partitionId() << 32, 0
            batch = _Batch(table, n_stripes, digest)
            for rows in batches:
                for lo in range(0, rows.num_rows, 64):
                    doc_ids, texts = (c.slice(lo, 64).to_pylist() for c in rows.columns)
                    for doc_id, at in zip(doc_ids, table.numbers(texts)):
                        batch.add(doc_id, at)
                    if batch.entries >= batch_entries:
                        yield from batch.records(base + k)
                        if len(table.equal) > kept_chunks:
                            table.keep(batch.frequent())
                        batch, k = _Batch(table, n_stripes, digest), k + 1
            if batch.rows:
                yield from batch.records(base + k)
                if len(table.equal) > kept_chunks:
                    table.keep(batch.frequent())

        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.parts = written(rows.mapInArrow(each, _PARTS), "aligned")

    @functools.cached_property
    def salts(self) -> DataFrame:
        """(stripe, salts): into how many tasks the pairs of a stripe go; a row a stripe."""
        found = self.parts.where("kind = 'p'").groupBy("stripe").agg(F.sum(F.size("x")).alias("pairs"))
        return written(found.select("stripe", F.ceil(F.col("pairs") / self.task_pairs).cast("int").alias("salts")), "salts")

    @functools.cached_property
    def asked(self) -> DataFrame:
        """The batches' pairs with the salt of their task."""
        rows = self.parts.where("kind = 'p'").select("batch", "stripe", "x", "y", "n").join(self.salts, "stripe")
        return rows.withColumn("salt", F.expr("cast(pmod(xxhash64(batch), salts) as int)"))

    @functools.cached_property
    def counted(self) -> DataFrame:
        """(stripe, x, y, n): the pairs of A ids x and B ids y and their counts, some rows a stripe."""
        n_stripes, shape = self.n_stripes, (self.width, self.size_a)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, at = np.zeros(shape, np.int64), None

            def flush() -> Iterator[pa.RecordBatch]:
                row, a = np.nonzero(block)
                for lo in range(0, len(row), ROW_PAIRS):
                    r, c = row[lo : lo + ROW_PAIRS], a[lo : lo + ROW_PAIRS]
                    yield _record(_COUNTED, 1, stripe=[at[0]], x=[c], y=[r * n_stripes + at[0]], n=[block[r, c]])
                block[row, a] = 0

            for rows in batches:
                stripe, salt, x, y, n = rows.columns
                for i, key in enumerate(zip(stripe.to_pylist(), salt.to_pylist())):
                    if key != at:
                        if at is not None:
                            yield from flush()
                        at = key
                    np.add.at(block, (_flat(y, i) // n_stripes, _flat(x, i)), _flat(n, i))
            if at is not None:
                yield from flush()

        def totals(rows: DataFrame) -> DataFrame:
            dealt = rows.select("stripe", "salt", "x", "y", "n").repartition("stripe", "salt")
            return dealt.sortWithinPartitions("stripe", "salt").mapInArrow(
                added, "stripe int, x array<int>, y array<int>, n array<long>"
            )

        found = totals(self.asked)
        if self.salts.where("salts > 1").limit(1).count():
            found = totals(found.withColumn("salt", F.lit(0)))
        return written(found, "counted")

    def pair_counts(self) -> DataFrame:
        """(a, b, links, best): how often two ids link, and whether that is most for the B id."""
        flat = self.counted.select(F.explode(F.arrays_zip("x", "y", "n")).alias("p"))
        flat = flat.select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), F.col("p.n").alias("links"))
        most = flat.groupBy("b").agg(F.max("links").alias("most"))
        return flat.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))

    def _answers(self) -> DataFrame:
        """(batch, stripe, n, best) for the pairs that each batch asked for, in its order."""
        n_stripes, shape = self.n_stripes, (self.width, self.size_a)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, best, at = np.zeros(shape, np.int64), None, None
            for rows in batches:
                stripe, salt, batch, x, y, n = rows.columns
                out: list[tuple] = []
                for i, key in enumerate(zip(stripe.to_pylist(), salt.to_pylist())):
                    if key != at:
                        block.fill(0)
                        best, at = None, key
                    cell = _flat(y, i) // n_stripes, _flat(x, i)
                    if not batch[i].is_valid:  # a part of the block
                        block[cell] = _flat(n, i)
                        continue
                    if best is None:
                        best = block.max(axis=1)
                    counts = block[cell]
                    out.append((batch[i].as_py(), key[0], counts, counts == best[cell[0]]))
                if out:
                    ids, stripes, counts, top = map(list, zip(*out))
                    yield _record(_ANSWERS, len(out), batch=ids, stripe=stripes, n=counts, best=top)

        blocks = self.counted.join(self.salts, "stripe").select(
            "stripe", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(None).cast("long").alias("batch"), "x", "y", "n"
        )
        asked = self.asked.select("stripe", "salt", "batch", "x", "y", F.lit(None).cast("array<long>").alias("n"))
        dealt = blocks.union(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("batch"))
        return dealt.mapInArrow(looked_up, "batch long, stripe int, n array<long>, best array<tinyint>")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row for
        each document; n_best counts the links that are most for their B id."""

        def scored(links: pa.Table, answers: pa.Table) -> pa.Table:
            answers = answers.sort_by("stripe").combine_chunks()
            order = range(answers.num_rows)
            parts = lambda name: [_flat(answers[name], i) for i in order]
            counts = np.concatenate([np.zeros(0, np.int64), *parts("n")])
            best = np.concatenate([np.zeros(0, np.int64), *parts("best")]).astype(np.int64)
            kinds = np.array(links["kind"].to_pylist())
            at = int(np.flatnonzero(kinds == "c")[0])
            index, starts = (_flat(links[c], at) for c in "xy")
            sums = [np.concatenate([[0], np.cumsum(v[index])])[starts] for v in (best, counts)]
            by_chunk = [s[1:] - s[:-1] for s in sums]
            rows = links.filter(pa.array(kinds == "d"))
            n_best, count_sum = [], []
            for i in range(rows.num_rows):
                x, y = _flat(rows["x"], i), _flat(rows["y"], i)
                n_best.append(int((by_chunk[0][x] * y).sum()))
                count_sum.append(int((by_chunk[1][x] * y).sum()))
            named = {c: rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
            named |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            return pa.table([named[f.name] for f in _SCORED], schema=_SCORED)

        links = self.parts.where("kind <> 'p'").select("kind", "batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "x", "y")
        return (
            links.groupBy("batch")
            .cogroup(self._answers().groupBy("batch"))
            .applyInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
        )


def op11_alignment(docs: DataFrame) -> DataFrame:
    """Tokens, groups, links and scores of all documents, with the digest of the
    groups: see ``Alignment`` for nulls, texts without tokens, repeated rows and
    empty tables."""
    found = Alignment(docs, digest=True).documents()
    return found.withColumnRenamed("groups", "groups_sha256")
