"""Best-fit packing of tokenised documents by minimum bin slack.

Documents are tokenised in tasks and cut into pieces. How many pieces there are
of each length is at most ``capacity`` numbers, however many documents there
are, and only these reach the driver. There, for each bin, a subset-sum table
of bits over the available lengths finds the fullest feasible combination with
the longest piece left; the combination is removed as many times as the counts
allow. The result is a table of slots by length and rank, with which the ranked
pieces are joined.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.common import frugal, kept_in_worker, sum_before, written

#: Tokens in a sequence.
CAPACITY = 4096
#: The id that ends every document.
END_ID = 1
#: Distinct words, and words with what adjoins them, whose ids a Python worker keeps.
KEPT_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What sends an ASCII text through the library whole: Python splits at these, the file doesn't.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class WordTokenizer:
    """The ids that ``tokenizers`` gives a text without special tokens, for a
    lower-casing BPE file with word ends; ids of frequent words are kept.

    Texts are normalised and cut at white space as the file's normaliser and
    pre-tokeniser do; words not met before go through the library together.
    Texts outside Latin script, and those that hold control characters or a
    special token, go through the library whole.
    """

    _WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.words = regex.compile(self._WORD).findall
        self.other = re.compile(r"[^\u0000-\u024F\u2010-\u2044]|[\x1c-\x1f]|<\|").search
        # the same vocabulary for words that are already normalised and cut
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        ends = [i for t, i in self.bare.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.bare.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.kept, self.kept_words = _Kept(kept_words), _Kept(kept_words)

    @functools.cached_property
    def model(self):
        """The file as it is, for texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _cut(self, chunk: str) -> list[str]:
        """The words of a chunk; most are letters alone, or with one mark behind."""
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and not chunk[-1].isalnum():
            return [chunk[:-1], chunk[-1]]
        return self.words(chunk)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not mark every word's end")
        raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return {w: raw[at[i] : at[i + 1]] for i, w in enumerate(words)}

    def _look_up(self, chunks: list[str]) -> dict[str, bytes]:
        cut = [(c, self._cut(c)) for c in chunks]
        ids = self.kept_words.holding({w for _, words in cut for w in words}, self._encode_words)
        return {c: ids(words[0]) if len(words) == 1 else b"".join(map(ids, words)) for c, words in cut}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut: list[list[str] | None] = []
        distinct: set[str] = set()
        for text in texts:
            text = text or ""
            plain = text.isascii()
            if any(c in text for c in _ODD) if plain else self.other(text):
                cut.append(None)
                continue
            chunks = (text if plain else unicodedata.normalize("NFC", text)).lower().split()
            distinct.update(chunks)
            cut.append(chunks)
        get = self.kept.holding(distinct, self._look_up)
        return [
            b"".join(map(get, chunks))
            if chunks is not None
            else np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            for text, chunks in zip(texts, cut)
        ]


class _Kept(dict):
    """Values of about the first ``size`` keys, and of the others for one call."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.rest = size, {}

    def holding(self, keys: set[str], make: Callable[[list[str]], dict[str, bytes]]) -> Callable[[str], bytes]:
        """What gives the value of any of the keys, made where it isn't kept."""
        new = [k for k in keys if k not in self]
        found = make(new) if new else {}
        if len(self) < self.size:
            self.update(found)
        else:
            self.rest = found
        return self.__getitem__

    def __missing__(self, key: str) -> bytes:
        return self.rest[key]


class PlainTokenizer:
    """Any other file: every text goes through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        found = self.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


def _cuts_words(path: str) -> bool:
    """Whether the file normalises and cuts texts as ``WordTokenizer`` does."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (made.get("normalizer") or {}).get("normalizers", [])]
    cut = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert"), c.get("use_regex")) for c in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and cut == [("Split", {"Regex": WordTokenizer._WORD}, "Removed", True, None), ("ByteLevel", None, None, None, False)]
        and made["model"].get("type") == "BPE"
        and made["model"].get("end_of_word_suffix") == "</w>"
        and all(t["content"].startswith("<|") for t in made.get("added_tokens", []))
    )


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str, kept_words: int = KEPT_WORDS) -> WordTokenizer | PlainTokenizer:
    """One for each Python worker, so that tasks share the kept words."""
    return WordTokenizer(path, kept_words) if _cuts_words(path) else PlainTokenizer(path)


def _forget() -> None:
    _tokenizer.cache_clear()


kept_in_worker(_forget)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a row for each piece: documents
    of over ``capacity`` tokens are cut into pieces of it, the last may be shorter."""
    path = tokenizer or default_tokenizer()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(path, kept_words)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                doc_ids, texts = (c.slice(lo, 256).to_pylist() for c in batch.columns)
                for doc_id, ids in zip(doc_ids, words.encode_all(texts)):
                    ids += end
                    n = len(ids) // 4
                    for k, a in enumerate(range(0, n, capacity)):
                        raw = ids[4 * a : 4 * (a + capacity)]
                        out.append((doc_id, k, a, len(raw) // 4, zlib.crc32(raw)))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(frugal(each, _forget), PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination {length: times} of available lengths with the least slack
    that holds the longest: its sum comes as near to ``capacity`` as any.

    ``reach`` has bit s set where some combination sums to s. Lengths enter in
    falling order, so the table is left as soon as a full bin is found and
    short pieces, which fit anywhere, stay for later.
    """
    longest = max(counts)
    room = capacity - longest
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, times, reach before it entered
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == longest)
        most = min(left, room // length)
        power = 1
        while most > 0:  # binary parts of the multiplicity
            times = min(power, most)
            steps.append((length, times, reach))
            reach |= reach << (length * times) & mask
            most -= times
            power *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return chosen


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: times}) of the bins, in order."""
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is out of range")
    bins = []
    while left:
        chosen = fullest(left, capacity)
        repeats = min(left[k] // n for k, n in chosen.items())
        bins.append((repeats, chosen))
        for k, n in chosen.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return bins


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, times, first_sequence, offset): the pieces of a length
    with ranks from first_rank up fill sequences from first_sequence up, ``times``
    in each, from that offset; a row for each length in each kind of bin."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for repeats, chosen in pack_counts(counts, capacity):
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, used[length], chosen[length], sequence, offset))
            used[length] += chosen[length] * repeats
            offset += chosen[length] * length
        sequence += repeats
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Pieces of one length are interchangeable and are ranked by a hash slice,
    then doc_id and piece; ranks are counted by (length, slice), so that a length
    with any share of the rows is spread. The slots of a length, and so the slots
    in all, are at most a few for each of ``capacity`` lengths; a piece takes the
    slot row with the largest first_rank up to its rank. No rows: no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    found: dict[int, list[tuple]] = {}
    for length, *slot in slots(counts, capacity):
        found.setdefault(length, []).append(tuple(slot))
    names = ("first_rank", "times", "first_sequence", "first_offset")
    slot_type = pa.list_(pa.struct([(name, pa.int64()) for name in names]))
    # as Arrow: plain rows would start further Python workers on the executors
    table = spark.createDataFrame(
        pa.table(
            {
                "length": pa.array(list(found), pa.int64()),
                "slots": pa.array([[dict(zip(names, slot)) for slot in v] for v in found.values()], slot_type),
            }
        )
    )
    ranked = sum_before(
        pieces.withColumn("__slice", F.expr("pmod(xxhash64(doc_id, piece, 'pack'), 256)")).withColumn("__one", F.lit(1)),
        ["length"],
        "__slice",
        ["doc_id", "piece"],
        "__one",
        "__rank",
    )
    # at most `capacity` rows, whose arrays hold the slots: a proven bound
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "__slot", F.expr("element_at(filter(slots, s -> s.first_rank <= __rank), -1)")
    )
    at = F.col("__rank") - F.col("__slot.first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("__slot.first_sequence") + F.floor(at / F.col("__slot.times"))).alias("sequence_id"),
        (F.col("__slot.first_offset") + at % F.col("__slot.times") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS
) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text, ...) placed in sequences of at most
    ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset). Null and empty texts are one piece that holds the end id alone;
    repeated doc_ids are packed row by row; other columns are ignored. Keeping
    fewer words takes less memory in Python workers and more time."""
    return pack(written(tokenized_pieces(docs, tokenizer, capacity, kept_words), "pieces"), capacity)


def op3_pack(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in their sequences: see ``pack_documents`` for nulls,
    empty and long texts and repeated rows."""
    return pack_documents(docs)
