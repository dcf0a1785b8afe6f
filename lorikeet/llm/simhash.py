"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at 4 or fewer differing bits. A pair that close
differs in at most 2 bits in one of its two 32-bit halves, so some half has a
point within 1 bit of both. The anchors of a half are a perfect covering code:
the Hamming code on 31 bits (covering radius 1) with the last bit carried as it
is. Every fingerprint is replicated to all anchors within the radius plus its
share of the threshold, which are 17 for a half, and is compared only within
an anchor. The anchor that covers the point between a pair holds both, so no
pair is missed; an exact comparison of the 64 bits follows.

``similar`` finds documents by the likeness of their shingle sets instead, since
4 bits of 64 stand for a far higher likeness than 0.8. The same covering takes
the fingerprint of the set of words, which few edits leave within 2 bits in one
of its halves. An added or replaced passage can change many distinct words, so
documents also meet by bands of min-hashes of the shingle sets: two sets of
Jaccard likeness j share none of the 32 bands of 4 with probability
(1 - j^4)^32, below 5e-8 from 0.8 on, wherever the edits lie. Wide fingerprints
of the shingle sets then sort out what is far from alike, and what is left is
compared by the shingle sets themselves: only an exact likeness links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.llm.common import frugal, written, written_alone
from lorikeet.llm.graph import connected_components

#: Differing bits up to which two fingerprints link.
THRESHOLD = 4
#: Words in a shingle of the general operator and the pipeline (the query takes 4).
SHINGLE = 5
#: Distinct fingerprints of one anchor that one comparison cell takes from each side.
CELL = 2048
SEED = 42

#: Likeness of two shingle sets from which documents are near-duplicates.
SIMILARITY = 0.8
#: 64-bit words of the fingerprint of the word set and of that of the shingle set.
WORD_PRINTS, SHINGLE_PRINTS = 1, 16
#: Bands of min-hashes of the shingle set, and min-hashes in a band.
BANDS, BAND_ROWS = 32, 4
#: Differing bits of 64 beyond which word sets that share an anchor aren't looked at further.
UNLIKE_WORDS = 16
#: Of the points of a cell, the share that a comparison of whole sets takes: those are larger.
SET_SHARE = 4
#: Bytes of shingle sets on one side of a comparison of sets.
SET_BYTES = 16 << 20

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The words of big-endian 64-bit hashes, a row each, voted bit by bit: 1 if
    set in over half the rows; as signed integers. A long text is counted piece by
    piece, so that it takes no more memory than its hashes."""
    n, width = len(hashes), hashes.shape[1] * 8
    counts, at = np.zeros(width * 256, np.int64), (np.arange(width) * 256)[None, :]
    for lo in range(0, n, 4096):
        cells = hashes[lo : lo + 4096].view(np.uint8).reshape(-1, width) + at
        counts += np.bincount(cells.ravel(), minlength=width * 256)
    return np.packbits((counts.reshape(width, 256) @ _BYTE_BITS * 2 > n).ravel()).view(">i8").astype(np.int64)


def _shingle_digests(words: list[bytes], shingle: int) -> list[bytes]:
    from xxhash import xxh64_digest

    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_digest(joined, SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    return [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 without words."""
    digests = _shingle_digests(_words(text), shingle)
    return int(_majority(np.frombuffer(b"".join(digests), ">u8")[:, None])[0]) if digests else 0


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """n well-mixed hashes of each, side by side."""
    x = hashes[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(_mixed(hashes, n).astype(">u8"))


def _bands(shingles: np.ndarray) -> list[int]:
    """A key for each band of min-hashes of a set; two 32-bit hashes are taken from
    each mixed one, for some hundreds of shingles at a time."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 512):
        mixed = _mixed(shingles[lo : lo + 512], BANDS * BAND_ROWS // 2)
        np.minimum(least, mixed.view(np.uint32).min(axis=0), out=least)
    keys = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_prints(text: str | None, shingle: int = SHINGLE) -> tuple[list[int], list[int], list[int]]:
    """Fingerprints of the sets of words and of shingles of a text, zeros without
    words, and the keys of its bands, none without words."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    if not words:
        return [0] * WORD_PRINTS, [0] * SHINGLE_PRINTS, []
    each = np.array([xxh64_intdigest(w, SEED) for w in set(words)], np.uint64)
    digests = _shingle_digests(words, shingle)
    shingles = np.unique(np.frombuffer(b"".join(digests), "<u8"))
    return (
        _majority(_spread(each, WORD_PRINTS)).tolist(),
        _majority(_spread(shingles, SHINGLE_PRINTS)).tolist(),
        _bands(shingles),
    )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, fp long"
    )


def _parity(half: Column, mask: int) -> Column:
    return F.bit_count(half.bitwiseAND(F.lit(mask))) % 2


def _anchors(points: DataFrame) -> DataFrame:
    """(rep, anchor): the rows of ``points`` (rep, keys) at every anchor within
    covering radius plus threshold share, for both halves of each of the keys.

    The bits 1..31 of a half are positions of the Hamming code. With syndrome s,
    the nearest codeword flips position s; those at distance 2 flip the pairs of
    positions p, q with p xor q = s. ``step`` -1 is the nearest codeword with the
    carried bit flipped, 0 the nearest, and p the pair (p, p xor s).
    """
    keys = points.select("rep", F.posexplode("keys").alias("k", "fp"))
    halves = keys.select("rep", "fp", F.explode(F.expr("array(2 * k, 2 * k + 1)")).alias("half")).withColumn(
        "h", F.expr("if(half % 2 = 1, shiftrightunsigned(fp, 32), fp & 4294967295L)")
    )
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    syndrome = sum(
        (F.when(_parity(F.col("h"), m) == 1, F.lit(1 << j)).otherwise(F.lit(0)) for j, m in enumerate(masks)), F.lit(0)
    )
    steps = halves.withColumn("s", syndrome).select(
        "*", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("step")
    )
    flip = "shiftleft(1L, {} - 1)"
    nearest = f"(h ^ if(s = 0, 0L, {flip.format('greatest(s, 1)')}))"
    anchor = F.expr(
        f"CASE WHEN step = -1 THEN {nearest} ^ shiftleft(1L, 31) WHEN step = 0 THEN {nearest}"
        f" ELSE h ^ {flip.format('step')} ^ {flip.format('(step ^ s)')} END"
    )
    return steps.where("step <= 0 OR step < (step ^ s)").select(
        "rep", F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(anchor).alias("anchor")
    )


def _cells(replicas: DataFrame, cell: int) -> DataFrame:
    """Anchors with one point go; one with more than ``cell`` is split into g
    parts by hash and compared part against part, in g (g + 1) / 2 cells. Points
    are counted in a table of its own, so that the rows of a crowded anchor never
    have to meet: the join with it shuffles both sides, which can be split."""
    counts = written(replicas.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    parts = counts.select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("g"))
    parted = replicas.join(parts, "anchor").withColumn("part", F.expr("cast(pmod(xxhash64(rep), g) as int)"))
    return parted.select("rep", "anchor", "part", F.explode(F.expr("sequence(0, g - 1)")).alias("other")).select(
        "rep", "anchor", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )


class _Forest:
    """Union-find over the rows of a batch, in whole-array steps."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _cell_of(part: pd.DataFrame, key: list[str]) -> np.ndarray:
    at = part[key].to_numpy()
    return np.concatenate([[0], np.cumsum((at[1:] != at[:-1]).any(axis=1))])


def _near_pairs(part: pd.DataFrame, threshold: int, skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """Index arrays (a, b) of the rows of one cell whose prints differ in at most
    ``threshold`` bits, gap by gap. ``skip`` says which pairs needn't be looked at;
    pairs of one part meet in that part's own cell."""
    cell, prints = _cell_of(part, _CELL_KEY), np.stack(part["prints"].tolist()).view(np.uint64)
    side, own = part["part"].to_numpy(), part["i"].to_numpy() == part["j"].to_numpy()
    at, gap = np.arange(len(part)), 0
    while len(at):
        gap += 1
        at = at[at + gap < len(part)]
        at = at[cell[at] == cell[at + gap]]
        open_ = at[(own[at] | (side[at] != side[at + gap])) & ~skip(at, at + gap)]
        near = open_[np.bitwise_count(prints[open_] ^ prints[open_ + gap]).sum(axis=1, dtype=int) <= threshold]
        if len(near):
            yield near, near + gap


def _forest(part: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Edges that join what links within each cell: at most one for each row."""
    forest, rep = _Forest(len(part)), part["rep"].to_numpy()
    for a, b in _near_pairs(part, threshold, lambda a, b: forest.root[a] == forest.root[b]):
        forest.unite(a, b)
    moved = np.flatnonzero(forest.root != np.arange(len(part)))
    return pd.DataFrame({"a": rep[moved], "b": rep[forest.root[moved]]})


def _with_neighbour(part: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """The rows that have another within the threshold in their cell."""
    found = np.zeros(len(part), bool)
    for a, b in _near_pairs(part, threshold, lambda a, b: found[a] & found[b]):
        found[a] = found[b] = True
    return part.loc[found, ["rep", "anchor", "part", "i", "j"]]


_CELL_KEY = ["anchor", "i", "j"]


def _by_cell(cells: DataFrame, treat: Callable[[pd.DataFrame], pd.DataFrame], key: list[str], schema: str) -> DataFrame:
    """``treat`` applied to batches of whole cells; a cell has a bounded number of rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if batch.empty:
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held[key].iloc[-1].to_numpy()
            whole = (held[key].to_numpy() != last).any(axis=1)
            if whole.any():  # the last cell may go on in the next batch
                yield treat(held[whole].reset_index(drop=True))
                held = held[~whole].reset_index(drop=True)
        if held is not None:
            yield treat(held)

    return cells.repartition(*key).sortWithinPartitions(*key, "rep").mapInPandas(frugal(each), schema)


def link_edges(points: DataFrame, threshold: int = THRESHOLD, cell: int = CELL, unlike: int | None = None) -> DataFrame:
    """Edges (a, b) between points that share an anchor by one of their ``keys``
    and whose ``sketch`` differs in at most ``threshold`` bits: a spanning forest
    of the links of every comparison cell, whose components are those of all
    links. ``points``: distinct rep, keys array<bigint>, sketch array<bigint>.

    With ``unlike``, points meet first by their keys, which are short, and only
    those with another within that many differing bits bring their sketches.
    Points that have ``bands`` (array<bigint>) also meet where they share one,
    however unlike their keys.
    """
    cells = _cells(_anchors(points), cell)
    if unlike is not None:
        keyed = cells.join(points.select("rep", F.col("keys").alias("prints")), "rep")
        near = lambda part: _with_neighbour(part, unlike)
        cells = _by_cell(keyed, near, _CELL_KEY, "rep long, anchor long, part int, i int, j int")
    if "bands" in points.columns:
        cells = cells.unionByName(_cells(points.select("rep", F.explode("bands").alias("anchor")), cell))
    sketched = cells.join(points.select("rep", F.col("sketch").alias("prints")), "rep")
    return _by_cell(sketched, lambda part: _forest(part, threshold), _CELL_KEY, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, cell: int = CELL
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links. Null and empty
    texts have fingerprint zero and link like any other. Equal fingerprints are
    one class from the start; copies are never expanded into pairs. Rows are what
    links, not doc_ids: rows that share a doc_id or have none are as any others,
    and component_id is null where no row of a component has one. Other columns
    are ignored; an empty table gives an empty table.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("the covering holds for thresholds from 0 to 4")
    fps = written(fingerprints(docs, shingle), "simhash")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    points = reps.select(F.col("fp").alias("rep"), F.array("fp").alias("keys"), F.array("fp").alias("sketch"))

    def joined() -> DataFrame:
        parts = connected_components(link_edges(points, threshold, cell))
        comps = reps.join(parts, F.col("fp") == F.col("node"), "left")
        comps = written(comps.select("fp", "least", F.coalesce("component", "fp").alias("comp")), "simhash-comps")
        least = written(comps.groupBy("comp").agg(F.min("least").alias("component_id")), "simhash-least")
        return comps.join(least, "comp").select("fp", "component_id")

    classes = written_alone(docs.sparkSession, "simhash-classes", joined)
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def _bits(similarity: float) -> int:
    """Differing bits of two shingle fingerprints up to which their sets may be
    alike: what sets of that Jaccard likeness j, whose cosine is 2 j / (1 + j),
    differ in on average and four standard deviations more, which one pair in
    30,000 at that very likeness exceeds. Sets are compared exactly below."""
    width = 64 * SHINGLE_PRINTS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(width * p + 4 * math.sqrt(width * p * (1 - p)))


def _alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets, sorted 64-bit hashes, have that Jaccard likeness; two
    empty sets are alike."""
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) < similarity * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = n + m - len(np.union1d(x, y))
    return common >= similarity * (n + m - common)


def _sets_of(members: DataFrame, shingle: int) -> DataFrame:
    """(rep, comp, shingles): the shingle set of each member's whole text, sorted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            sets = []
            for text in batch.column(2):
                digests = _shingle_digests(_words(text.as_py()), shingle)
                sets.append(np.unique(np.frombuffer(b"".join(digests), "<u8")).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["rep", "comp", "shingles"])

    return members.select("rep", "comp", "text").mapInArrow(frugal(each), "rep long, comp long, shingles binary")


def _verify(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Edges between the open rows of a cell (``mine``) and all its rows, where the
    sets are alike; rows whose link to their leader is known are one from the start."""
    cell, rep = _cell_of(part, _SET_KEY), part["rep"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    mine, known = part["mine"].to_numpy(bool), part["linked"].to_numpy(bool)
    bounds = np.searchsorted(cell, np.arange(cell[-1] + 2))
    a, b = [], []
    for lo, hi in zip(bounds, bounds[1:]):
        forest = _Forest(hi - lo)
        led = np.flatnonzero(known[lo:hi])
        if len(led):
            forest.unite(np.repeat(led[:1], len(led)), led)
        for i, like in _alike_rows(sets[lo:hi], np.flatnonzero(mine[lo:hi]), similarity):
            like = like[forest.root[like] != forest.root[i]]
            _, one_each = np.unique(forest.root[like], return_index=True)
            like = like[one_each]
            if len(like):
                a += [rep[lo + i]] * len(like)
                b += rep[lo + like].tolist()
                forest.unite(np.repeat(i, len(like)), like)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _alike_rows(sets: list[np.ndarray], asked: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row asked for, the other rows whose sets are alike. What all rows
    have in common with it is counted at once, over the lists of the rows that
    hold each of its elements."""
    sizes = np.array(list(map(len, sets)))
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(element, kind="stable")]
    n_holders = np.bincount(element, minlength=1)
    first = np.cumsum(n_holders) - n_holders
    for i in asked.tolist():
        own = element[ends[i] - sizes[i] : ends[i]]
        n = n_holders[own]
        at = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
        common = np.bincount(holders[at], minlength=len(sets))
        like = common >= similarity * (sizes[i] + sizes - common)
        like[i] = False
        yield i, np.flatnonzero(like)


_SET_KEY = ["comp", "p", "q"]


def _exact_edges(texts: DataFrame, coarse: DataFrame, shingle: int, similarity: float, cell: int) -> DataFrame:
    """Edges (a, b) of exact likeness that give the components of all of them
    within each component of ``coarse`` (rep, comp); ``texts``: rep, text.

    First every member is compared with its component's leader, its least rep: a
    step linear in the members, after which most groups are joined. Only members
    that are not like their leader go on, to be compared with all members of
    their component, part against part; a part is bounded in rows and bytes.
    """
    sets = written(_sets_of(coarse.join(texts, "rep"), shingle), "sets")
    leaders = sets.where("rep = comp").select("comp", F.col("shingles").alias("lead"))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_alike(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], names=["rep", "comp", "linked"])

    stars = sets.join(leaders, "comp").select("rep", "comp", "shingles", "lead").mapInArrow(
        led, "rep long, comp long, linked boolean"
    )
    stars = written(stars, "leaders")
    star_edges = stars.where("linked AND rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    # components with members that their leader isn't like, and how many parts those and all members make
    sized = sets.select("rep", "comp", F.octet_length("shingles").alias("bytes")).join(stars.select("rep", "linked"), "rep")
    open_ = F.col("linked") == F.lit(False)
    parts = sized.groupBy("comp").agg(
        F.ceil(F.greatest(F.count("*") / cell, F.sum("bytes") / SET_BYTES)).cast("int").alias("ps"),
        F.ceil(F.greatest(F.count_if(open_) / cell, F.sum(F.when(open_, F.col("bytes"))) / SET_BYTES)).cast("int").alias("qs"),
        F.count_if(open_).alias("n_open"),
    )
    parts = written(parts.where("n_open > 0").select("comp", F.greatest("ps", F.lit(1)).alias("ps"), F.greatest("qs", F.lit(1)).alias("qs")), "parts")
    left = sets.join(stars.select("rep", "linked"), "rep").join(parts, "comp")
    deal = "cast(pmod(xxhash64(rep, {}), {}) as int)"
    cols = ["rep", "comp", "p", "q", "shingles", "linked", "mine"]
    every = left.withColumn("p", F.expr(deal.format("'p'", "ps"))).withColumn("q", F.explode(F.expr("sequence(0, qs - 1)")))
    every = every.withColumn("mine", F.lit(False)).select(*cols)
    asked = left.where(open_).withColumn("q", F.expr(deal.format("'q'", "qs"))).withColumn("p", F.explode(F.expr("sequence(0, ps - 1)")))
    asked = asked.withColumn("mine", F.lit(True)).select(*cols)
    rest = _by_cell(every.unionByName(asked), lambda part: _verify(part, similarity), _SET_KEY, "a long, b long")
    return star_edges.unionByName(rest).distinct()


def _labelled(rows: DataFrame, shingle: int, similarity: float, cell: int) -> DataFrame:
    """(row, doc_id, comp) for every row of ``rows`` (row, doc_id, text), where row
    is unique and comp is the least row of those that it reaches over links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            prints = [set_prints(x.as_py(), shingle) for x in batch.column(2)]
            columns = [pa.array([p[i] for p in prints], pa.list_(pa.int64())) for i in range(3)]
            same = [xxh3_128_digest(np.array(p[0] + p[1] + p[2], np.int64).tobytes()) for p in prints]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(same, pa.binary()), *columns],
                names=["row", "doc_id", "same", "keys", "sketch", "bands"],
            )

    schema = "row long, doc_id long, same binary, keys array<bigint>, sketch array<bigint>, bands array<bigint>"
    prints = written(rows.select("row", "doc_id", "text").mapInArrow(frugal(each), schema), "simhash-sets")
    reps = prints.groupBy("same").agg(F.min("row").alias("rep"))
    every = prints.select(F.col("row").alias("rep"), "keys", "sketch", "bands")
    points = written(every.join(reps.select("rep"), "rep"), "simhash-points")
    coarse = connected_components(link_edges(points, _bits(similarity), cell, UNLIKE_WORDS))
    coarse = coarse.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    texts = rows.select(F.col("row").alias("rep"), "text")
    parts = connected_components(_exact_edges(texts, coarse, shingle, similarity, max(1, cell // SET_SHARE)))
    classes = reps.join(parts, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("comp"))
    return prints.select("row", "doc_id", "same").join(classes, "same").select("row", "doc_id", "comp")


def similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text, ...), where
    rows link whose shingle sets have a Jaccard likeness of ``similarity`` or more.

    component_id is the smallest doc_id that a row reaches over links, null if
    none of them has one. Rows are what links, not doc_ids: rows that share a
    doc_id or have none are as any others. Texts with equal fingerprints of 1,088
    bits and equal bands are one class from the start. Null texts and texts
    without words are alike; of fewer words than a shingle the whole sequence is
    one. Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = written_alone(
        docs.sparkSession, "simhash-found", lambda: _labelled(written(rows, "simhash-rows"), shingle, similarity, cell)
    )
    least = written(found.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    return found.join(least, "comp").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each component of ``similar``: of those with the
    smallest doc_id (null last) one, whichever text it has. So identical rows, rows
    without a doc_id and rows that share one are treated as any others. Columns
    stay as they are, whatever their names; an empty table stays empty."""
    rows = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "simhash-rows")
    keyed = rows.select(F.col(_ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written_alone(docs.sparkSession, "simhash-found", lambda: _labelled(keyed, shingle, similarity, cell))
    # rows in components of several, of which all but one go
    many = found.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("keeper"), F.count("*").alias("n")
    )
    many = written(many.where("n > 1").select("comp", "keeper"), "simhash-kept")
    gone = found.join(many, "comp").where("row <> keeper").select(F.col("row").alias(_ROW))
    return rows.join(gone, _ROW, "left_anti").select(*docs.columns)


_ROW = "__simhash_row"


def op1_simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents by 4-word shingles: see
    ``near_duplicates`` for nulls, empty texts, ties and repeated rows."""
    found = near_duplicates(docs, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
