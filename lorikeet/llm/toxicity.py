"""Toxicity by a factorization machine over hashed terms.

A term is a word or the beginning of one, so that inflected insults share
terms; terms are hashed into buckets, and a document has the set of its buckets.
The machine adds to the linear weights a weight for every pair of buckets, as
the product of two short vectors, so a pair such as an insult with a group can
weigh more than its parts. It is fitted on a bounded sample of labelled rows in
one task, over every bucket that the sample has; every document is scored over
its whole text where it lies.

What keeps chance out are penalties, not cuts. A bucket enters the linear part at
a scale that follows from how far its shares in the two classes lie apart, so one
that tells little needs a large weight and pays for it; vectors shrink toward
zero unless pairs need them, and a bucket that tells nothing alone can still do so
with another.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorikeet.llm.common import frugal, give_back, scratch_scope, written

#: Buckets that terms are hashed into, and lengths of the beginnings of words.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6)
#: Labelled rows of each class that the machine is fitted on, at most.
SAMPLE = 6000
#: |z| of the difference between the classes at which a bucket enters at half its scale.
HALF_Z = 8.0
#: Square penalties of weights and vectors against the loss of all rows together, so that few rows prove little,
#: and the step by which vectors shrink.
WEIGHT_PENALTY, VECTOR_PENALTY, VECTOR_SHRINK = 1.0, 10.0, 0.05
#: Length of the vectors of the pairwise part, steps of the fit, and rows of a step.
RANK, STEPS, ROWS = 4, 450, 256
#: Score from which a document is called toxic.
CUT = 0.3
#: Words whose buckets a Python worker keeps.
KEPT_WORDS = 60_000

_words = re.compile(r"[^\W_]+").findall


def buckets_of(word: str) -> tuple[int, ...]:
    """The distinct buckets of a lower-case word: of itself and of its beginnings."""
    terms = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms})


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """bias + sum of w over a document's buckets + sum over pairs of <v, v'>, with a
    row of w and v for every bucket; buckets that were never seen have zeros."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray) -> float:
        v = self.v[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.w[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(sets: list[np.ndarray], y: np.ndarray, prior: float, n: int = BUCKETS, steps: int = STEPS, seed: int = 0) -> Machine:
    """The machine for rows with the buckets ``sets`` (below ``n``) and classes ``y``
    (0 and 1, both there), by Adam on the logistic loss in steps that shrink.

    Only the buckets of a step's rows are read, all of them; beside ``sets`` four
    bytes are held for each bucket of each row. ``prior``: the share of
    the class among all labelled rows, to which the bias is corrected from the
    share in the sample.
    """
    ends = np.cumsum([0, *map(len, sets)])
    y, flat, seen = np.asarray(y, np.float64), np.zeros(ends[-1], np.int32), np.zeros(n, bool)
    for at in sets:
        seen[at] = True
    used = np.flatnonzero(seen)
    k = len(used)
    place = np.zeros(n, np.int32)
    place[used] = np.arange(k)
    pos, neg = np.zeros(k), np.zeros(k)
    for lo in range(0, len(sets), ROWS):  # by a few rows, so that no wide copy of all is made
        part = np.concatenate(sets[lo : lo + ROWS])
        part = place[part.astype(np.int64)]
        of = np.repeat(y[lo : lo + ROWS], np.diff(ends[lo : lo + ROWS + 1]))
        flat[ends[lo] : ends[lo] + len(part)] = part
        pos += np.bincount(part, of, k)
        neg += np.bincount(part, 1 - of, k)
    n_pos, n_neg = y.sum(), (1 - y).sum()
    mid = (pos + neg) / len(y)
    z2 = (pos / n_pos - neg / n_neg) ** 2 / (np.maximum(mid * (1 - mid), 1e-9) * (1 / n_pos + 1 / n_neg))
    scale = (z2 / (z2 + HALF_Z**2)).astype(np.float32)
    # in pairs a bucket that hardly any row has, or hardly any lacks, tells less
    evenness = (2 * np.sqrt(mid * (1 - mid))).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(k, np.float32), rng.normal(0, 0.01, (RANK, k)).astype(np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.zeros(0, int)
    for t in range(1, steps + 1):
        if len(order) < min(ROWS, len(y)):
            order = rng.permutation(len(y))
        rows, order = order[:ROWS], order[ROWS:]
        sizes = ends[rows + 1] - ends[rows]
        seg = np.repeat(np.arange(len(rows)), sizes)
        i = flat[np.arange(sizes.sum()) + np.repeat(ends[rows] - (np.cumsum(sizes) - sizes), sizes)].astype(np.int64)
        bias, w, v = params
        at_scale, at_even = scale[i], evenness[i]
        part = v[:, i] * at_even
        sums = np.stack([np.bincount(seg, x, len(rows)) for x in part])
        squares = np.bincount(seg, (part**2).sum(axis=0), len(rows))
        score = bias[0] + np.bincount(seg, w[i] * at_scale, len(rows)) + 0.5 * ((sums**2).sum(axis=0) - squares)
        g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) / len(rows)
        gi, pull = g[seg], sums[:, seg] - part
        slopes = [
            g.sum(keepdims=True),
            np.bincount(i, gi * at_scale, k) + WEIGHT_PENALTY / len(y) * w,
            np.stack([np.bincount(i, gi * at_even * x, k) for x in pull]) + VECTOR_PENALTY / len(y) * v,
        ]
        rate = 0.03 * (1 - 0.9 * t / steps)
        for value, slope, m, q in zip(params, slopes, mean, square):  # Adam, in place
            slope = slope.astype(np.float32)
            m += 0.1 * (slope - m)
            q += 0.001 * (slope * slope - q)
            value -= (rate / (1 - 0.9**t)) * m / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        size = np.abs(v)
        v *= np.maximum(size - rate * VECTOR_SHRINK, 0) / np.maximum(size, 1e-30)
    share = n_pos / len(y)
    w, v = np.zeros(n, np.float32), np.zeros((n, RANK), np.float32)
    w[used], v[used] = params[1] * scale, (params[2] * evenness).T
    return Machine(float(params[0][0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))), w, v)


def _constant(rate: float) -> Machine:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(rate / (1 - rate))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))


def _in_order(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets and classes of rows (doc_id, y, at), by doc_id and y; the buckets
    are views of the table's own memory."""
    sets = [x for c in part["at"].chunks for x in np.split(c.flatten().to_numpy(), c.value_lengths().to_numpy().cumsum()[:-1]) if len(c)]
    y = part["y"].to_numpy()
    order = np.lexsort((y, part["doc_id"].to_numpy()))
    return [sets[k] for k in order], y[order]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine for ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    Held-out rows are left aside. Of each class, the ``sample`` rows with the
    least hash of doc_id are learnt from; this bound, known beforehand, is what
    lets their ids be broadcast and the fit run in one task. Of documents that
    share a doc_id the one with the least hash of its text is learnt from. A
    doc_id labelled several times is toxic if any label says so; null doc_ids and
    labels teach nothing, null texts are empty. Without both classes the machine
    gives the share of the class to every document (one millionth at least).

    What reaches the driver is the machine, five numbers for each of BUCKETS.
    """
    with scratch_scope(docs.sparkSession):
        return _trained(docs, labels, sample)


def _trained(docs: DataFrame, labels: DataFrame, sample: int) -> Machine:
    known = written(
        labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y")),
        "toxicity-labels",
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return _constant(totals.get(1, 0) / max(1, sum(totals.values())))
    picks = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = picks[0].union(picks[1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for x in batch.column(2):
                words = set(_words((x.as_py() or "").lower()))
                sets.append(sorted({b for w in words for b in buckets_of(w)}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "y", "at"])

    # at most 2 x sample rows of two numbers: a proven bound
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    single = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    rows = written(
        single.select("doc_id", "y", "least.text").mapInArrow(frugal(each), "doc_id long, y int, at array<int>"),
        "toxicity",
    )
    prior = totals[1] / (totals[0] + totals[1])
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return _constant(prior)

    def learn(part: pa.Table) -> pa.Table:
        made = fit(*_in_order(part), prior)
        give_back()
        return pa.table({"bias": [made.bias], "w": [made.w.tobytes()], "v": [made.v.tobytes()]})

    got = rows.groupBy().applyInArrow(learn, "bias double, w binary, v binary").first()
    return Machine(got["bias"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(-1, RANK))


def score(docs: DataFrame, machine: Machine, out: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``out``, 0 to 1, of every whole text; an
    empty or null text gets the score of no terms. A column of that name is
    replaced, all others stay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            scores = []
            for x in batch.column(batch.schema.get_field_index("text")):
                at: set[int] = set()
                for word in set(_words((x.as_py() or "").lower())):
                    found = kept.get(word)
                    if found is None:
                        found = buckets_of(word)
                        if len(kept) < KEPT_WORDS:
                            kept[word] = found
                    at.update(found)
                scores.append(machine.score(np.array(sorted(at), np.int64)))
            yield batch.append_column(out, pa.array(scores, pa.float64()))

    base = docs.drop(out)
    return base.mapInArrow(frugal(each), T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` whose score is below ``cut``, with their columns as they are, whatever
    their names. Null and empty texts have the score of no terms, rows are judged
    one by one, and an empty table stays empty; for labels see ``train``."""
    scored = score(docs, train(docs.select("doc_id", "text"), labels), "__toxicity_score")
    return scored.where(F.col("__toxicity_score") < cut).select(*docs.columns)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents: see ``train`` for labels
    and repeated doc_ids, ``score`` for null and empty texts; a null doc_id isn't
    held out, and has no label."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(rows, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
