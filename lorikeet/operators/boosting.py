"""Softmax gradient boosting over quantile histograms (C-20).

Features are cut into bins once. Each round grows one tree for every class, level
by level: gradients and hessians are summed by (class, node, feature, bin), in each
task and then in Spark, and from these sums alone, whose number the parameters
bound, the driver picks the splits. Sums are of integers, so they and the trees don't depend on the
order of rows. Trees are complete and stand in arrays; tasks walk them for a batch
of rows at a time.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Gradients and hessians count in units of 2^-20.
UNIT = 1 << 20


@dataclasses.dataclass(frozen=True)
class Boosted:
    """Trees of ``depth``, one a class and round: inner node i of tree t stands at
    t * (2^depth - 1) + i, its children are 2i + 1 and 2i + 2, and a row goes right
    when its bin of ``feature`` is above ``split``; leaves stand at t * 2^depth on."""

    classes: tuple[str, ...]
    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    depth: int
    feature: tuple[int, ...] = ()
    split: tuple[int, ...] = ()
    leaf: tuple[float, ...] = ()

    @property
    def rounds(self) -> int:
        return len(self.leaf) // (len(self.classes) << self.depth)

    def bins(self) -> Column:
        """array<int>: how many cuts of each feature lie below its value; null is below all."""
        below = lambda name, cuts: F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name).cast("double"))), F.lit(0))
        return F.array(*[below(n, c) if c else F.lit(0) for n, c in zip(self.features, self.cuts)])


def predicted(rows: DataFrame, model: Boosted, key: str, out: str) -> DataFrame:
    """(``key``, ``out``): the class with the highest score, the sum of its leaves;
    of equal ones the first by name. Null features are below all cuts, NaN above."""
    k = len(model.classes)
    features, splits, leaf, depth = np.array(model.feature, np.int64), np.array(model.split, np.int64), np.array(model.leaf), model.depth
    cuts, classes, rounds = [np.array(c) for c in model.cuts], np.array(model.classes, object), model.rounds
    names = _names("f", len(cuts))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = np.stack([np.searchsorted(c, batch[n].to_numpy()) for c, n in zip(cuts, names)], axis=1)
            scores = np.zeros((len(batch), k))
            for t in range(rounds * k):
                scores[:, t % k] += leaf[(t << depth) + _places(bins, features, splits, t, depth, depth)]
            yield pd.DataFrame({key: batch[key], out: classes[scores.argmax(axis=1)]})

    values = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias(n) for f, n in zip(model.features, names)]
    return rows.select(key, *values).mapInPandas(each, f"{key} {rows.schema[key].dataType.simpleString()}, {out} string")


def quantile_cuts(rows: DataFrame, features: Sequence[str], n_bins: int) -> tuple[tuple[float, ...], ...]:
    """Distinct inner quantiles of each feature; exact for up to 10,000 rows."""
    at = [i / n_bins for i in range(1, n_bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in features]).first()
    return tuple(tuple(sorted({c for c in found[f] or [] if c == c})) for f in features)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / sum(e[:, c] for c in range(e.shape[1]))[:, None]


def _places(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, tree: int, depth: int, steps: int) -> np.ndarray:
    """The places within its level that the rows of a batch reach after some steps down a tree."""
    at = np.zeros(len(bins), np.int64)
    for level in range(steps):
        node = tree * ((1 << depth) - 1) + ((1 << level) - 1) + at
        at = at * 2 + (bins[np.arange(len(bins)), feature[node]] > split[node])
    return at


def _names(letter: str, n: int) -> list[str]:
    return [f"{letter}{i}" for i in range(n)]


def _sums(state: DataFrame, n_classes: int, n_bins: int, n_features: int, depth: int, level: int, feature: list, split: list) -> np.ndarray:
    """[g and h, class, node of the level, feature, bin]: integer sums. A task adds
    up its own rows, batch by batch, into an array of that shape; Spark adds these."""
    features, splits, shape = np.array(feature), np.array(split), (2, n_classes, 1 << level, n_features, n_bins)
    bin_names, score_names = _names("b", n_features), _names("s", n_classes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(shape, np.int64)
        for batch in batches:
            bins, label = batch[bin_names].to_numpy(), batch["label"].to_numpy()
            p = _softmax(batch[score_names].to_numpy())
            for c in range(n_classes):
                node = _places(bins, features, splits, c, depth, level) * n_bins
                g = np.rint((p[:, c] - (label == c)) * UNIT)
                h = np.maximum(np.rint(p[:, c] * (1 - p[:, c]) * UNIT), 1.0)
                for f in range(n_features):
                    for i, x in enumerate((g, h)):  # whole numbers below 2^53
                        found = np.bincount(node + bins[:, f], x, n_bins << level)
                        out[i, c, :, f] += found.astype(np.int64).reshape(-1, n_bins)
        at = np.nonzero(out[1])
        yield pd.DataFrame(dict(zip(("c", "node", "f", "bin"), at)) | {"g": out[0][at], "h": out[1][at]})

    parts = state.mapInPandas(each, "c int, node int, f int, bin int, g long, h long")
    out = np.zeros(shape, np.int64)
    for c, node, f, b, g, h in parts.groupBy("c", "node", "f", "bin").agg(F.sum("g"), F.sum("h")).collect():
        out[:, c, node, f, b] = g, h
    return out


def _raised(state: DataFrame, step: Boosted) -> DataFrame:
    """``state`` with the leaves of one round's trees added to the scores."""
    bin_names, score_names = _names("b", len(step.features)), _names("s", len(step.classes))
    features, splits, leaf, depth = np.array(step.feature), np.array(step.split), np.array(step.leaf), step.depth

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = batch[bin_names].to_numpy()
            yield batch.assign(**{s: batch[s] + leaf[(c << depth) + _places(bins, features, splits, c, depth, depth)] for c, s in enumerate(score_names)})

    return state.mapInPandas(each, state.schema)


def _best_splits(sums: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, leaves) of each class and node: the split with the greatest
    gain, of equal ones that of the first feature and lowest bin; a node without
    one sends all rows left. Leaves are the values of both children."""
    g, h = sums.astype(np.float64) / UNIT
    total_g, total_h = g[:, :, 0].sum(axis=-1), h[:, :, 0].sum(axis=-1)
    left_g, left_h = np.cumsum(g, axis=-1), np.cumsum(h, axis=-1)
    right_g, right_h = total_g[..., None, None] - left_g, total_h[..., None, None] - left_h
    score = lambda a, b: a * a / (b + penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[..., None, None]
    gain[(left_h < least) | (right_h < least)] = -np.inf
    gain[..., -1] = -np.inf
    n_classes, nodes, n_features, n_bins = gain.shape
    flat = gain.reshape(n_classes, nodes, -1)
    best = flat.argmax(axis=-1)
    none = flat.max(axis=-1) <= 1e-9
    feature, cut = np.where(none, 0, best // n_bins), np.where(none, n_bins - 1, best % n_bins)
    take = lambda x: np.take_along_axis(x.reshape(n_classes, nodes, -1), (feature * n_bins + cut)[..., None], -1)[..., 0]
    a, b = take(left_g), take(left_h)
    leaves = np.stack([-a / (b + penalty), -(total_g - a) / (total_h - b + penalty)], axis=-1)
    return feature, cut, leaves


def fit(
    rows: DataFrame, features: Sequence[str], label: str, known: Sequence[str] = (), rounds: int = 10, depth: int = 3,
    n_bins: int = 64, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0,
) -> Boosted:
    """Trees over ``features`` for the classes of ``label`` and those ``known`` before.

    Rows without a label are ignored; a null feature is below all others, NaN
    above. ``penalty`` shrinks leaves, ``least`` is the hessian that a child needs.
    The driver sees classes x 2^(depth - 1) x features x n_bins sums at a time.
    """
    rows = rows.where(F.col(label).isNotNull())
    classes = tuple(sorted({r[0] for r in rows.select(F.col(label).cast("string")).distinct().collect()} | set(known)))
    model = Boosted(classes, tuple(features), quantile_cuts(rows, features, n_bins), depth)
    if not classes:
        raise ValueError("there are no labels to learn from")
    k, inner = len(classes), (1 << depth) - 1
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")).cast("int") - 1
    base = rows.select(model.bins().alias("bins"), at.alias("label"))
    base = base.select("label", *[F.get("bins", F.lit(i)).alias(b) for i, b in enumerate(_names("b", len(features)))], *[F.lit(0.0).alias(n) for n in _names("s", k)])
    state, held = base, []
    try:
        for _ in range(rounds):
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            feature, split, leaf = [0] * (k * inner), [n_bins] * (k * inner), [0.0] * (k << depth)
            for level in range(depth):
                sums = _sums(state, k, n_bins, len(features), depth, level, feature, split)
                chosen, cut, leaves = _best_splits(sums, penalty, least)
                for c in range(k):
                    for node in range(1 << level):
                        place = c * inner + (1 << level) - 1 + node
                        feature[place], split[place] = int(chosen[c, node]), int(cut[c, node])
                        if level == depth - 1:
                            leaf[(c << depth) + 2 * node : (c << depth) + 2 * node + 2] = (rate * leaves[c, node]).tolist()
            step = dataclasses.replace(model, feature=tuple(feature), split=tuple(split), leaf=tuple(leaf))
            state = _raised(state, step)
            model = dataclasses.replace(
                model, feature=model.feature + step.feature, split=model.split + step.split, leaf=model.leaf + step.leaf
            )
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
    finally:
        for old in held:
            old.unpersist()
    return model


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """The model as one JSON line, in whatever store Spark writes to."""
    spark.createDataFrame([(json.dumps(dataclasses.asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    made = json.loads(spark.read.text(path).first()[0])
    return Boosted(**{k: tuple(map(tuple, v)) if k == "cuts" else tuple(v) if isinstance(v, list) else v for k, v in made.items()})
