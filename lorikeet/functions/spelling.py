"""Phonemes of words that no lexicon lists (B-20, U-02).

Letters and phonemes of a lexicon are aligned by expectation maximisation over
units of one letter and up to two phonemes, or two letters and one phoneme. The
best alignments give a joint bigram model of units, and an unseen word gets the
phonemes of its most probable sequence of units. Spark holds the words and adds
up the counts; the driver sees counts of distinct units and pairs of units, whose
number follows from the alphabets and not from the number of words.
"""

from __future__ import annotations

import dataclasses
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.functions.phonetics import with_phonemes

#: Letters and phonemes of a unit, in the order that decides between equal alignments.
SHAPES = ((1, 1), (2, 1), (1, 0), (1, 2))
START, END = "^", "$"
#: What is taken off each seen pair of units and shared among all that may follow.
DISCOUNT = 0.5
#: Of a letter that no unit has, and of a unit where none was seen.
FLOOR = 1e-6

Unit = str  # letters, a colon, phonemes with spaces between


def _unit(letters: str, phonemes: list[str]) -> Unit:
    return f"{letters}:{' '.join(phonemes)}"


def _letters(unit: Unit) -> str:
    return unit.rpartition(":")[0]


def _edges(word: str, phonemes: list[str]) -> Iterator[tuple[tuple[int, int], tuple[int, int], Unit]]:
    """The steps between places (letters read, phonemes read), from the start on."""
    for i in range(len(word)):
        for j in range(len(phonemes) + 1):
            for a, b in SHAPES:
                if i + a <= len(word) and j + b <= len(phonemes):
                    yield (i, j), (i + a, j + b), _unit(word[i : i + a], phonemes[j : j + b])


def expected_units(word: str, phonemes: list[str], share: dict[Unit, float] | None) -> dict[Unit, float]:
    """How often each unit is expected in the alignments of a word, given the
    shares of units (None: all alike); empty where no alignment exists."""
    edges = list(_edges(word, phonemes))
    weight = lambda u: 1.0 if share is None else share.get(u, 0.0)
    before, after = defaultdict(float), defaultdict(float)
    before[0, 0] = after[len(word), len(phonemes)] = 1.0
    for x, y, u in edges:  # places come in rising order, so what leads to x is complete
        before[y] += before[x] * weight(u)
    for x, y, u in reversed(edges):
        after[x] += weight(u) * after[y]
    total, out = after[0, 0], defaultdict(float)
    if total > 0:
        for x, y, u in edges:
            out[u] += before[x] * weight(u) * after[y] / total
    return {u: n for u, n in out.items() if n > 0}


def best_units(word: str, phonemes: list[str], share: dict[Unit, float]) -> list[Unit]:
    """The most probable alignment; empty where there is none."""
    best: dict[tuple[int, int], tuple[float, tuple | None, Unit]] = {(0, 0): (0.0, None, "")}
    for x, y, u in _edges(word, phonemes):
        if x in best and share.get(u, 0.0) > 0:
            score = best[x][0] + math.log(share[u])
            if y not in best or score > best[y][0] + 1e-12:
                best[y] = (score, x, u)
    at, out = (len(word), len(phonemes)), []
    while at in best and best[at][1] is not None:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


@dataclasses.dataclass(frozen=True)
class Spelling:
    """Counts of units and of pairs of neighbouring units in the aligned lexicon."""

    units: dict[Unit, int]
    pairs: dict[tuple[Unit, Unit], int]

    def __post_init__(self):
        from_, kinds, by_letters = defaultdict(int), defaultdict(int), defaultdict(list)
        for (a, _), n in self.pairs.items():
            from_[a] += n
            kinds[a] += 1
        for u in sorted(self.units):
            by_letters[_letters(u)].append(u)
        # a mark counts in the same total as units, since it follows one
        ends = sum(n for (_, b), n in self.pairs.items() if b == END)
        object.__setattr__(self, "_from", dict(from_))
        object.__setattr__(self, "_kinds", dict(kinds))
        object.__setattr__(self, "_by_letters", dict(by_letters))
        object.__setattr__(self, "_ends", ends)
        object.__setattr__(self, "_total", sum(self.units.values()) + ends)

    def log_share(self, before: Unit, unit: Unit) -> float:
        """Of a unit (or the end) behind another, by absolute discounting."""
        seen = self._ends if unit == END else self.units.get(unit, 0)
        alone = seen / self._total if seen else FLOOR / max(self._total, 1)
        n = self._from.get(before, 0)
        if not n:
            return math.log(alone)
        kept = max(self.pairs.get((before, unit), 0) - DISCOUNT, 0.0)
        return math.log((kept + DISCOUNT * self._kinds[before] * alone) / n)

    def options(self, word: str, at: int) -> list[Unit]:
        """The units that may stand at a place; a letter without any is silent."""
        found = [u for n in (1, 2) if at + n <= len(word) for u in self._by_letters.get(word[at : at + n], ())]
        return found if any(_letters(u) == word[at] for u in found) else [*found, _unit(word[at], [])]

    def phonemes(self, word: str) -> list[str]:
        """Those of the most probable units; of equal ones the first by unit."""
        states: list[dict[Unit, tuple[float, Unit | None]]] = [{} for _ in range(len(word) + 1)]
        states[0][START] = (0.0, None)
        for at in range(len(word)):
            for before, (score, _) in sorted(states[at].items()):
                for unit in self.options(word, at):
                    new = score + self.log_share(before, unit)
                    to = states[at + len(_letters(unit))]
                    if unit not in to or new > to[unit][0] + 1e-12:
                        to[unit] = (new, before)
        ends = [(-(s + self.log_share(u, END)), u) for u, (s, _) in states[-1].items()]
        if not ends:
            return []
        least = min(ends)[0]
        unit, at, out = min(u for s, u in ends if s <= least + 1e-12), len(word), []
        while unit != START:
            letters, _, said = unit.rpartition(":")
            out.append(said)
            unit, at = states[at][unit][1], at - len(letters)
        return [p for said in reversed(out) for p in said.split()]


def fit(lexicon: DataFrame, rounds: int = 8) -> Spelling:
    """The model of ``lexicon`` (word, phonemes array<string>, ...). Words count in
    lower case, each row alike; rows without a word or phonemes, and those that no
    units align (more than two phonemes a letter), teach nothing."""
    rows = lexicon.where("word <> '' AND size(phonemes) > 0").select(F.lower("word").alias("word"), "phonemes")
    share: dict[Unit, float] | None = None
    for _ in range(rounds):

        def expected(batches: Iterator[pd.DataFrame], share=share) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total = defaultdict(float)
                for word, phonemes in zip(batch["word"], batch["phonemes"]):
                    for u, n in expected_units(word, list(phonemes), share).items():
                        total[u] += n
                yield pd.DataFrame({"unit": list(total), "n": list(total.values())}).astype({"unit": object, "n": float})

        counts = rows.mapInPandas(expected, "unit string, n double").groupBy("unit").agg(F.sum("n").alias("n")).collect()
        # rounded, so that the order of additions doesn't show
        found = {r["unit"]: round(r["n"], 9) for r in sorted(counts, key=lambda r: r["unit"])}
        total = sum(found.values())
        share = {u: n / total for u, n in found.items() if n > 0} if total else {}

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [best_units(w, list(p), share) for w, p in zip(batch["word"], batch["phonemes"])]
            ends = [pair for f in found if f for pair in zip([START, *f], [*f, END])]
            yield pd.DataFrame(ends, columns=["before", "unit"], dtype=object)

    pairs = rows.mapInPandas(aligned, "before string, unit string").groupBy("before", "unit").count().collect()
    units = defaultdict(int)
    for r in pairs:
        if r["unit"] != END:
            units[r["unit"]] += r["count"]
    return Spelling(dict(units), {(r["before"], r["unit"]): r["count"] for r in pairs})


def guessed(words: DataFrame, model: Spelling, word: str = "word", out: str = "phonemes") -> DataFrame:
    """(word, phonemes) of the distinct words of a column, in lower case; null is left out."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [model.phonemes(w) for w in batch["word"]]})

    distinct = words.select(F.lower(word).alias("word")).where("word IS NOT NULL").distinct()
    return distinct.mapInPandas(each, f"word string, {out} array<string>")


def with_all_phonemes(df: DataFrame, word: str, lexicon: DataFrame, model: Spelling, out: str = "phonemes") -> DataFrame:
    """``df`` with the phonemes of a word: those listed, else those that the model
    gives. Only distinct words that aren't listed are decoded."""
    known = lexicon.select(F.lower("word").alias("word"))
    unlisted = df.select(F.lower(word).alias("word")).distinct().join(known, "word", "left_anti")
    listed = lexicon.select(F.lower("word").alias("word"), "phonemes")
    return with_phonemes(df, word, listed.unionByName(guessed(unlisted, model)), out)
