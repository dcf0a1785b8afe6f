"""Letter-to-phoneme models: alignment, decoding by brute force, held-out words."""

import itertools
import math
import random

import pytest

from lorikeet.functions import spelling as S

ONSETS = {"sh": ["SH"], "th": ["TH"], "ch": ["CH"], "b": ["B"], "d": ["D"], "f": ["F"], "g": ["G"], "l": ["L"], "m": ["M"], "r": ["R"], "t": ["T"]}
VOWELS = {"ee": ["IY"], "oa": ["OW"], "a": ["AE"], "e": ["EH"], "i": ["IH"], "o": ["AA"], "u": ["AH"]}
CODAS = {"ck": ["K"], "ng": ["NG"], "x": ["K", "S"], "n": ["N"], "p": ["P"], "s": ["S"], "": []}
HARD = {"c": lambda v: ["S"] if v[0] in "ei" else ["K"]}


def made_words(n, seed):
    """Words of one or two syllables; c is soft before e and i."""
    rng, found = random.Random(seed), {}
    while len(found) < n:
        word, phones = "", []
        for _ in range(rng.choice([1, 2])):
            vowel, coda = rng.choice(list(VOWELS)), rng.choice(list(CODAS))
            onset = rng.choice([*ONSETS, "c"])
            word += onset + vowel + coda
            phones += (HARD[onset](vowel) if onset in HARD else ONSETS[onset]) + VOWELS[vowel] + CODAS[coda]
        found[word] = phones
    return list(found.items())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.createDataFrame(made_words(600, 1), "word string, phonemes array<string>").repartition(3))


def test_expected_units_are_those_of_all_alignments():
    word, phones = "xeet", ["K", "S", "IY", "T"]
    share = {u: 0.1 + (len(u) * 7 % 5) / 10 for _, _, u in S._edges(word, phones)}

    def paths(i, j):
        if (i, j) == (len(word), len(phones)):
            yield []
        for a, b in S.SHAPES:
            if i + a <= len(word) and j + b <= len(phones):
                unit = S._unit(word[i : i + a], phones[j : j + b])
                yield from ([unit, *rest] for rest in paths(i + a, j + b))

    every = list(paths(0, 0))
    weights = [math.prod(share[u] for u in p) for p in every]
    want = {}
    for p, w in zip(every, weights):
        for u in p:
            want[u] = want.get(u, 0) + w / sum(weights)
    assert S.expected_units(word, phones, share) == pytest.approx(want)
    best = every[max(range(len(every)), key=lambda i: weights[i])]
    assert math.prod(share[u] for u in S.best_units(word, phones, share)) == pytest.approx(math.prod(share[u] for u in best))
    assert S.expected_units("a", ["A", "B", "C"], None) == {} and S.best_units("a", ["A", "B", "C"], share) == []


def test_units_are_found(model):
    for unit in ("sh:SH", "ee:IY", "x:K S", "ck:K", "ng:NG", "c:S", "c:K", "b:B"):
        assert model.units.get(unit, 0) > 0, unit


def slow_phonemes(model, word):
    """Over all sequences of units."""
    def paths(at):
        if at == len(word):
            yield []
            return
        for u in model.options(word, at):
            yield from ([u, *rest] for rest in paths(at + len(u.rpartition(":")[0])))

    score = lambda p: sum(itertools.starmap(model.log_share, zip([S.START, *p], [*p, S.END])))
    return max(score(p) for p in paths(0)), score, paths


@pytest.mark.parametrize("word", ["ceb", "shox", "xee", "q", "bq", "ng", "a:b", ":", "é", "tck"])
def test_decoding_equals_brute_force(model, word):
    best, score, paths = slow_phonemes(model, word)
    got = model.phonemes(word)
    said = {tuple(x for u in p for x in u.rpartition(":")[2].split()) for p in paths(0) if score(p) >= best - 1e-9}
    assert tuple(got) in said
    assert model.phonemes("") == []


def test_shares_of_what_follows_sum_to_one(model):
    for before in ("c:K", S.START, "ee:IY"):
        assert sum(math.exp(model.log_share(before, u)) for u in [*model.units, S.END]) == pytest.approx(1, abs=1e-6)


def test_unseen_words(spark, model):
    known = {w for w, _ in made_words(600, 1)}
    unseen = [(w, p) for w, p in made_words(500, 2) if w not in known]
    assert len(unseen) > 150
    rows = spark.createDataFrame(unseen + unseen[:5] + [("b" + "ee" * 500, []), (None, None)], "word string, phonemes array<string>")
    got = {r["word"]: r["said"] for r in S.guessed(rows, model, out="said").collect()}
    assert None not in got and len(got["b" + "ee" * 500]) >= 500
    wrong = sum(distance(got[w], p) for w, p in unseen)
    total = sum(len(p) for _, p in unseen)
    exact = sum(got[w] == p for w, p in unseen) / len(unseen)
    print("phonemes wrong", wrong / total, "words right", exact)
    assert wrong / total < 0.05 and exact > 0.85


def test_listed_words_keep_their_phonemes(spark, model):
    lexicon = spark.createDataFrame([("Bee", ["X", "Y"]), ("bee", ["X", "Z"])], "word string, phonemes array<string>")
    rows = spark.createDataFrame([(1, "BEE"), (2, "shee"), (3, None), (4, "shee"), (5, "")], "id long, word string")
    got = {r["id"]: r["phonemes"] for r in S.with_all_phonemes(rows, "word", lexicon, model).collect()}
    assert got == {1: ["X", "Y"], 2: ["SH", "IY"], 3: None, 4: ["SH", "IY"], 5: []}


def test_odd_lexicons(spark):
    schema = "word string, phonemes array<string>"
    empty = S.fit(spark.createDataFrame([], schema), rounds=2)
    assert empty.units == {} and empty.phonemes("abc") == []
    odd = S.fit(spark.createDataFrame([(None, ["A"]), ("a", None), ("", ["A"]), ("a", []), ("b", ["B", "C", "D"]), ("ab", ["AE", "B"])], schema))
    assert odd.phonemes("ab") == ["AE", "B"]
