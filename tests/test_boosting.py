"""Boosted trees against a single-machine version, and on children not seen."""

import bisect
import math
import random

import pytest

from lorikeet.operators import boosting, classifier

COLS = "child_id long, " + ", ".join(f"{f} double" for f in classifier.FEATURES) + ", recommended_category string"


def table(spark, n, seed, nulls=False):
    """Children whose class follows from three features, with some noise."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        x = [round(rng.random(), 3) for _ in classifier.FEATURES]
        name = "Food" if x[4] > 0.66 else "Toys" if x[0] > 0.5 else "Colors" if x[5] > 0.4 else "Animals"
        if nulls and rng.random() < 0.15:
            x[rng.randrange(6)] = rng.choice([None, float("nan")])
        rows.append((i, *x, rng.choice(["Food", "Toys"]) if rng.random() < 0.03 else name))
    return rows, spark.createDataFrame(rows, COLS).repartition(3)


def slow_fit(rows, cuts, classes, rounds, depth, n_bins, rate, penalty, least):
    """One list of rows, one tree after another, one split after another."""
    below = lambda v, c: 0 if v is None else len(c) if v != v else bisect.bisect_left(c, v)
    bins = [[below(v, c) for v, c in zip(r[1:-1], cuts)] for r in rows]
    labels = [classes.index(r[-1]) for r in rows]
    scores = [[0.0] * len(classes) for _ in rows]
    features, splits, leaves = [], [], []
    for _ in range(rounds):
        shares = []
        for s in scores:
            e = [math.exp(x - max(s)) for x in s]
            z = 0.0
            for x in e:
                z += x
            shares.append([x / z for x in e])
        for c in range(len(classes)):
            g = [round((p[c] - (y == c)) * (1 << 20)) for p, y in zip(shares, labels)]
            h = [max(round(p[c] * (1 - p[c]) * (1 << 20)), 1) for p in shares]
            feature, split, leaf = [0] * ((1 << depth) - 1), [n_bins] * ((1 << depth) - 1), [0.0] * (1 << depth)
            inside = {0: list(range(len(rows)))}
            for node in range((1 << depth) - 1):
                mine = inside.get(node, [])
                sums = lambda at: (sum(g[i] for i in at) / (1 << 20), sum(h[i] for i in at) / (1 << 20))  # noqa: E731, B023
                tg, th = sums(mine)
                best, at, values = 1e-9, (0, n_bins - 1), (tg, th)
                for f in range(6):
                    for b in range(n_bins - 1):
                        lg, lh = sums([i for i in mine if bins[i][f] <= b])
                        if lh < least or th - lh < least:
                            continue
                        gain = lg * lg / (lh + penalty) + (tg - lg) ** 2 / (th - lh + penalty) - tg * tg / (th + penalty)
                        if gain > best:
                            best, at, values = gain, (f, b), (lg, lh)
                feature[node], split[node] = at
                f, b = at
                inside[2 * node + 1] = [i for i in mine if bins[i][f] <= b]
                inside[2 * node + 2] = [i for i in mine if bins[i][f] > b]
                first = (1 << depth) - 1
                if 2 * node + 1 >= first:
                    lg, lh = values
                    leaf[2 * node + 1 - first] = -rate * lg / (lh + penalty)
                    leaf[2 * node + 2 - first] = -rate * (tg - lg) / (th - lh + penalty)
            for place in range(1 << depth):
                for i in inside[(1 << depth) - 1 + place]:
                    scores[i][c] += leaf[place]
            features += feature
            splits += split
            leaves += leaf
    return features, splits, leaves, [classes[max(range(len(classes)), key=lambda c: (s[c], -c))] for s in scores]


@pytest.mark.parametrize("nulls", [False, True])
def test_equals_a_single_machine(spark, nulls):
    rows, df = table(spark, 160, 3, nulls)
    set_up = {"rounds": 3, "depth": 2, "n_bins": 6, "rate": 0.5, "penalty": 1.0, "least": 1e-3}
    known = ["Aside"]  # a class that no row has
    model = classifier.boost(df, known=known, **set_up)
    assert model.classes == ("Animals", "Aside", "Colors", "Food", "Toys")
    features, splits, leaves, said = slow_fit(rows, model.cuts, model.classes, **set_up)
    assert list(model.feature) == features and list(model.split) == splits
    assert model.leaf == pytest.approx(leaves, abs=1e-12)
    got = {r[0]: r[1] for r in classifier.predict_boosted(df, model).collect()}
    assert [got[r[0]] for r in rows] == said


def test_as_good_as_the_forest_on_unseen_children(spark):
    """Three labels in a hundred are drawn at random: 0.985 is the most that can be expected."""
    rows, df = table(spark, 900, 5)
    known, unseen = df.where("child_id % 3 <> 0"), df.where("child_id % 3 = 0")
    want = {r[0]: r[-1] for r in rows if r[0] % 3 == 0}
    share = lambda got: sum(want[r[0]] == r[1] for r in got.collect()) / len(want)
    boosted, forest = (share(classifier.predict_boosted(unseen, classifier.boost(known))), share(classifier.predict(unseen, classifier.train(known))))
    print("held-out accuracy", boosted, forest)
    assert boosted >= forest - 0.01 and boosted > 0.95


def test_classes_grow_and_models_are_kept(spark, tmp_path):
    _, df = table(spark, 200, 7)
    first = classifier.boost(df.where("recommended_category IN ('Food', 'Toys')"), rounds=1, depth=1)
    assert first.classes == ("Food", "Toys")
    model = classifier.boost(df.where("recommended_category <> 'Toys'"), known=first.classes, rounds=4)
    assert model.classes == ("Animals", "Colors", "Food", "Toys")
    path = str(tmp_path / "model")
    boosting.save(spark, model, path)
    assert boosting.load(spark, path) == model
    got = classifier.predict_or_rule(df, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, classifier.predict_boosted(df, model).collect()))
    assert "Toys" not in {r[1] for r in got.collect()}


def test_rules_alone_when_the_model_fails(spark, tmp_path):
    _, df = table(spark, 30, 8)
    rule = sorted(map(tuple, classifier.predict(df, None).collect()))
    with pytest.warns(UserWarning, match="using the rule"):
        assert sorted(map(tuple, classifier.predict_or_rule(df, str(tmp_path / "none")).collect())) == rule
    spark.createDataFrame([("not a model",)], "value string").write.text(str(tmp_path / "broken"))
    with pytest.warns(UserWarning, match="using the rule"):
        assert sorted(map(tuple, classifier.predict_or_rule(df, str(tmp_path / "broken")).collect())) == rule
    boosting.save(spark, classifier.boost(df, rounds=1), str(tmp_path / "fine"))
    with pytest.warns(UserWarning, match="missing"):
        assert sorted(map(tuple, classifier.predict_or_rule(df.drop("time_spent"), str(tmp_path / "fine")).collect())) == rule


def test_no_labels(spark):
    _, df = table(spark, 5, 9)
    with pytest.raises(ValueError, match="no labels"):
        classifier.boost(df.limit(0))


def test_scoring_reads_bins_once(spark):
    """Scoring with many trees is a pass over batches; its plan doesn't grow with the trees."""
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 2.0)], "child_id long, x double")
    model = boosting.Boosted(("a", "b"), ("x",), ((1.0,),), 1, (0, 0) * 300, (0, 0) * 300, (0.0, 1.0, 1.0, 0.0) * 300)
    got = boosting.predicted(rows, model, "child_id", "c")
    assert dict(got.collect()) == {1: "b", 2: "b", 3: "a", 4: "a"}
    assert len(got._jdf.queryExecution().executedPlan().toString()) < 2_000
