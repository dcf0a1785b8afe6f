"""Tables that change by key, and results that follow a stream."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lorikeet.operators import performance as P
from lorikeet.operators import recommend as R
from lorikeet.operators import scoring as C
from lorikeet.operators import sessions as S
from lorikeet.plans.catalog import CATALOG
from lorikeet.sources import keyed, tables
from lorikeet.sources.domain import Domain
from lorikeet.sources.keyed import DEAL, ConflictError, KeyedTable
from lorikeet.streaming import maintained as K

SCHEMA = "id long, kind string, value double"


def files(path):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id", "kind"], 16)
    assert table.read().count() == 0
    old = spark.createDataFrame([(i, "a" if i % 2 else None, float(i)) for i in range(400)] + [(None, None, 1.0)], SCHEMA)
    assert table.upsert(old) == 1 and rows(table.read()) == rows(old)
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(3, "a", 30.0), (3, "a", 29.0), (1000, "z", 1.0), (None, None, 2.0)], SCHEMA)
    assert table.upsert(new) == 2
    one = spark.createDataFrame([(3, "a", 30.0), (1000, "z", 1.0), (None, None, 2.0)], SCHEMA)
    assert rows(table.read()) == rows(tables.upserted(old, one, ["id", "kind"]))
    after = files(tmp_path / "t")
    assert {f: h for f, h in after.items() if f in before} == before
    named = {f for f in table.manifest()["folders"].values()}
    untouched = [f for f in before if any(f"/data/{n}/" in f for n in named)]
    assert len(untouched) >= 13 and len(after) - len(before) <= 3
    table.vacuum()
    assert set(untouched) <= set(files(tmp_path / "t")) and len(files(tmp_path / "t")) == len(named)
    assert rows(table.read()) == rows(tables.upserted(old, one, ["id", "kind"]))


def test_replace_and_delete(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8)
    old = spark.createDataFrame([(i % 50, "x", float(i)) for i in range(200)] + [(None, "n", 0.0)], SCHEMA)
    table.replace(old)
    assert rows(table.read()) == rows(old)
    new = spark.createDataFrame([(7, "new", 1.0), (7, "new", 2.0), (99, "new", 3.0), (None, "other", 4.0)], SCHEMA)
    table.replace(new)
    want = rows(old.where("id <> 7").unionByName(new))
    assert rows(table.read()) == want
    table.delete(spark.createDataFrame([(7,), (8,), (None,), (12345,)], "id long"))
    assert rows(table.read()) == [r for r in want if r[0] not in (7, 8, None)]
    table.delete(spark.createDataFrame([(i,) for i in range(100)], "id long"))
    assert table.read().count() == 0 and table.manifest()["folders"] == {}


def test_a_lost_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    old = spark.createDataFrame([(i, "x", float(i)) for i in range(40)], SCHEMA)
    table.upsert(old, batch=0)
    new = spark.createDataFrame([(1, "y", -1.0)], SCHEMA)

    def lost(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(new, batch=1)
    assert rows(KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"]).read()) == rows(old)
    fails = new.withColumn("value", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        table.change(fails, lambda a, b: a.unionByName(b), batch=1)
    assert rows(table.read()) == rows(old)
    assert table.upsert(new, batch=1) == 2 and table.upsert(new, batch=1) is None and table.upsert(old, batch=0) is None
    assert table.read().where("id = 1").first()["value"] == -1.0
    n = len(files(tmp_path / "t"))
    table.vacuum()
    assert len(files(tmp_path / "t")) == 4 < n


def test_two_changes_of_one_version_exclude_each_other(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    new = spark.createDataFrame([(1, "x", 1.0)], SCHEMA)

    def meanwhile(old, changes):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4).upsert(spark.createDataFrame([(2, "y", 2.0)], SCHEMA))
        return old.unionByName(changes)

    with pytest.raises(ConflictError):
        table.change(new, meanwhile)
    assert rows(table.read()) == [(2, "y", 2.0)]
    with pytest.raises(ValueError, match="buckets"):
        table.change(new, lambda old, c: spark.createDataFrame([(i, "x", 1.0) for i in range(50)], SCHEMA))


def split(df, n, seed):
    """The rows in ``n`` parts at random."""
    part = F.floor(F.rand(seed) * n)
    parted = df.withColumn("__part", part).cache()
    return [parted.where(F.col("__part") == i).drop("__part") for i in range(n)]


@pytest.fixture(scope="module")
def domain(spark, sf_dir):
    return Domain(spark, sf_dir)


def test_rollup_of_any_split(spark, domain, tmp_path):
    answers = domain.answers.select("session_id", "response_type", "is_correct").cache()
    want = P.performance_rollup(answers, domain.therapy_sessions)
    rollup = K.Rollup(spark, str(tmp_path / "r"), 4)
    for k, part in enumerate(split(answers, 4, 1)):
        rollup.add(part, domain.therapy_sessions, k)
        assert rollup.add(part, domain.therapy_sessions, k) is None
        rollup.add(part, domain.therapy_sessions, 0)
    got = rollup.read()
    assert rows(got.select(*want.columns)) == rows(want)
    vectors = [P.skill_vector(domain.children, x.cache()) for x in (got, want)]
    near = lambda df: [tuple(round(v, 9) for v in r) for r in rows(df)]
    assert near(vectors[0]) == near(vectors[1])


def test_adaptations_follow_late_answers(spark, domain, tmp_path):
    said = domain.session_activities.join(domain.utterances.select("item_id", F.col("actual").alias("response_text")), "item_id", "left")
    said = said.select("session_id", "activity_id", "item_id", "is_correct", "response_type", "response_text", "created_at").where("session_id % 7 = 0").cache()
    source = tmp_path / "in"
    for k, part in enumerate(split(said, 3, 2)):
        again = part.unionByName(said.where("activity_id % 11 = 0"))  # some come with every batch
        again.coalesce(1).write.parquet(str(source / f"part={k}"))
    live = K.Adaptations(spark, str(tmp_path / "a"), 4)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    q = K.follow(stream, live.add, live.table, str(tmp_path / "c"), availableNow=True)
    assert q.awaitTermination(300)
    assert live.table.manifest()["last_batch"] == 2
    want = R.adaptation(said, domain.activity_items)
    assert rows(live.read(domain.activity_items)) == rows(want) and want.count() > 20
    rates = S.recent_rate(live.table.read())
    assert rows(rates) == rows(S.recent_rate(said))


def test_attempt_numbers_of_shuffled_repeated_attempts(spark, domain, tmp_path):
    rng, made = random.Random(4), []
    items = [r[0] for r in domain.activity_items.select("item_id").orderBy("item_id").limit(6).collect()]
    for i in range(120):
        made.append((i, rng.randrange(5), rng.choice(items), rng.choice(["large red ring", "rod", ""]), f"2024-01-01 00:00:{rng.randrange(60):02d}"))
    attempts = spark.createDataFrame(made, "attempt_id long, session_id long, item_id long, transcript string, ts string")
    attempts = attempts.withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    kept = K.Attempts(spark, str(tmp_path / "a"), 4)
    for k, part in enumerate(split(attempts, 3, 5)):
        kept.add(part.unionByName(attempts.where("attempt_id % 9 = 0")), k)
        kept.add(part, k + 10 if k == 2 else k)
    want = C.attempt_rows(attempts, domain.activity_items)
    assert rows(kept.read(domain.activity_items)) == rows(want)
    assert want.agg(F.max("attempt_number")).first()[0] > 3


def test_a_batch_of_adaptations_is_shuffled_once(spark, sf_dir, monkeypatch):
    """Answers are made before the batches, and old and new rows meet in one shuffle."""
    plans, change = [], KeyedTable.change
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(table, changes, merge, batch=None, **how):
        plans.append((plan(changes), plan(merge(table.read(), changes))))
        return change(table, changes, merge, batch, **how)

    monkeypatch.setattr(KeyedTable, "change", watched)
    got = CATALOG["maintained_adaptations"](Domain(spark, sf_dir))
    assert len(plans) == 3
    for changes, merged in plans:
        assert "Window" not in changes and "Join" not in changes and merged.count("Exchange") == 1
    assert rows(got) == rows(CATALOG["adaptations"](Domain(spark, sf_dir)))


def test_dealt_rows_are_written_where_they_were_merged(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id long, x string, v double", ["id"], 3)
    one = lambda old, new: table.dealt(old.unionByName(new)).groupBy(*DEAL, "id").agg(F.max("x").alias("x"), F.sum("v").alias("v"))
    facts = [(i % 40 if i % 7 else None, "xy"[i % 2], float(i)) for i in range(200)]
    for k in range(2):
        table.change(spark.createDataFrame(facts[k::2], "id long, x string, v double"), one, k, dealt=True)
    want = {i: (max(x for j, x, _ in facts if j == i), sum(v for j, _, v in facts if j == i)) for i, _, _ in facts}
    assert {r["id"]: (r["x"], r["v"]) for r in table.read().collect()} == want
