"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source, documents are range
sorted by key, a distributed prefix sum of their sizes runs along that order,
and the mix is cut at the source's exact budget; a budget above the source's
size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.llm.common import WORD, null_key, sum_before, written, written_alone

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (5, 2, 1)
#: Epochs of a source at most.
MAX_EPOCHS = 3


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size), a row a source.

    Shares of the sum of all sizes follow the weights; a target stops at
    ``max_epochs`` times its source's size and the excess is shared again by
    weight until none is above. That ends at min(cap, level * weight) with one
    level for all: along cap / weight, the first source whose cap lies above the
    level reached so far has the final one. The sources are one small table.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    along = Window.orderBy("ratio", "place")
    listed = totals.withColumn("place", F.row_number().over(named)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("double")
    )
    capped = listed.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn(
        "ratio", F.col("cap") / F.col("weight")
    )
    levels = capped.withColumn(
        "level",
        (
            F.sum("source_size").over(Window.partitionBy()).cast("double")
            - F.coalesce(F.sum("cap").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        / F.sum("weight").over(along.rowsBetween(0, Window.unboundedFollowing)),
    ).withColumn("full", F.col("ratio") <= F.col("level"))
    first = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    return levels.select(
        "skey", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(first * F.col("weight")).alias("target")
    )


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text").cast("string")))


def _placed(docs: DataFrame, weights: Sequence[float], max_epochs: int, seed: int) -> DataFrame:
    """(doc_id, skey, key, size, before, source_size, target, epochs, rest) for every
    row of ``docs``. Texts are read once, for their keys and sizes; what follows
    works on those. ``before`` is the prefix sum of sizes along the keys, ``epochs``
    whole takings of every row, ``rest`` the words that the partial epoch takes."""
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), null_key("source").alias("skey"), _key(seed).alias("key"),
        n_words("text").alias("size"),
    )
    rows = written(rows, "mix-sizes").withColumn("slice", F.substring("key", 1, 3))
    totals = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    budget = targets(totals, weights, max_epochs).withColumn(
        "budget", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs)
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    budget = budget.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    placed = sum_before(rows.drop("source"), ["skey"], "slice", ["key", "size"], "size", "before")
    # a row a source, written so that its size is known when the join with it is planned
    return placed.join(written(budget.drop("budget"), "mix-targets"), "skey").drop("slice")


def _taken(size: Column, before: Column) -> Column:
    part = F.least(size, F.greatest(F.lit(0).cast("long"), F.col("rest") - before))
    return F.col("epochs") * size + part


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id,
    text, source, ...): taken is the words that the mix takes of the row.

    The key is the MD5 of seed, doc_id and text, so reruns agree and only rows
    equal in both can tie; those are interchangeable. taken counts whole epochs
    plus, up to the cut, the partial one; the document at the cut gives its first
    words only, so each source gives its target rounded to a word. Null texts have
    size 0 and are never taken; null sources are one source, listed last; null
    and repeated doc_ids are rows like any other. Other columns are ignored. No
    rows: no rows.
    """
    placed = _placed(docs, weights, max_epochs, seed)
    taken = _taken(F.col("size"), F.col("before")).cast("long").alias("taken")
    return placed.select("doc_id", "size", "source_size", "target", taken)


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0
) -> DataFrame:
    """The mix itself, with the columns of ``docs`` as they are, whatever their
    names: a row for each whole taking of a document, and one with its first words
    where the cut goes through it (single spaces between words, n_chars to match
    if there is such a column). Nulls and ties as in ``mix``.

    Along the keys of a source, what lies below its cut is taken once more than
    what lies above. So a row's key and a table of a row a source decide, no text
    is shuffled, and only where several rows share the key at a cut are those
    numbered first.
    """
    placed = written_alone(docs.sparkSession, "mix-placed", lambda: _placed(docs, weights, max_epochs, seed))
    edge = F.when((F.col("before") < F.col("rest")) & (F.col("size") > 0), F.struct("key", (-F.col("before")).alias("less")))
    cuts = placed.groupBy("skey").agg(F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.max(edge).alias("cut"))
    cuts = written(cuts.select("skey", "epochs", "rest", F.col("cut.key").alias("cut"), (-F.col("cut.less")).alias("before")), "mix-cuts")
    at_cut = placed.select("skey", "key").join(cuts.select("skey", F.col("cut").alias("key")), ["skey", "key"])
    tied = at_cut.groupBy("skey").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0

    named = {c: f"__mix_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.withColumn("__mix_skey", null_key("source")).withColumn("__mix_key", _key(seed)).withColumn("__mix_size", n_words("text"))
    keyed = keyed.select(*[F.col(c).alias(n) for c, n in named.items()], "__mix_skey", "__mix_key", "__mix_size")
    joined = keyed.join(cuts, F.col("__mix_skey") == F.col("skey"))
    key, size = F.col("__mix_key"), F.col("__mix_size")
    # of a row below the cut all is taken, as if nothing came before it, and above it nothing
    before = F.when(key < F.col("cut"), F.lit(0).cast("long")).when(key == F.col("cut"), F.col("before")).otherwise(F.col("rest"))
    whole = F.when(key < F.col("cut"), size).otherwise(F.lit(0).cast("long"))
    taken = F.when(key == F.col("cut"), _taken(size, before)).otherwise(F.col("epochs") * size + F.coalesce(whole, F.lit(0)))
    columns = [*named.values(), "__mix_size", "__mix_taken"]
    if not tied:
        rows = joined.withColumn("__mix_taken", taken).select(*columns)
    else:
        same = F.coalesce(key == F.col("cut"), F.lit(False))
        some = written(joined.where(same).withColumn("__mix_id", F.monotonically_increasing_id()), "mix-tied")
        some = some.withColumn("__mix_slice", F.expr("pmod(xxhash64(__mix_id), 256)"))
        some = sum_before(some, ["__mix_skey"], "__mix_slice", ["__mix_id"], "__mix_size", "__mix_before")
        some = some.withColumn("__mix_taken", _taken(size, F.col("before") + F.col("__mix_before"))).select(*columns)
        rows = joined.where(~same).withColumn("__mix_taken", taken).select(*columns).unionByName(some)

    rows = rows.where("__mix_taken > 0").withColumn("__mix_whole", F.expr("cast(__mix_taken div __mix_size as int)"))
    rows = rows.withColumn("__mix_rest", F.expr("cast(__mix_taken % __mix_size as int)"))
    rows = rows.select("*", F.explode(F.expr("sequence(1, __mix_whole + if(__mix_rest > 0, 1, 0))")).alias("__mix_copy"))
    at, cut = F.col(named["text"]), F.col("__mix_copy") > F.col("__mix_whole")
    words = F.filter(F.split(at, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.greatest("__mix_rest", F.lit(1))), " ")).otherwise(at)
    out = {c: text if c == "text" else F.col(n) for c, n in named.items()}
    if "n_chars" in named:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(cut, F.char_length(text).cast(kind)).otherwise(F.col(named["n_chars"]))
    return rows.select(*[x.alias(c) for c, x in out.items()])


def op2_mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents: see ``mix`` for
    nulls, empty texts, ties and repeated rows."""
    return mix(docs)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(chr(31), '0', CAST(doc_id AS VARCHAR), text)) AS k
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), l AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t
), c AS (
  SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         CAST(source_size * 3 AS DOUBLE) AS cap FROM l
), r AS (
  SELECT *, cap / weight AS ratio FROM c
), v AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), f AS (
  SELECT level FROM v WHERE ratio > level ORDER BY ratio, place LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE (SELECT level FROM f) * weight END AS target FROM v
), b AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size * 3) AS budget FROM g
), o AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM o
"""
