"""Homomorphic multiset fingerprints, with DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph hashes to a
wide vector and the fingerprint is their sum, component by component, modulo
powers of two: it doesn't depend on the order of paragraphs, and a paragraph is
inserted or deleted by adding or subtracting its vector.

The vector has two parts. Four components of 60 bits are slices of the SHA-256 of
the paragraph; they decide equality. 64 components of 31 bits count, for each bit
of the hash of every pair of neighbouring words in it (the line ends count as
words), how often the bit is set. The difference of two such counts estimates the
size of the difference of the two multisets of word pairs, hence the likeness.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.llm.common import written

#: Components that decide equality, hexadecimal digits of one, and its mask.
WIDE, DIGITS = 4, 15
WIDE_MASK = (1 << 4 * DIGITS) - 1
#: 32 integers hold 64 counters in lanes of 32 bits, of which 31 count: no text has as many word pairs.
PACKED, LANE_MASK = 32, 0x7FFFFFFF7FFFFFFF
#: Hashes that lanes of 8 bits can count (the last has the sign), the ones of those lanes, and the first byte of each half.
CHUNK, BYTE_ONES, BYTE_PAIR = 127, 0x0101010101010101, 0x000000FF000000FF
#: Length of a fingerprint: wide components, packed counters, number of pairs.
LENGTH = WIDE + PACKED + 1
#: Documents in a range of the order that one task treats together.
RANGE_ROWS = 20_000
#: Bounds of ranges, at most, that the driver looks up; between them ranges are cut evenly.
MOST_BOUNDS = 1000


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _wide(text: Column | str) -> Column:
    """array<bigint>: the sums of the slices of the paragraphs' SHA-256."""
    digests = F.transform(F.split(_text(text), "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))
    part = lambda i: lambda h: F.conv(F.substring(h, DIGITS * i + 1, DIGITS), 16, 10).cast("long")
    return _let(digests, lambda hs: F.array(*[_sum(F.transform(hs, part(i)), WIDE_MASK) for i in range(WIDE)]))


def _pairs(text: Column | str) -> Column:
    """array<bigint>: the hash of every pair of neighbouring words, line ends among them; never empty."""
    t = _text(text)
    spaced = F.split(F.concat(F.lit("\n "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " ", -1)
    return F.zip_with(
        F.slice(spaced, 1, F.size(spaced) - 1), F.slice(spaced, 2, F.size(spaced) - 1), lambda a, b: F.xxhash64(a, b)
    )


def _counts(pairs: Column) -> Column:
    """array<bigint> of PACKED: how often each bit of the hashes is set, two bits to
    an integer. Up to 127 hashes are summed in lanes of 8 bits first, so that eight
    sums count all bits; their totals are then widened."""
    starts = F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK))
    chunks = F.transform(starts, lambda at: F.slice(pairs, at, F.lit(CHUNK)))
    add = lambda k: lambda t, x: t + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(BYTE_ONES))
    small = F.transform(chunks, lambda c: F.array(*[F.aggregate(c, F.lit(0).cast("long"), add(k)) for k in range(8)]))

    def total(m: int) -> Callable[[Column], Column]:
        part = lambda x: F.shiftrightunsigned(F.element_at(x, m % 8 + 1), m - m % 8).bitwiseAND(F.lit(BYTE_PAIR))
        return lambda sums: F.aggregate(sums, F.lit(0).cast("long"), lambda t, x: (t + part(x)).bitwiseAND(F.lit(LANE_MASK)))

    return _let(small, lambda sums: F.array(*[total(m)(sums) for m in range(PACKED)]))


def fingerprint(text: Column | str) -> Column:
    """array<bigint> of LENGTH for a text (null: empty)."""
    counts = _let(_pairs(text), lambda x: F.concat(_counts(x), F.array(F.size(x).cast("long"))))
    return F.concat(_wide(text), counts)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(mask)))


def _lanes(fp: Column) -> Column:
    """The 64 signed sums, one for each bit: times set less times not set, modulo 2^32."""
    low = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF))
    packed = F.slice(fp, WIDE + 1, PACKED)
    counts = F.concat(F.transform(packed, low), F.transform(packed, lambda x: low(F.shiftrightunsigned(x, 32))))
    return F.transform(counts, lambda c: _centred(c * 2 - F.element_at(fp, LENGTH)))


def _centred(x: Column) -> Column:
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: 1 if equal, else one less the estimated share
    of word pairs, by squared multiplicity, in which the documents differ."""
    share = _let(
        F.struct(_lanes(a).alias("x"), _lanes(b).alias("y")),
        lambda v: F.lit(1.0)
        - _squares(F.zip_with(v["x"], v["y"], lambda x, y: _centred(x - y)))
        / F.nullif(_squares(v["x"]) + _squares(v["y"]), F.lit(0.0)),
    )
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets of paragraphs (sign 1), or of
    ``a`` without the paragraphs of ``b`` (sign -1)."""
    ones = F.lit(sign)

    def lanes(x: Column, y: Column) -> Column:
        lane = lambda v, i: F.shiftrightunsigned(v, 32 * i).bitwiseAND(F.lit(0x7FFFFFFF))
        low, high = (F.pmod(lane(x, i) + ones * lane(y, i), F.lit(1 << 31)) for i in range(2))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.concat(
        F.zip_with(F.slice(a, 1, WIDE), F.slice(b, 1, WIDE), lambda x, y: (x + ones * y).bitwiseAND(F.lit(WIDE_MASK))),
        F.zip_with(F.slice(a, WIDE + 1, PACKED), F.slice(b, WIDE + 1, PACKED), lanes),
        F.array(F.element_at(a, LENGTH) + ones * F.element_at(b, LENGTH)),
    )


def as_string(fp: Column) -> Column:
    """Hexadecimal, 16 digits for each component."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _bucket(col: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``col``, by halves."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    fits = lambda at: (at <= len(bounds)) & (F.element_at(held, F.least(at, F.lit(len(bounds)))) <= col)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def _cuts(docs: DataFrame, n: int) -> list[int]:
    """About the n-quantiles of doc_id in rising order, exact integers; one that
    holds several quantiles stands there several times.

    Quantiles are taken of the upper 32 bits, which are exact as doubles, and of
    the lower 32 bits among rows whose upper ones hold several quantiles.
    """
    high, low = F.shiftright("doc_id", 32).alias("high"), F.col("doc_id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")
    halves = docs.where("doc_id IS NOT NULL").select(high, low)
    at = [i / n for i in range(n + 1)]
    times = Counter(map(int, halves.approxQuantile("high", at, 0.25 / n)))
    several = [h for h, k in times.items() if k > 1]
    lows = {}
    if several:  # fewer than n rows of n + 1 numbers
        inside = halves.where(F.col("high").isin(several)).groupBy("high").agg(F.percentile_approx("low", at, 4 * n))
        lows = {r[0]: r[1] for r in inside.collect()}
    return [
        (h << 32) + (int(lows[h][j * n // (k - 1)]) if k > 1 else 0) for h, k in sorted(times.items()) for j in range(k)
    ]


def _ranged(docs: DataFrame, range_rows: int) -> DataFrame:
    """``docs`` (doc_id, text) with __range, which rises along the order (falling
    doc_id, null last; of one doc_id by a hash of the text), and __h, that hash.

    There is a range for each ``range_rows`` rows, and two for each shuffle
    partition at least. Quantiles of doc_id bound them, of which the driver sees
    MOST_BOUNDS at most; between two of those, ranges are cut evenly. A doc_id
    with so many rows that two quantiles fall on it is spread over ranges by the
    hash, and so are the rows without one.
    """
    at_least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(at_least, -(-docs.count() // range_rows))
    tops = min(n, MOST_BOUNDS)
    cuts = _cuts(docs, tops) or [0, 0]
    bounds = sorted(set(cuts[1:-1]))
    crowded = sorted({b for a, b in zip(cuts, cuts[1:]) if a == b})
    even = -(-n // tops)
    x = F.col("doc_id")
    low, high = [cuts[0], *bounds], [*bounds, cuts[-1]]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("__top") + 1)
    share = _apart(x, of(low)) / F.nullif(_apart(of(high), of(low)), F.lit(0.0)) if even > 1 else F.lit(0.0)
    sub = F.greatest(F.lit(0), F.least(F.lit(even - 1), F.floor(F.coalesce(share, F.lit(0.0)) * even)))
    piece = F.shiftrightunsigned(F.col("__h") * n, 31)
    place = F.when(x.isin(crowded), even + piece).otherwise(even - 1 - sub) if crowded else even - 1 - sub
    rows = docs.withColumn("__h", F.shiftrightunsigned(F.xxhash64("text"), 33)).withColumn("__top", _bucket(x, bounds))
    at = F.when(x.isNull(), even + n + piece).otherwise(place - F.col("__top") * (even + n))
    return rows.withColumn("__range", at.cast("long")).drop("__top")


def _apart(x: Column, y: Column) -> Column:
    """x - y as a double: exact where they are near, and never too large for an integer."""
    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftright(x, 32) - F.shiftright(y, 32)) * F.lit(2.0**32) + (low(x) - low(y))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with next_text, __range and __place, and a table
    (__range, __next) of the ranges and those that follow them.

    next_text is the text of the document that follows in descending doc_id; the
    first follows the last. Rows are ordered within ranges only; the last of a
    range takes the first of the next one from a table of a row a range, of which
    only the numbers pass one task.
    """
    rows = _ranged(docs, range_rows)
    first = F.max(F.struct("doc_id", (-F.col("__h")).alias("h"), "text"))["text"]
    heads = written(rows.groupBy("__range").agg(first.alias("__head")), "heads")
    along = Window.orderBy("__range")
    ranges = heads.select("__range", F.coalesce(F.lead("__range").over(along), F.min("__range").over(Window.partitionBy())).alias("__next"))
    ranges = written(ranges, "ranges")
    following = ranges.join(heads.select(F.col("__range").alias("__next"), "__head"), "__next").select("__range", "__head")
    order = Window.partitionBy("__range").orderBy(F.desc_nulls_last("doc_id"), "__h", F.desc("text"))
    found = rows.select("*", F.lead("text").over(order).alias("__lead"), F.row_number().over(order).alias("__place"))
    found = found.join(following, "__range")
    return found.select("__range", "__place", *docs.columns, F.coalesce("__lead", "__head").alias("next_text")), ranges


def op4_fingerprint(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by
    the head of the next document, and how like they are. Null texts are empty;
    null doc_ids come last in the order; rows that share a doc_id follow each
    other by a hash of their texts, and those equal in both are interchangeable.
    Other columns are ignored; an empty table gives an empty table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text("text").cast("string").alias("text"))
    rows, ranges = with_next(texts, range_rows)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)
    )
    rows = rows.select("__range", "__place", "doc_id", "n_chars", "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["__range", "__place", "doc_id", "n_chars", "edited_sha256"]
    prints = written(rows.select(*keys, fingerprint("text").alias("fp"), fingerprint("edited").alias("edited_fp")), "fingerprints")
    heads = prints.where("__place = 1").select(F.col("__range").alias("__next"), F.col("fp").alias("head_fp"))
    heads = ranges.join(heads, "__next").select("__range", "head_fp")
    order = Window.partitionBy("__range").orderBy("__place")
    found = prints.withColumn("next_fp", F.lead("fp").over(order)).join(heads, "__range")
    found = found.withColumn("next_fp", F.coalesce("next_fp", "head_fp"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
