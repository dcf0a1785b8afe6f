"""Fill-in-middle: texts cut at unit bounds, with their middle moved to the end.

An Arrow-batched pandas UDF finds the end of every unit with ``finditer`` and
keeps only these offsets, in a compact array; two lookups in it give the cuts.
Where to cut, and whether and how a text is rearranged, comes from a digest of
the document's id, so reruns and lost executors give the same output.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the white space before it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Strings before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many are rearranged, and of a hundred of these, how many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
FILLED = "n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as an empty string."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i : i + 4], "big") for i in range(0, 16, 4)]


def unit_ends(text: str, unit) -> array:
    """0 and the end of every unit, in code points; 4 bytes each."""
    ends = array("I", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def _marks(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that a text free of them can't form with what is put around it."""
    distinct = len(set(sentinels)) == 3 and all(sentinels)
    if not distinct or any(s[0] in t[1:] or (s != t and s in t) for s in sentinels for t in sentinels):
        raise ValueError("sentinels must be distinct, not empty, and no sentinel may begin inside another")
    return sentinels


def rearranged(text: str, doc_id: int | None, unit, seed: int, rate: int, suffix_first: int, marks) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h = _draws(doc_id, seed)
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[first], ends[last]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str, form: str, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    p, s, m = sentinels
    lead, second = (s, p) if form == "spm" else (p, s)
    one, _, rest = output.removeprefix(lead).partition(second)
    two, _, middle = rest.partition(m)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    unit: str = UNIT,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of all ``docs``
    (doc_id, text, ...), a row for each.

    ``n`` counts units. Form ``plain`` leaves the text as it is: ``100 - rate`` in
    a hundred, empty texts, and those that hold a sentinel; their lengths are
    null. Null texts are empty; a null doc_id draws from an empty string; rows
    that share a doc_id draw alike; other columns are ignored; an empty table
    gives an empty table. A task holds an Arrow batch and the offsets of one text.
    """
    marks = _marks(tuple(sentinels))

    @F.pandas_udf(FILLED)
    def fill(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        units = regex.compile(unit)
        for ids, texts in batches:
            rows = [
                rearranged(text, None if d is None else int(d), units, seed, rate, suffix_first, marks)
                for d, text in zip(ids, texts)
            ]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # as text, since a long column with nulls would reach pandas as doubles
    return rows.select("doc_id", fill(F.col("doc_id").cast("string"), "text").alias("f")).select("doc_id", "f.*")


def _digests(output: pd.Series, form: pd.Series) -> pd.DataFrame:
    digest = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
    return pd.DataFrame({
        "output_sha256": [digest(o) for o in output],
        "restored_sha256": [digest(restored(o, f)) for o, f in zip(output, form)],
    })


def op13_infill(docs: DataFrame) -> DataFrame:
    """Digests of the rearranged texts of all documents, and of the texts rebuilt
    from output and form alone: see ``fill_in_middle`` for nulls, empty texts,
    repeated rows and empty tables."""
    digests = F.pandas_udf(_digests, "output_sha256 string, restored_sha256 string")
    found = fill_in_middle(docs).withColumn("d", digests("output", "form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.output_sha256", "d.restored_sha256")


OP13_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), d AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
