"""Uploads judged by their content (S-16).

A file's name says what it claims to be, its first bytes what it is, and a length
in its header whether all of it is there. Files over the limit are never read; of
the others only the head and the tail leave Spark's scan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 5 * 1024 * 1024
#: Bytes of the head and of the tail that are looked at; an Ogg page has 65,307 at most.
HEAD, TAIL = 4096, 65_536
#: Content types by the ending of a name.
TYPES = {
    "wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "audio/mp4", "ogg": "audio/ogg", "webm": "audio/webm",
    "flac": "audio/flac",
}


def _number(raw: bytes, at: int, size: int, order: str = "big") -> int | None:
    return int.from_bytes(raw[at : at + size], order) if at + size <= len(raw) else None


def _boxes_end(head: bytes) -> int | None:
    """Where the last box that begins in the head of an MP4 file ends; None where
    a box goes on to the end of the file or none is whole."""
    at, end = 0, None
    while (size := _number(head, at, 4)) is not None:
        if size == 1:
            size = _number(head, at + 8, 8)
        if size is None or size == 0:
            return None
        if size < 8:
            break
        at = end = at + size
    return end


def _vint(head: bytes, at: int) -> tuple[int | None, int]:
    """(value, bytes) of a Matroska length; None where it is unknown or cut off."""
    if at >= len(head) or not head[at]:
        return None, 1
    n = 9 - head[at].bit_length()
    raw = _number(head, at, n)
    value = None if raw is None else raw & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), n


def _segment_end(head: bytes) -> int | None:
    size, n = _vint(head, 4)
    at = 4 + n + (size or 0)
    if size is None or head[at : at + 4] != b"\x18\x53\x80\x67":
        return None
    size, n = _vint(head, at + 4)
    return None if size is None else at + 4 + n + size


def _ogg_is_whole(tail: bytes) -> bool:
    """Whether the last page of an Ogg file is there and marks the end of its stream."""
    at = tail.rfind(b"OggS")
    if at < 0 or len(tail) < at + 27 or not tail[at + 5] & 4:
        return False
    segments = tail[at + 27 : at + 27 + tail[at + 26]]
    return len(segments) == tail[at + 26] and at + 27 + len(segments) + sum(segments) <= len(tail)


def _mp3_end(head: bytes) -> int | None:
    """By the frame that counts the stream's bytes, where there is one."""
    start = 0
    if head[:3] == b"ID3" and len(head) >= 10:
        start = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(head[6:10]))
    marks = [p for p in (head.find(b"Xing", start), head.find(b"Info", start)) if p >= 0]
    if not marks:
        return None
    flags = _number(head, min(marks) + 4, 4)
    size = _number(head, min(marks) + 8 + (4 if flags and flags & 1 else 0), 4) if flags and flags & 2 else None
    return None if size is None else start + size


def contained(head: bytes, tail: bytes, length: int) -> tuple[str | None, bool]:
    """(content type, whether it is whole) by a file's first and last bytes; null
    where they are of no known container. Formats that state no length count as whole."""
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return TYPES["wav"], length >= 8 + int.from_bytes(head[4:8], "little")
    if head[4:8] == b"ftyp":
        return TYPES["m4a"], length >= (_boxes_end(head) or 0)
    if head[:4] == b"OggS":
        return TYPES["ogg"], _ogg_is_whole(tail)
    if head[:4] == b"\x1a\x45\xdf\xa3":
        return TYPES["webm"], length >= (_segment_end(head) or 0)
    if head[:4] == b"fLaC":
        first = _number(head, 5, 3)
        return TYPES["flac"], first is not None and length >= 8 + first
    if head[:3] == b"ID3" or (len(head) > 1 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] & 0x06):
        return TYPES["mp3"], length >= (_mp3_end(head) or 0)
    return None, True


def claimed_type(path: Column | str) -> Column:
    """The content type that the ending of a name claims, null if it is none of audio."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[ending]


def checked_audio(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, claimed, content_type, verdict) of the files below ``path``.

    verdict is ``too_large``, ``not_audio`` (by name or content), ``renamed`` (the
    content is audio of another kind than the name says), ``truncated`` or ``ok``.
    Empty files are in none of Spark's scans, so a path that is missing is no audio.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.withColumn("claimed", claimed_type("path"))
    apart = (F.col("length") > most_bytes) | F.col("claimed").isNull()
    # the filter on the length reaches the scan, so large files are listed and not opened
    large = named.where(F.col("length") > most_bytes).select("path", "length", "claimed")
    other = named.where(F.col("length") <= most_bytes).where(F.col("claimed").isNull()).select("path", "length", "claimed")

    @F.pandas_udf("content_type string, whole boolean")
    def judged(head: pd.Series, tail: pd.Series, length: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([contained(h, t, n) for h, t, n in zip(head, tail, length)], columns=["content_type", "whole"])

    some = named.where(F.col("length") <= most_bytes).where(~apart)
    cut = some.select(
        "path", "length", "claimed", F.substring("content", 1, HEAD).alias("head"),
        F.expr(f"substring(content, greatest(1, cast(length - {TAIL} + 1 as int)))").alias("tail"),
    )
    found = cut.withColumn("j", judged("head", "tail", "length")).select("path", "length", "claimed", "j.*")
    verdict = (
        F.when(F.col("content_type").isNull(), "not_audio")
        .when(F.col("content_type") != F.col("claimed"), "renamed")
        .when(~F.col("whole"), "truncated")
        .otherwise("ok")
    )
    found = found.select("path", "length", "claimed", "content_type", verdict.alias("verdict"))
    none = F.lit(None).cast("string").alias("content_type")
    rest = [df.select("path", "length", "claimed", none, F.lit(v).alias("verdict")) for df, v in ((large, "too_large"), (other, "not_audio"))]
    return found.unionByName(rest[0]).unionByName(rest[1])
