"""Gaze tracking: what a session's owner may store and list (C-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted_gaze(points: DataFrame, sessions: DataFrame, children: DataFrame) -> DataFrame:
    """The rows of ``points`` (session_id, child_id, ...) that may be stored, with the
    caregiver who may: their session exists and belongs to a caregiver, through
    its child, and their own child exists. ``tables.append`` stores them."""
    owners = sessions.select("session_id", F.col("child_id").alias("__of")).join(
        children.select(F.col("child_id").alias("__of"), "caregiver_id"), "__of"
    )
    known = children.select("child_id").distinct()
    return points.join(owners.drop("__of"), "session_id").join(known, "child_id", "left_semi").select(*points.columns, "caregiver_id")


def session_gaze(stored: DataFrame, session_id: int, caller: int) -> DataFrame:
    """All stored rows of a session of the caller's; none of another's."""
    return stored.where((F.col("session_id") == session_id) & (F.col("caregiver_id") == caller))
