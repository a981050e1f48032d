"""The append-only event log: idempotent replay keys, late events after a turn's close.

``append`` is the streaming operator (state per turn in the state store);
``replay`` is its batch form over a bounded log.  Both give every row an outcome:

* accepted - the first row of its (session, turn, key)
* repeated - the key of an accepted row with the same data
* conflict - the key of an accepted row with other data
* late - a key that first comes when its turn has been closed, by an accepted row with ``closes``
"""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "session_id string, turn_number bigint, event_key string, data string, outcome string"
#: The order of a turn's rows.
ORDER = ["at", "event_key", "data"]


def replay(log: DataFrame) -> DataFrame:
    """log: session_id, turn_number, event_key, data, at, closes. A turn's rows are taken in the order of ``at``, key, data."""
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    key = Window.partitionBy("session_id", "turn_number", "event_key").orderBy(*order)
    turn = Window.partitionBy("session_id", "turn_number").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = log.withColumns({"_n": F.row_number().over(key), "_first": F.first("data").over(key)})
    # the first row that closes among the first rows of their keys is itself accepted, and closes
    x = x.withColumn("_closed", F.coalesce(F.bool_or(F.coalesce("closes", F.lit(False)) & (F.col("_n") == 1)).over(turn), F.lit(False)))
    x = x.withColumn("_late", F.first("_closed").over(key))
    outcome = F.when(F.col("_late"), "late").when(F.col("_n") == 1, "accepted").when(F.col("data").eqNullSafe(F.col("_first")), "repeated").otherwise("conflict")
    return x.select("session_id", "turn_number", "event_key", "data", outcome.alias("outcome"))


def mark(data) -> str | None:
    """What the state keeps of a row's data: its length and two checksums."""
    raw = None if data is None else data.encode("utf-8", "surrogatepass")
    return None if raw is None else f"{len(raw):x}.{zlib.crc32(raw):x}.{zlib.adler32(raw):x}"


def step(closed: bool, known: dict, rows) -> tuple[bool, list[tuple]]:
    """Whether the turn is closed after the rows (key, data, closes), and their outcomes; ``known`` {key: mark} is changed in place."""
    out = []
    for key, data, closes in rows:
        if key in known:
            outcome = "repeated" if known[key] == mark(data) else "conflict"
        elif closed:
            outcome = "late"
        else:
            known[key], outcome = mark(data), "accepted"
            closed = bool(closes)
        out.append((key, data, outcome))
    return closed, out


def append(stream: DataFrame) -> DataFrame:
    """A streaming DataFrame's outcomes. The state of a turn holds its accepted keys with marks of their data, and
    whether it is closed; nothing is forgotten. The rows of a turn in a micro-batch are taken in the order of ``at``, key, data."""

    def run(key, batches, state: GroupState):
        closed, known = json.loads(state.get[0]) if state.exists else (False, {})
        known = {None if k == "null" else k[1:]: m for k, m in known.items()}
        rows = pd.concat(list(batches)).sort_values(ORDER, na_position="first")
        none = lambda x: None if x is None or x is pd.NA or x != x else x
        closed, out = step(closed, known, [(none(k), none(d), none(c)) for k, d, c in zip(rows.event_key, rows.data, rows.closes)])
        state.update((json.dumps([closed, {"null" if k is None else "=" + k: m for k, m in known.items()}]),))
        yield pd.DataFrame([(key[0], key[1], *r) for r in out], columns=["session_id", "turn_number", "event_key", "data", "outcome"])

    return stream.groupBy("session_id", "turn_number").applyInPandasWithState(run, SCHEMA, "turn string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: counts in tumbling windows with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("events"))


def turns(log: DataFrame) -> DataFrame:
    """One row a recorded turn: its number in the session, the sequence numbers before its first event (before_cutoff)
    and of its closing one (after_cutoff, null while it is open), and its accepted events.

    log as for ``replay``; the sequence of a session counts its accepted events in order."""
    a = log.withColumn("_k", F.row_number().over(Window.partitionBy("session_id", "turn_number", "event_key").orderBy("at"))).where("_k = 1").drop("_k")
    closed = Window.partitionBy("session_id", "turn_number").orderBy("at", "event_key").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("_c", F.coalesce(F.bool_or("closes").over(closed), F.lit(False))).where("not _c")
    a = a.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("at", "turn_number", "event_key")))
    g = a.groupBy("session_id", "turn_number").agg(F.min("seq").alias("_first"), F.max(F.when(F.col("closes"), F.col("seq"))).alias("after_cutoff"), F.count("*").alias("events"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("_first"))
    return g.select("session_id", "turn_number", number.alias("number"), (F.col("_first") - 1).alias("before_cutoff"), "after_cutoff", "events")


def active_sessions(log: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows with whether their session is its user's active one: the one started last, by rows with starts = true, up to
    then. A switch leaves the old session inactive until it is started again; rows before any start are inactive."""
    w = Window.partitionBy(user).orderBy("at", F.col("starts").desc(), "session_id").rowsBetween(Window.unboundedPreceding, 0)
    now = F.last(F.when(F.col("starts"), F.col("session_id")), ignorenulls=True).over(w)
    return log.withColumn("active", F.coalesce(now == F.col("session_id"), F.lit(False)))
