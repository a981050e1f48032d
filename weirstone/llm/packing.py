"""Problem 7: fixed-capacity containers filled with items of varying length.

Sum-of-squares packing: an array holds how many open containers stand at each
fill level; an item goes to the level that makes the sum of the squared counts
least.  Items are placed online, in the order of their ids; those above the
capacity are first cut into full parts and a rest.

Documents are dealt by a hash of their id into shards of about SHARD_TOKENS
tokens, each packed by itself, so no task's size depends on the whole.  A shard
ends with at most a few containers open at each level, so what sharding leaves
unused falls with the size of a shard, not with the number of shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, sized

SHARD_TOKENS = 16_000_000
_SCHEMA = "container_kind string, container_id bigint, doc_id bigint, part_no bigint, n_parts bigint, token_start bigint, token_end bigint, slot_start bigint, capacity_tokens bigint"


def place(sizes, capacity):
    """Container number and start of each item, none above the capacity, in the given order.

    Equal sums are decided for the fuller container."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open containers at each level; none at 0 and at the capacity
    at_level = [[] for _ in range(capacity + 1)]
    where, starts, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes):
        room = capacity - s
        # change of the sum of squares for a container at level h: leaves h, enters h + s (full ones no longer count)
        gain = 2 * (counts[s:] - counts[: room + 1])
        gain[room] -= 2 * counts[capacity] + 1
        gain += 2
        gain[counts[: room + 1] == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * counts[s] + 1 if s < capacity else 0
        level = room - int(np.argmin(gain[::-1]))
        if level == 0:
            box, n = n, n + 1
        else:
            box = at_level[level].pop()
            counts[level] -= 1
        where[i], starts[i] = box, level
        if level + s < capacity:
            counts[level + s] += 1
            at_level[level + s].append(box)
    return where, starts


def parts(doc_ids, tokens, capacity):
    """(doc_id, part_no, n_parts, token_start, token_end) of every part, in the order of the ids."""
    out = []
    for d, n in sorted(zip(doc_ids, tokens)):
        k = -(-n // capacity)
        out += [(d, p + 1, k, p * capacity, min(n, (p + 1) * capacity)) for p in range(k)]
    return out


def _pack(key, group):
    kind, shard, capacity = key
    some = parts(group.doc_id.tolist(), group.n_tokens.tolist(), int(capacity))
    where, starts = place([e - s for *_, s, e in some], int(capacity))
    out = pd.DataFrame(some, columns=["doc_id", "part_no", "n_parts", "token_start", "token_end"])
    out["container_kind"], out["capacity_tokens"] = kind, int(capacity)
    out["container_id"] = (np.int64(shard) << 32) + where
    out["slot_start"] = starts
    return out[["container_kind", "container_id", "doc_id", "part_no", "n_parts", "token_start", "token_end", "slot_start", "capacity_tokens"]]


def pack(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per document part: its container and its place there, for every kind of container.

    Texts that are null or empty take no room and give no row. capacities is a
    table of a few rows; kinds without a positive capacity give none."""
    sizes = cut(sized(documents, vocabulary=vocabulary))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in capacities.where("capacity_tokens > 0 and container_kind is not null").collect()}  # a few
    if not kinds:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())]))
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).select("doc_id", "n_tokens", "shard", each.alias("k")).select("doc_id", "n_tokens", "shard", "k.*")
    return dealt.groupBy("container_kind", "shard", "capacity").applyInPandas(_pack, _SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, parts, tokens and the filled share by kind."""
    per = packed.groupBy("container_kind").agg(
        F.count("*").alias("parts"), F.count_distinct("container_id").alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.max("capacity_tokens").alias("capacity_tokens")
    )
    return per.withColumn("filled_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def limits(packed: DataFrame, documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """By kind of container: capacity, documents with a text, and how often a rule is broken: containers above the capacity,
    documents that are not whole (parts that overlap or are missing), and documents in parts though they fit."""
    kinds = capacities.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    over = packed.groupBy("container_kind", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.max("capacity_tokens").alias("c"), F.max(F.col("slot_start") + F.col("token_end") - F.col("token_start")).alias("top"))
    over = over.where("n > c or top > c").groupBy("container_kind").agg(F.count("*").alias("over"))
    per = packed.groupBy("container_kind", "doc_id").agg(
        F.count("*").alias("k"), F.max("n_parts").alias("n_parts"), F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.max("token_end").alias("last"), F.min("token_start").alias("first"), F.max("capacity_tokens").alias("c")
    )
    bad = (F.col("k") != F.col("n_parts")) | (F.col("n") != F.col("last")) | (F.col("first") != 0)
    docs = per.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if(bad).alias("broken"), F.count_if((F.col("k") > 1) & (F.col("last") <= F.col("c"))).alias("split"))
    whole = kinds.join(docs, "container_kind", "left").join(over, "container_kind", "left").fillna(0)
    return whole.select("container_kind", "capacity_tokens", "documents", F.col("over").alias("over_capacity"), F.col("broken").alias("not_whole"), F.col("split").alias("split_though_fitting"))
