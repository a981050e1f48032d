"""Problem 8: sources mixed to target weights.

Temperature mixing: a source's weight is its token share times a power of what
the target asks of it, (target share / token share) ** a, normalised.  a = 0 takes
the sources as they are, a = 1 as the targets say.  The exponent is bisected: as
far towards the targets as the caps on repetition allow for the token budget, or
to a target entropy.  Without a budget, the largest one is taken for which the
weights keep within the caps; with the targets themselves as weights, which the
limit on repetition then allows (a = 1), the shares are met exactly.

The weights are realised as budgeted block permutations: every source runs
through whole permutations of its documents and, for the rest of its budget,
through the first blocks of one more; only the block where the budget ends is
ordered document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, sized

BLOCKS = 4096


def weights(shares, targets, a):
    raw = {k: shares[k] * (targets[k] / shares[k]) ** a for k in targets}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(w):
    return -sum((x * math.log(x) for x in w.values() if x > 0), 0.0)


def plan(tokens, targets, caps, budget=None, target_entropy=None, between=None):
    """(exponent, budget, tokens to take by source) for the sources with tokens and a target.

    tokens, targets, caps: by source. Targets of sources without tokens are spread over the others.
    The target entropy may be given by its place between that of the sources (0) and that of the
    targets (1). Without a budget it is the largest for which the weights keep within the caps."""
    known = {k: t for k, t in targets.items() if t and t > 0 and tokens.get(k, 0) > 0 and caps.get(k, 0) > 0}
    if not known:
        return 1.0, 0, {}
    norm = sum(known.values())
    known = {k: t / norm for k, t in known.items()}
    whole = sum(tokens[k] for k in known)
    shares = {k: tokens[k] / whole for k in known}

    def bisect(good):
        if good(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    a = 1.0
    if between is not None:
        target_entropy = (1 - between) * entropy(shares) + between * entropy(known)
    if target_entropy is not None:
        down = entropy(shares) >= entropy(known)
        a = bisect(lambda x: (entropy(weights(shares, known, x)) >= target_entropy) == down)
    elif budget is not None:
        a = bisect(lambda x: all(w * budget <= caps[k] * tokens[k] * (1 + 1e-12) for k, w in weights(shares, known, x).items()))
    by = weights(shares, known, a)
    if budget is None:
        budget = int(min(caps[k] * tokens[k] / by[k] for k in known))
    return a, budget, {k: min(int(w * budget), caps[k] * tokens[k]) for k, w in by.items()}


def _sizes(documents: DataFrame, targets: DataFrame, vocabulary: str):
    """(documents of the listed sources with their sizes, tokens by source, target shares, caps)."""
    aims = {r["source"]: r for r in targets.where("source is not null").collect()}  # the listed sources only
    sizes = cut(sized(documents, "source", vocabulary=vocabulary).where(F.col("source").isin(list(aims))))
    tokens = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return sizes, tokens, {k: r["target_share"] for k, r in aims.items()}, {k: r["max_repeats"] or 0 for k, r in aims.items()}


def planned(documents: DataFrame, targets: DataFrame, budget: int | None = None, target_entropy: float | None = None, between: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per listed source: its tokens and token share, its target share, and the weight, exponent, entropy and budget of the plan."""
    _, tokens, aims, caps = _sizes(documents, targets, vocabulary)
    a, budget, takes = plan(tokens, aims, caps, budget, target_entropy, between)
    total, got = sum(tokens.values()) or 1, sum(takes.values()) or 1
    known = {k: n / got for k, n in takes.items()}
    rows = [(k, tokens.get(k, 0), tokens.get(k, 0) / total, float(t or 0.0), known.get(k, 0.0), takes.get(k, 0), a, entropy(known), budget) for k, t in sorted(aims.items())]
    return documents.sparkSession.createDataFrame(rows, "source string, tokens bigint, token_share double, target_share double, weight double, tokens_to_take bigint, exponent double, entropy double, budget bigint")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, target_entropy: float | None = None, between: float | None = None, vocabulary: str = VOCABULARY, blocks: int = BLOCKS) -> DataFrame:
    """One row per use of a document: doc_id, source, repeat_no from 1, n_tokens and mix_key, by which the sources interleave evenly.

    targets is a table of a few rows (source, target_share, max_repeats). Without a budget it is
    the largest for which the weights keep the caps. Sources
    without a target, null sources and texts without tokens are left out. No
    document occurs more than max_repeats times; a source's tokens fall short of
    its budget by less than one document."""
    sizes, tokens, shares_, caps = _sizes(documents, targets, vocabulary)
    _, _, takes = plan(tokens, shares_, caps, budget, target_entropy, between)
    spark = documents.sparkSession
    rows = [(k, n // tokens[k], n % tokens[k], n / tokens[k]) for k, n in takes.items() if n > 0]
    todo = F.broadcast(spark.createDataFrame(rows, "source string, whole bigint, rest bigint, epochs double"))
    used = sizes.join(todo, "source").withColumn("repeat_no", F.explode(F.expr("sequence(1L, whole + if(rest > 0, 1L, 0L))")))
    used = used.withColumn("h", F.xxhash64("doc_id", "repeat_no")).withColumn("block", F.shiftrightunsigned("h", 64 - int(math.log2(blocks))))
    full, last = used.where("repeat_no <= whole"), used.where("repeat_no > whole")
    sums = last.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    upto = sums.withColumn("before", F.sum("in_block").over(Window.partitionBy("source").orderBy("block")) - F.col("in_block"))  # at most `blocks` rows a source
    last = last.join(F.broadcast(upto), ["source", "block"]).where("before < rest")  # at most `blocks` rows a source
    inside = last.where("before + in_block <= rest").drop("in_block", "before")
    edge = last.where("before + in_block > rest")  # one block a source
    edge = edge.withColumn("so_far", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id")) + F.col("before")).where("so_far <= rest").drop("so_far", "in_block", "before")
    at = (F.col("repeat_no") - 1 + F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) / F.col("epochs")
    return full.unionByName(inside).unionByName(edge).select("doc_id", "source", "repeat_no", "n_tokens", at.alias("mix_key"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, tokens, documents and the most repeats by source; sources without documents reach 0."""
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("repeat_no").alias("most_repeats"))
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy())  # one row a listed source
    return out.withColumn("reached_share", F.round(F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6))


def limits(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """By listed source: its documents with a text, and how often a rule is broken: uses above max_repeats,
    uses numbered twice, and documents used of another source."""
    own = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "source").dropDuplicates()
    have = own.groupBy("source").agg(F.count("*").alias("documents"))
    used = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("uses"), F.max("repeat_no").alias("last"))
    strange = used.join(own, ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count("*").alias("strange"))
    per = used.join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("over"), F.count_if(F.col("uses") != F.col("last")).alias("twice"))
    whole = targets.select("source", F.col("max_repeats").cast("bigint").alias("max_repeats")).join(have, "source", "left").join(per, "source", "left").join(strange, "source", "left").fillna(0)
    return whole.select("source", "max_repeats", "documents", F.col("over").alias("over_repeats"), F.col("twice").alias("numbered_twice"), F.col("strange").alias("of_another_source"))
