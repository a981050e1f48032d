"""Scoring of predicted spans and sets against gold: overlap joins, P/R/F1, optimal one-to-one assignment."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of ranges that share a line, within equal keys. The equality bounds the fan-out; skewed keys are split by AQE."""
    x, y = a.alias("a"), b.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [F.col(a_span[0]) <= F.col(b_span[1]), F.col(b_span[0]) <= F.col(a_span[1])]
    joined = x.join(y, cond)
    return joined.drop(*[F.col(f"b.{k}") for k in on])


def smallest_container(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, key: list[str], name: str) -> DataFrame:
    """For each point the name of the shortest span that holds it, ties by start and name; null where none does."""
    x, y = points.alias("p"), spans.alias("s")
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in on] + [F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))]
    joined = x.join(y, cond, "left")
    best = F.min_by(F.col(f"s.{name}"), F.struct((F.col(f"s.{end}") - F.col(f"s.{start}")).alias("n"), F.col(f"s.{start}").alias("a"), F.col(f"s.{name}").alias("b")))
    return joined.groupBy(*[F.col(f"p.{k}") for k in key]).agg(best.alias("container"))


def line_prf(predicted: DataFrame, gold: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Precision, recall and F1 of predicted against gold lines in each group, from merged ranges: nothing is expanded to lines.

    predicted and gold hold disjoint ranges (see ``islands``). Empty denominators give 0."""
    p = predicted.groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + 1).alias("predicted_lines"))
    g = gold.groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + 1).alias("gold_lines"))
    q = predicted.select(*by, F.col(start).alias("ps"), F.col(end).alias("pe"))
    both = overlap_join(q, gold.select(*by, F.col(start).alias("gs"), F.col(end).alias("ge")), by, ("ps", "pe"), ("gs", "ge"))
    hit = both.groupBy(*by).agg(F.sum(F.least("pe", "ge") - F.greatest("ps", "gs") + 1).alias("hits"))
    out = p.join(g, by, "full").join(hit, by, "left").fillna(0, ["predicted_lines", "gold_lines", "hits"])
    precision = F.when(F.col("predicted_lines") > 0, F.col("hits") / F.col("predicted_lines")).otherwise(0.0)
    recall = F.when(F.col("gold_lines") > 0, F.col("hits") / F.col("gold_lines")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("predicted_lines") + F.col("gold_lines"))).otherwise(0.0)
    return out.select(*by, "predicted_lines", "gold_lines", "hits", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def set_relation(gold: Column, candidate: Column) -> Column:
    """disjoint, exact, superset, proper_subset or partial_overlap of a candidate set against a non-empty gold set."""
    g, c = F.array_distinct(gold), F.array_distinct(candidate)
    missing, extra = F.size(F.array_except(g, c)), F.size(F.array_except(c, g))
    return F.when(F.size(g) == 0, None).when(~F.arrays_overlap(g, c), "disjoint").when((missing == 0) & (extra == 0), "exact").when(missing == 0, "superset").when(extra == 0, "proper_subset").otherwise("partial_overlap")


def symbol_compatible(a: Column, b: Column) -> Column:
    """Equal symbols, or ones whose last two parts are equal; missing ones are not."""
    last = lambda x: F.slice(F.split(x, r"\."), -2, 2)
    two = (F.size(F.split(a, r"\.")) >= 2) & (F.size(F.split(b, r"\.")) >= 2)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), False).when(a == b, True).when(two, last(a) == last(b)).otherwise(False)


def location_score(symbol: Column, lines: Column) -> Column:
    return F.when(symbol & lines, 1.0).when(symbol | lines, 0.5).otherwise(0.0)


def best_matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of a one-to-one matching of greatest weight (the Hungarian method with potentials)."""
    if 0 in weights.shape:
        return []
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, way, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            k = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[k]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def assign(scores: DataFrame, by: str, left: str, right: str, score: str) -> DataFrame:
    """The optimal one-to-one assignment in each group; pairs of weight 0 are left out. A group holds one input's findings."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        w = g.pivot_table(index=left, columns=right, values=score, aggfunc="max", fill_value=0.0, sort=True)
        rows = [(g[by].iloc[0], w.index[i], w.columns[j], float(w.iat[i, j])) for i, j in best_matching(w.to_numpy()) if w.iat[i, j] > 0]
        return pd.DataFrame(rows, columns=[by, left, right, score])

    kinds = dict(scores.dtypes)
    return scores.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, {left} {kinds[left]}, {right} {kinds[right]}, {score} double")


def permute(weights: np.ndarray) -> tuple[int, ...]:
    """Of all permutations of up to five columns the one of greatest sum; the lexicographically first wins ties."""
    return max(permutations(range(weights.shape[1]), weights.shape[0]), key=lambda p: (round(sum(weights[i, j] for i, j in enumerate(p)), 9), [-x for x in p]))


def set_classes(items: DataFrame, key: str, item: str) -> DataFrame:
    """One row per class of records with equal sets: class_id (a digest of the set), representative (the least key), members and the set.

    A null item adds nothing to its record's set, so a record of nulls alone has the empty set; null keys give none."""
    return _class_of(items, key, item).groupBy("class_id").agg(F.min(key).alias("representative"), F.count("*").alias("members"), F.first("_items").alias("_items"))


def _class_of(items: DataFrame, key: str, item: str) -> DataFrame:
    sets = items.where(F.col(key).isNotNull()).select(key, item).distinct().groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return sets.withColumn("class_id", F.sha2(F.to_json(F.struct("_items")), 256))


def set_pairs(items: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Pairs of representatives of equal sets, with Jaccard similarity of at least ``least``; ``set_members`` has the copies.

    Records with equal sets are one class (so copies are never paired); classes are
    joined on the rarest items of their prefix, which any similar pair must share."""
    return _class_pairs(set_classes(items, key, item), least)


def _class_pairs(reps: DataFrame, least: float) -> DataFrame:
    freq = reps.select(F.explode("_items").alias("_i")).groupBy("_i").agg(F.count("*").alias("_f"))
    ranked = reps.select("class_id", F.size("_items").alias("_n"), F.explode("_items").alias("_i")).join(freq, "_i")
    pos = F.row_number().over(Window.partitionBy("class_id").orderBy("_f", "_i"))
    prefix = ranked.withColumn("_p", pos).where(F.col("_p") <= F.col("_n") - F.ceil(F.col("_n") * least) + 1).select("class_id", "_n", "_i")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, [F.col("a._i") == F.col("b._i"), F.col("a.class_id") < F.col("b.class_id"), F.least(F.col("a._n"), F.col("b._n")) >= F.greatest(F.col("a._n"), F.col("b._n")) * least])
    pairs = near.select(F.col("a.class_id").alias("x"), F.col("b.class_id").alias("y")).distinct()
    r = reps.select("class_id", "representative", "_items")
    full = pairs.join(r.toDF("x", "left_id", "_l"), "x").join(r.toDF("y", "right_id", "_r"), "y")
    inter = F.size(F.array_intersect("_l", "_r"))
    j = inter / (F.size("_l") + F.size("_r") - inter)
    return full.withColumn("similarity", F.round(j, 6)).where(j >= least).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


def set_members(items: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """One row per record: its class's representative and members, and links, the other records within ``least`` of it.

    Copies are linked to each other and to all members of the similar classes."""
    reps = set_classes(items, key, item)
    return _with_links(_class_of(items, key, item).select(key, "class_id"), reps, _class_pairs(reps, least), key)


def _with_links(records: DataFrame, reps: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    size = reps.select("representative", "members")
    both = pairs.select(F.col("left_id").alias("_a"), F.col("right_id").alias("representative")).unionByName(pairs.select(F.col("right_id").alias("_a"), F.col("left_id").alias("representative")))
    near = both.join(size, "representative").groupBy("_a").agg(F.sum("members").alias("_near")).withColumnRenamed("_a", "representative")
    per = reps.select("class_id", "representative", "members").join(near, "representative", "left")
    return records.join(per, "class_id").select(key, "representative", "members", (F.col("members") - 1 + F.coalesce("_near", F.lit(0))).alias("links"))


def set_links(items: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """All similar records as links: ``set_pairs``, and every copy to its representative with similarity 1.

    Copies are linked to one record only, so that a class of n members gives n - 1 rows."""
    reps = set_classes(items, key, item)
    some = reps.where("members > 1").select("class_id", "representative")
    copies = _class_of(items, key, item).join(some, "class_id").where(F.col(key) != F.col("representative"))
    return _class_pairs(reps, least).unionByName(copies.select(F.col("representative").alias("left_id"), F.col(key).alias("right_id"), F.lit(1.0).alias("similarity")))
