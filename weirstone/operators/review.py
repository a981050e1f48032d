"""Gold assembly, review completeness, attribution, inferred keys, claims and packing of prompts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def assemble(parts: dict[str, DataFrame], keys: list[str], agree: list[str]) -> DataFrame:
    """Parts joined by their keys; ``agree`` columns must be equal in all parts that have them, else the row fails the query."""
    out = None
    for name, df in parts.items():
        renamed = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = renamed if out is None else out.join(renamed, keys)
    for c in agree:
        have = [f"{n}_{c}" for n, df in parts.items() if c in df.columns]
        for a, b in combinations(have, 2):
            same = F.assert_true(F.col(a).eqNullSafe(F.col(b)), F.concat(F.lit(f"{a} differs from {b}")))
            out = out.where(same.isNull())
    return out


#: Most names of a side of a grid; more are an error, not a cut.
NAMES = 10_000


def missing_cells(expected: list[DataFrame], seen: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid of the given one-column tables of bounded size (reviewers, arms, ...) and a long one that have no row."""
    grid = expected[0]
    for side in expected[1:]:  # lists of names
        names = [r[0] for r in side.distinct().orderBy(side.columns[0]).limit(NAMES + 1).collect()]
        if len(names) > NAMES:
            raise ValueError(f"{side.columns[0]} has more than {NAMES} names; it is no list for a grid")
        grid = grid.withColumn(side.columns[0], F.explode(F.array(*map(F.lit, names))))
    return grid.join(seen.select(*keys).distinct(), keys, "left_anti")


def progress(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """complete, failed or pending for every cell, the best status of its attempts, and its tokens."""
    rank = F.when(F.col("status") == "complete", 2).when(F.col("status") == "failed", 1).otherwise(0)
    best = results.groupBy(*keys).agg(F.max_by("status", rank).alias("status"), F.sum("tokens").alias("tokens"), F.count("*").alias("attempts"))
    return grid.join(best, keys, "left").select(*keys, F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def retry_merge(first: DataFrame, again: DataFrame, keys: list[str], value: str, failed: Column) -> DataFrame:
    """First results, with failed ones replaced by their retry where there is one."""
    r = again.select(*keys, F.col(value).alias("_again"))
    return first.join(r, keys, "left").withColumn(value, F.when(failed & F.col("_again").isNotNull(), F.col("_again")).otherwise(F.col(value))).drop("_again")


def attribution(required: DataFrame, shown: DataFrame, reached: DataFrame, judged: DataFrame, key: str, line: list[str]) -> DataFrame:
    """Why a finding failed: judgment if all its required lines were shown and it was still judged wrong,
    presentation if its files were reached but not all lines shown, selection if they were not reached, else unresolved."""
    lost = required.join(shown.select(*line).distinct(), line, "left_anti").groupBy(key).agg(F.count("*").alias("missing_lines"))
    files = required.select(key, line[0]).distinct().join(reached.select(line[0]).distinct(), line[0], "left_anti").groupBy(key).agg(F.count("*").alias("missing_files"))
    have = required.select(key).distinct().withColumn("_has", F.lit(True))
    out = judged.join(have, key, "left").join(lost, key, "left").join(files, key, "left").fillna(0, ["missing_lines", "missing_files"])
    why = F.when(F.col("correct"), None).when(F.col("_has").isNull(), "unresolved").when(F.col("missing_files") > 0, "selection").when(F.col("missing_lines") > 0, "presentation").otherwise("judgment")
    return out.select(key, "correct", "missing_lines", "missing_files", why.alias("cause"))


def shares(df: DataFrame, by: list[str], cause: str) -> DataFrame:
    n = df.where(F.col(cause).isNotNull()).groupBy(*by, cause).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


def counterfactual(runs: DataFrame, key: str) -> DataFrame:
    """Runs (key, setting in alone, absent, original; passed): whether a change fails alone, and passes absent and on the original."""
    p = runs.groupBy(key).pivot("setting", ["alone", "absent", "original"]).agg(F.bool_and("passed"))
    return p.withColumn("verified", F.coalesce(~F.col("alone") & F.col("absent") & F.col("original"), F.lit(False)))


def key_profile(tables: dict[str, DataFrame]) -> list[dict]:
    """Columns that may be keys: named *id or *key and without nulls; unique ones are marked. One aggregation a table."""
    out = []
    for name, df in tables.items():
        cols = [c for c in df.columns if c.lower().endswith(("id", "key"))]
        if not cols:
            continue
        r = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)], *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        out += [{"table": name, "column": c, "unique": r[f"d{i}"] == r["n"]} for i, c in enumerate(cols) if r["n"] and r[f"c{i}"] == r["n"]]
    return out


def inferred_route(tables: dict[str, DataFrame], start: str, goal: str, hops: int = 3) -> list[tuple[str, str, str, str]]:
    """A shortest chain of joins on inferred keys: [(table, column, table, unique column)]; among equal ones that of the widest overlap."""
    keys, routes, seen = key_profile(tables), [(start, [])], {start}
    for _ in range(hops):
        found = []
        for at, path in routes:
            for a in (k for k in keys if k["table"] == at):
                for b in (k for k in keys if k["unique"] and k["table"] not in seen):
                    left, right = tables[at].select(F.col(a["column"]).cast("string").alias("k")), tables[b["table"]].select(F.col(b["column"]).cast("string").alias("k"))
                    n = left.join(right.distinct(), "k", "left_semi").count()
                    if n:
                        found.append((n, b["table"], [*path, (at, a["column"], b["table"], b["column"])]))
        found.sort(key=lambda x: (-x[0], x[1]))
        for _, t, path in found:
            if t == goal:
                return path
        routes, seen = [(t, path) for _, t, path in found], seen | {t for _, t, _ in found}
    return []


def join_route(tables: dict[str, DataFrame], route: list[tuple[str, str, str, str]]) -> DataFrame:
    """The tables of a route joined; columns are named table.column with an underscore."""
    named = {t: df.select(*[F.col(c).alias(f"{t}_{c}") for c in df.columns]) for t, df in tables.items()}
    out = named[route[0][0]]
    for a, x, b, y in route:
        out = out.join(named[b], F.col(f"{a}_{x}") == F.col(f"{b}_{y}"), "left")
    return out


def claim_status(claims: DataFrame, experiments: DataFrame, key: str, value: str) -> DataFrame:
    """unique, ambiguous or unresolved for each claim by the experiments of its key, and whether a unique one's value agrees."""
    e = experiments.groupBy(key).agg(F.count("*").alias("candidates"), F.min(value).alias("_v"))
    out = claims.join(e, key, "left")
    status = F.when(F.col("candidates").isNull(), "unresolved").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return out.withColumn("status", status).withColumn("agrees", F.when(F.col("status") == "unique", F.col(value).eqNullSafe(F.col("_v")))).drop("_v")


def greedy_coverage(df: DataFrame, by: str, item: str, member: str, weight: str, decay: float = 0.5) -> DataFrame:
    """Items of each group in greedy order of what they add: a member's weight counts less each time it is covered again."""

    def order(g: pd.DataFrame) -> pd.DataFrame:
        worth = dict(zip(g[member], g[weight]))
        left = {k: set(v[member]) for k, v in g.groupby(item)}
        out = []
        while left:
            gain = {k: sum(worth[m] for m in v) for k, v in left.items()}
            best = min(left, key=lambda k: (-gain[k], k))
            out.append((g[by].iloc[0], best, len(out) + 1, float(gain[best])))
            for m in left.pop(best):
                worth[m] *= decay
        return pd.DataFrame(out, columns=[by, item, "place", "gain"])

    kinds = dict(df.dtypes)
    return df.groupBy(by).applyInPandas(order, f"{by} {kinds[by]}, {item} {kinds[item]}, place bigint, gain double")


def next_fit(df: DataFrame, by: str, order: str, size: str, capacity: int) -> DataFrame:
    """Shards filled in order; an item that does not fit opens the next one. Items above the capacity stand alone."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        shard, used, out = 1, 0, []
        for s in g[size]:
            if used and used + s > capacity:
                shard, used = shard + 1, 0
            used += s
            out.append(shard)
        return g.assign(shard_no=np.array(out, dtype="int64"))

    return df.groupBy(by).applyInPandas(run, StructType([*df.schema.fields, StructField("shard_no", LongType())]))


def covered_ranges(inner: DataFrame, outer: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Ranges of inner with whether one of outer's merged ranges of the same group holds them."""
    o = outer.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    held = inner.join(o, by).where((F.col("_s") <= F.col(start)) & (F.col(end) <= F.col("_e"))).select(*by, start, end).distinct().withColumn("_in", F.lit(True))
    return inner.join(held, [*by, start, end], "left").withColumn("inside", F.col("_in").isNotNull()).drop("_in")


def merge_metrics(df: DataFrame, by: list[str], sums: list[str], counters: str, maxima: str) -> DataFrame:
    """Sums added, keyed counters added by key, keyed maxima taken by key."""
    base = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    c = df.select(*by, F.explode(counters)).groupBy(*by, "key").agg(F.sum("value").alias("v")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias(counters))
    m = df.select(*by, F.explode(maxima)).groupBy(*by, "key").agg(F.max("value").alias("v")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias(maxima))
    return base.join(c, by, "left").join(m, by, "left")


def selected_later(shown: DataFrame, read: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """Shown items with whether a later turn of their run reads them."""
    last = read.groupBy(*keys).agg(F.max(turn).alias("_last"))
    return shown.join(last, keys, "left").withColumn("selected_later", F.coalesce(F.col("_last") > F.col(turn), F.lit(False))).drop("_last")


def file_closure(texts: DataFrame, links: DataFrame, roots: DataFrame, depth: int = 3, most: int = 24) -> DataFrame:
    """Files reached from the roots by links (path, mention): a mention resolves to the file of that path, or to the
    only one of that name. At most ``most`` files a root, nearest first (the operator's feature); ambiguous names are listed."""
    name = F.element_at(F.split("path", "/"), -1)
    by_name = texts.select("path", name.alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    exact = links.join(texts.select(F.col("path").alias("target")), F.col("mention") == F.col("target"), "left")
    bare = exact.withColumn("name", F.element_at(F.split("mention", "/"), -1)).join(by_name, "name", "left")
    edges = bare.select(F.col("path").alias("node"), F.coalesce("target", F.when(F.col("n") == 1, F.col("only"))).alias("other"), (F.col("target").isNull() & (F.col("n") > 1)).alias("ambiguous")).distinct()
    seen = roots.select(F.col("path").alias("root"), F.col("path").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.drop("depth").join(edges.where("other is not null"), "node").select("root", F.col("other").alias("node"), F.lit(d).alias("depth")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(front)
    best = seen.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    out = best.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))).where(F.col("_k") <= most).drop("_k")
    return out.join(edges.where("ambiguous").groupBy("node").agg(F.count("*").alias("ambiguous_links")), "node", "left").fillna(0, ["ambiguous_links"])
