"""Paired statistics: means with All groups, gains, percentiles, slopes, rank correlation, resampling tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def means_with_all(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count and mean for every combination of the groups and their totals, which are named All; null groups are named (null)."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in by], value)
    out = named.cube(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(by)])
    return out.select(*[F.when(F.col(f"_g{i}") == 1, "All").otherwise(F.col(c)).alias(c) for i, c in enumerate(by)], "n", "mean_value")


def paired_gain(df: DataFrame, pair: list[str], arm: str, value: str, baseline: str, treated: str, by: list[str]) -> DataFrame:
    """Means of both arms over complete pairs, their difference, and the relative gain in percent (null for a zero base)."""
    one = df.groupBy(*by, *pair).agg(F.avg(F.when(F.col(arm) == baseline, F.col(value))).alias("b"), F.avg(F.when(F.col(arm) == treated, F.col(value))).alias("t")).where("b is not null and t is not null")
    m = one.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("b").alias("mb"), F.avg("t").alias("mt"))
    return m.select(*by, "pairs", F.round("mb", 6).alias("baseline_mean"), F.round("mt", 6).alias("treated_mean"), F.round(F.col("mt") - F.col("mb"), 6).alias("difference"), F.round((F.col("mt") / F.nullif("mb", F.lit(0.0)) - 1) * 100, 6).alias("gain_percent"))


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Interpolated and nearest-rank percentiles of each group; nulls are left out."""
    some = df.where(F.col(value).isNotNull())
    aggs = [F.count("*").alias("n")]
    for p in at:
        aggs += [F.round(F.expr(f"percentile({value}, {p})"), 6).alias(f"p{int(p * 100)}"), F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"rank_p{int(p * 100)}")]
    return some.groupBy(*by).agg(*aggs)


def slope(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


def average_rank(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds the rank of the column within its group, ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rank correlation of complete rows; null where a side is constant.

    Ranks of repeated values are found over the distinct values, so a value that many rows share costs one row."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c, name):
        per = some.groupBy(*by, c).agg(F.count("*").alias("_c"))
        below = F.sum("_c").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return per.select(*by, c, (below - (F.col("_c") - 1) / 2.0).alias(name))

    both = some.join(ranks(x, "rx"), [*by, x]).join(ranks(y, "ry"), [*by, y])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def holm(df: DataFrame, by: list[str], key: str, p: str) -> DataFrame:
    """Holm's step-down correction: the running maximum of (m - rank + 1) p, at most 1.

    Null p values count in the family's size m, but take no rank and stay null."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), key))).withColumn("_m", F.count("*").over(w))
    raw = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    most = F.max("_raw").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    run = r.withColumn("_raw", raw).withColumn("adjusted", F.when(F.col(p).isNotNull(), most))
    return run.drop("_r", "_m", "_raw")


def signflip_exact(df: DataFrame, by: list[str], difference: str, most: int = 16, permutations: int = 9999, seed: int = 20260913) -> DataFrame:
    """One-sided sign-flip test over all 2^k sign patterns of a group's k <= most cluster differences: the
    share of patterns whose mean is at least the observed one. Larger groups take ``permutations`` seeded
    random patterns, (hits + 1) / (permutations + 1); a group's task holds one number a cluster."""
    g = df.where(F.col(difference).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(difference)).alias("_d"), F.count("*").alias("clusters"))  # k is the number of clusters
    small = g.where(F.col("clusters") <= most).select(*by, "clusters", "_d", F.explode(F.expr("sequence(0L, shiftleft(1L, int(clusters)) - 1)")).alias("mask"))
    total = F.expr("aggregate(transform(_d, (x, i) -> if(shiftright(mask, i) % 2 = 1, -x, x)), 0D, (a, x) -> a + x)")
    seen = F.expr("aggregate(_d, 0D, (a, x) -> a + x)")
    t = small.select(*by, "clusters", (total >= seen - 1e-9).alias("hit")).groupBy(*by, "clusters").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("p_value"))

    def sample(batches):
        for b in batches:
            p = []
            for d in b["_d"]:
                d, rng = np.asarray(d, float), np.random.default_rng(seed)
                hits = sum(d @ (rng.integers(0, 2, len(d)) * 2 - 1) >= d.sum() - 1e-9 for _ in range(permutations))
                p.append(round((hits + 1) / (permutations + 1), 6))
            yield b.drop(columns="_d").assign(p_value=p)

    many = g.where(F.col("clusters") > most).select(*by, "clusters", "_d")
    return t.unionByName(many.mapInPandas(sample, T.StructType([*many.drop("_d").schema, T.StructField("p_value", T.DoubleType())])))


def bootstrap(df: DataFrame, by: str, value: str, cluster: str, draws: int = 2000, seed: int = 20260913) -> DataFrame:
    """Mean of the cluster means with a 95 % percentile interval from resampled clusters.

    Clusters are averaged before the shuffle; a group's task holds one number a cluster."""
    means = df.where(F.col(value).isNotNull()).groupBy(by, cluster).agg(F.avg(value).alias("m")).drop(cluster)

    def resample(g: pd.DataFrame) -> pd.DataFrame:
        m = np.sort(g["m"].to_numpy())
        rng = np.random.default_rng(seed)
        got = np.array([m[rng.integers(0, len(m), len(m))].mean() for _ in range(draws)])
        lo, hi = np.percentile(got, [2.5, 97.5])
        return pd.DataFrame({by: [g[by].iloc[0]], "clusters": [len(m)], "mean_value": [m.mean()], "low": [lo], "high": [hi]})

    return means.groupBy(by).applyInPandas(resample, f"{by} string, clusters bigint, mean_value double, low double, high double")


def paired_bootstrap(df: DataFrame, by: str, baseline: str, treated: str, cluster: str, draws: int = 2000, seed: int = 20260913) -> DataFrame:
    """Mean difference of complete pairs, one a row, with a 95 % percentile interval from resampled clusters.

    Clusters weigh by their pairs: a draw is the sum of its clusters' differences over the sum of their
    counts. A single cluster has no interval. A group's task holds two numbers a cluster."""
    some = df.where(F.col(baseline).isNotNull() & F.col(treated).isNotNull())
    per = some.groupBy(by, cluster).agg(F.sum(F.col(treated) - F.col(baseline)).alias("_s"), F.count("*").alias("_c")).drop(cluster)

    def resample(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_s", "_c"])
        s, c, k = g["_s"].to_numpy(float), g["_c"].to_numpy(), len(g)
        rng = np.random.default_rng(seed)
        lo = hi = None
        if k > 1:
            got = [s[i].sum() / c[i].sum() for i in (rng.integers(0, k, k) for _ in range(draws))]
            lo, hi = np.percentile(got, [2.5, 97.5])
        return pd.DataFrame({by: [g[by].iloc[0]], "pairs": [c.sum()], "clusters": [k], "difference": [s.sum() / c.sum()], "low": pd.Series([lo], dtype=float), "high": pd.Series([hi], dtype=float)})

    return per.groupBy(by).applyInPandas(resample, f"{by} {dict(df.dtypes)[by]}, pairs bigint, clusters bigint, difference double, low double, high double")
