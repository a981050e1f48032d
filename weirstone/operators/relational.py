"""Relational operators of the session ETL: delivery dedup, audits, bridges, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: list[str], at: str = "ingested_at", ties: list[str] = ()) -> DataFrame:
    """One row a key: the last delivered, ties by the other columns given. Null keys are one group."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of the columns: redeliveries differ in their time only."""
    return df.select(*columns).distinct()


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: rows, keys that occur more than once, rows in excess of one a key. An empty table gives zeros."""
    parts = []
    for name, (df, keys) in tables.items():
        per = df.groupBy(*keys).agg(F.count("*").alias("n"))
        parts.append(
            per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows")).select(
                F.lit(name).alias("table_name"), "row_count", "duplicate_keys", "excess_rows"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of the child with a non-null key that no parent row has."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)]).distinct()
    some = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in on]))
    return some.join(keys, [some[c] == keys[f"_p{i}"] for i, (c, _) in enumerate(on)], "left_anti")


def foreign_keys(checks: dict[str, tuple[DataFrame, DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """Orphan rows and their distinct keys by named check."""
    parts = []
    for name, (child, parent, on) in checks.items():
        lost = orphans(child, parent, on)
        key = F.concat_ws("|", *[F.col(c).cast("string") for c, _ in on])
        parts.append(lost.agg(F.count("*").alias("orphan_rows"), F.count_distinct(key).alias("orphan_keys")).select(F.lit(name).alias("check_name"), "orphan_rows", "orphan_keys"))
    return reduce(DataFrame.unionByName, parts)


def two_roles(facts: DataFrame, dim: DataFrame, key: str, roles: dict[str, Column], keep: list[str]) -> DataFrame:
    """The facts with the dimension's columns once for each role; dim is of bounded size (checked by the planner)."""
    out = facts
    for role, column in roles.items():
        side = dim.select(F.col(key).alias(f"_{role}"), *[F.col(c).alias(f"{role}_{c}") for c in keep])
        out = out.withColumn("_k", column).join(side, F.col("_k") == F.col(f"_{role}"), "left").drop("_k", f"_{role}")
    return out


def exists_flag(df: DataFrame, other: DataFrame, on: Column, key: str, name: str) -> DataFrame:
    """df with a boolean column: whether some row of the other satisfies the condition. key is unique in df."""
    hit = df.join(other, on, "left_semi").select(F.col(key).alias("_hit"))
    return df.join(hit, df[key] == F.col("_hit"), "left").withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def unnest_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(*keep, position from 0, item) of a JSON array of strings; text that is no such array gives no rows."""
    array = F.from_json(column, "array<string>")
    return df.select(*keep, F.posexplode(array).alias("position", "item"))


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = None
    for name, condition in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def conflicts(df: DataFrame, key: str, column: str, empty: str = "") -> DataFrame:
    """Keys whose rows do not agree on a column; null counts as ``empty``."""
    c = F.coalesce(F.col(column), F.lit(empty))
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(c).alias("least"), F.max(c).alias("greatest")).where(~F.col("least").eqNullSafe(F.col("greatest")))


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in one of two sets only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left_only")).unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value in a, in b, and in excess in a. Aggregates before it joins; nulls are a value."""
    x = a.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("m", F.lit(0).cast("bigint"))
    y = b.groupBy(*columns).agg(F.count("*").alias("m")).withColumn("n", F.lit(0).cast("bigint"))
    both = x.unionByName(y).groupBy(*columns).agg(F.sum("n").alias("left_count"), F.sum("m").alias("right_count"))
    return both.withColumn("excess", F.greatest(F.col("left_count") - F.col("right_count"), F.lit(0)))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the distinct evidence in order, and the distinct vias joined by " | "."""
    return edges.groupBy("source", "target", "relation").agg(
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"), F.nullif(F.array_join(F.array_sort(F.collect_set("via")), " | "), F.lit("")).alias("via"), F.count("*").alias("merged")
    )
