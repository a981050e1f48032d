"""Ordered-sequence operators: as-of and range windows, segments, islands, interleaving, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def ranked(df: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds row_no and, for a value, running: the place and the running sum of each row in its group.

    A group may hold any share of the rows: rows are range-partitioned by group and order,
    counted within each range, and the ranges before a row are added as one number. by and
    order are not null and order is unique within by, as a window over the group would need too."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = keep(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    v = F.lit(0) if value is None else F.coalesce(F.col(value), F.lit(0))
    sums = x.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.sum(v).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_range")  # at most one row a range
    before = sums.select("_range", *by, (F.sum("_n").over(w) - F.col("_n")).alias("_n"), (F.sum("_v").over(w) - F.col("_v")).alias("_v"))
    local = Window.partitionBy("_range", *by).orderBy(*order)
    y = x.withColumns({"row_no": F.row_number().over(local), "running": F.sum(v).over(local.rowsBetween(Window.unboundedPreceding, 0))}).join(before, ["_range", *by])
    out = y.withColumns({"row_no": F.col("row_no") + F.col("_n"), "running": F.col("running") + F.col("_v")}).drop("_range", "_n", "_v")
    return out if value is not None else out.drop("running")


def asof_windows(df: DataFrame, by: list[str], order: str, is_target: Column, counted: dict[str, Column]) -> DataFrame:
    """For every target row: the order of the target before it (null for the first) and, of the rows
    from there up to it, how many satisfy each counted condition.

    One running sum over the sequence instead of an as-of and a range join: the window's count is the
    difference of the running counts at its two ends. Null orders are left out; orders are unique within ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = df.where(F.col(order).isNotNull())
    for name, cond in counted.items():
        some = some.withColumn(f"_{name}", F.coalesce(F.count_if(F.coalesce(cond, F.lit(False))).over(w), F.lit(0)))
    t = some.where(is_target)
    v = Window.partitionBy(*by).orderBy(order)
    t = t.withColumn("start_at", F.lag(order).over(v))
    for name in counted:
        # rows before the previous target are taken off; the previous target itself is inside the window
        t = t.withColumn(name, F.when(F.col("start_at").isNull(), F.lit(0)).otherwise(F.col(f"_{name}") - F.lag(f"_{name}").over(v)).cast("bigint"))
    return t.drop(*[f"_{n}" for n in counted])


def asof_previous(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, Column], matches: Column | None = None) -> DataFrame:
    """Adds, for every row, columns of the latest earlier row (that matches); null where there is none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    m = F.lit(True) if matches is None else F.coalesce(matches, F.lit(False))
    return df.withColumns({n: F.last(F.when(m, F.struct(c.alias("v"))), ignorenulls=True).over(w)["v"] for n, c in columns.items()})


def segments(df: DataFrame, by: list[str], order: str, opens: Column) -> DataFrame:
    """Rows with the number of the segment they are in (a new one at every opening row) and their index in it, from 1.
    Rows before the first opening row are left out."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("segment_no", F.sum(F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("segment_no > 0")
    return out.withColumn("sequence_index", F.row_number().over(Window.partitionBy(*by, "segment_no").orderBy(order)))


def precedes(df: DataFrame, by: list[str], position: str, task: str) -> DataFrame:
    """Edges between adjacent positions that hold exactly one task each."""
    per = df.groupBy(*by, position).agg(F.count_distinct(task).alias("n"), F.min(task).alias("t"))
    w = Window.partitionBy(*by).orderBy(position)
    nxt = per.withColumns({"n2": F.lead("n").over(w), "t2": F.lead("t").over(w)})
    return nxt.where((F.col("n") == 1) & (F.col("n2") == 1) & (F.col("t") != F.col("t2"))).select(*by, F.col("t").alias("source"), F.col("t2").alias("target"), F.col(position).alias("at"))


def order_violations(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def islands(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Ranges merged where they touch or overlap (start <= greatest end so far + 1). Ranges with a null end or end < start are left out."""
    some = df.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = some.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def complement(merged: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The gaps between consecutive merged ranges."""
    w = Window.partitionBy(*by).orderBy(start)
    gap = merged.withColumn("_prev", F.lag(end).over(w)).where(F.col("_prev").isNotNull())
    return gap.select(*by, (F.col("_prev") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))


def line_chunks(df: DataFrame, text: str, keep: list[str], size: int) -> DataFrame:
    """(…, chunk_no from 1, line_start, line_end): runs of ``size`` lines. Null texts give none, empty ones one line."""
    n = F.size(F.split(text, "\n", -1))
    some = df.where(F.col(text).isNotNull()).select(*keep, n.alias("_n"))
    out = some.select(*keep, "_n", F.posexplode(F.sequence(F.lit(1), F.col("_n"), F.lit(size))).alias("_i", "line_start"))
    return out.select(*keep, (F.col("_i") + 1).alias("chunk_no"), "line_start", F.least(F.col("line_start") + size - 1, F.col("_n")).alias("line_end"))


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """k: the row's place in its group; the k-th rows of all groups come before the next ones."""
    return ranked(df, [group], order).withColumnRenamed("row_no", "k")


def budget_prefix(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The rows of each group, in order, whose running cost stays within the budget."""
    return ranked(df, by, order, cost).where(F.col("running") <= budget).withColumnRenamed("running", "running_cost").drop("row_no")


def budget_skip(df: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Greedy choice that passes over what does not fit and goes on: one sequential pass over each group."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for c in group.sort_values(order)[cost]:
            fits = c <= left
            left -= c if fits else 0
            keep.append(fits)
        return group.sort_values(order)[keep]

    return df.groupBy(by).applyInPandas(choose, df.schema)


def tertiles(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """small, medium and large by rank i among n: i < n div 3, i < 2n div 3, else."""
    n = df.groupBy(*by).agg(F.count("*").alias("_m"))
    x = ranked(df, by, order).join(n, by).withColumn("_i", F.col("row_no") - 1)
    return x.withColumn("bin", F.when(F.col("_i") < F.expr("_m div 3"), "small").when(F.col("_i") < F.expr("2 * _m div 3"), "medium").otherwise("large")).drop("_i", "_m", "row_no")


def capped(df: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each group, the first ones in order (the operator's feature)."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank_in_group") <= cap)


def page(df: DataFrame, by: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of each group with the total and the next offset (null on the last page)."""
    w = Window.partitionBy(*by)
    out = df.withColumns({"item_no": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)})
    out = out.where(F.col("item_no").between(offset + 1, offset + limit))
    return out.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("int"))


def head_tail(df: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows taken from the head and the tail in turn while they fit the budget, up to the first that does not.

    The turns are fixed by a row's places from either end, so the choice is a running sum in their order."""
    up, down = Window.partitionBy(by).orderBy(order), Window.partitionBy(by).orderBy(F.desc(order))
    turn = F.least(2 * F.row_number().over(up) - 1, 2 * F.row_number().over(down))
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_turn", turn).withColumn("_spent", spent).where(F.col("_spent") <= budget).drop("_turn", "_spent")
