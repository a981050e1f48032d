"""Evidence units: paired calls, numbered ids, line distances, usage, incident edges, gold unions and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_calls(rows: DataFrame, scope: list[str], call: str, kind: str, order: str, key: str) -> DataFrame:
    """One row per call or result: its outcome and, of a paired one, the key of the other.

    rows: kind "use" or "result", a call id (null or blank: none) unique among the uses of a scope, an order. A use is
    paired with the first result of its id that comes after it; outcome: paired, open (a use without a result),
    orphan (a result without a use before it), duplicate (a later result, or a later use of the same id), without_id."""
    known = F.nullif(F.trim(F.col(call)), F.lit(""))
    w = Window.partitionBy(*scope, "_c").orderBy(order, key)
    x = rows.withColumn("_c", known)
    some = x.where(F.col("_c").isNotNull())
    nth = F.sum(F.when(F.col(kind) == "use", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumns({"_uses": nth, "_use": F.first(F.when(F.col(kind) == "use", F.col(key)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    valid = (F.col(kind) == "result") & (F.col("_uses") > 0)
    some = some.withColumn("_r", F.sum(F.when(valid, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.when(valid, F.col(key)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    some = some.withColumn("_first", first)
    use = F.when(F.col("_uses") > 1, "duplicate").when(F.col("_first").isNull(), "open").otherwise("paired")
    result = F.when(F.col("_uses") == 0, "orphan").when(F.col("_r") > 1, "duplicate").otherwise("paired")
    some = some.withColumn("outcome", F.when(F.col(kind) == "use", use).otherwise(result))
    other = F.when(F.col("outcome") == "paired", F.when(F.col(kind) == "use", F.col("_first")).otherwise(F.col("_use")))
    none = x.where(F.col("_c").isNull()).withColumns({"outcome": F.lit("without_id"), "other": F.lit(None).cast(dict(rows.dtypes)[key])})
    return some.withColumn("other", other).select(*rows.columns, "outcome", "other").unionByName(none.select(*rows.columns, "outcome", "other"))


def contiguous(rows: DataFrame, by: list[str], number: Column, start: int = 1) -> DataFrame:
    """Groups whose distinct numbers are not start, start + 1, ...: how many, the least and greatest, and the count of numbers missing between; a null number counts as bad."""
    per = rows.select(*by, number.alias("_n")).distinct().groupBy(*by).agg(F.count("_n").alias("numbers"), F.min("_n").alias("least"), F.max("_n").alias("greatest"), F.count_if(F.col("_n").isNull()).alias("bad"))
    missing = F.coalesce(F.col("greatest") - F.lit(start) + 1 - F.col("numbers"), F.lit(0))
    return per.withColumn("missing", missing.cast("bigint")).where((F.col("bad") > 0) | (F.col("least") != start) | (F.col("missing") != 0))


def line_hits(predicted: DataFrame, gold: DataFrame, by: list[str], start: str, end: str, near: int = 3) -> DataFrame:
    """For each group with gold ranges the least distance between a predicted and a gold line, and whether it is 0 or at most ``near``.

    A range's distance to the other side's is 0 if one that starts no later reaches it, else that from the greatest end before;
    so one pass in the order of the starts serves, without pairs. Groups without predictions have a null distance."""
    both = predicted.select(*by, start, end, F.lit(0).alias("_side")).unionByName(gold.select(*by, start, end, F.lit(1).alias("_side")))
    w = Window.partitionBy(*by).orderBy(start, "_side", end).rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda side: F.max(F.when(F.col("_side") == side, F.col(end))).over(w)
    x = both.withColumn("_before", F.when(F.col("_side") == 0, reach(1)).otherwise(reach(0)))
    per = x.groupBy(*by).agg(F.min(F.when(F.col("_before").isNotNull(), F.greatest(F.col(start) - F.col("_before"), F.lit(0)))).alias("distance"), F.max("_side").alias("_gold"))
    d = F.col("distance")
    return per.where("_gold = 1").select(*by, d.cast("bigint").alias("distance"), F.coalesce(d == 0, F.lit(False)).alias("hit_at_0"), F.coalesce(d <= near, F.lit(False)).alias(f"hit_at_{near}"))


def usage(calls: DataFrame, by: list[str], key: list[str], attempt: str, tokens: Column) -> DataFrame:
    """By group: calls made and accepted (the last attempt of each key), and the tokens of both."""
    w = Window.partitionBy(*key).orderBy(F.col(attempt).desc_nulls_last())
    x = calls.withColumns({"_t": tokens, "_last": F.row_number().over(w) == 1})
    return x.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if("_last").alias("accepted_calls"), F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum(F.when(F.col("_last"), F.col("_t"))), F.lit(0)).cast("bigint").alias("accepted_tokens")
    )


def incident_edges(edges: DataFrame, roots: DataFrame, direct: DataFrame, most: int = 4) -> DataFrame:
    """The first ``most`` useful edges of every root, one for each neighbour: (root, neighbour, relation, rank).

    edges: source, target, relation, evidence (an array), via. roots: root, evidence (an array). An edge is taken if it
    shares evidence with its root and is useful: its neighbour is direct, or it is a call from the root, or it feeds
    the root, or the root feeds it by a result. direct: node. Order: relation, neighbour."""
    out = edges.select(F.col("source").alias("root"), F.col("target").alias("neighbour"), "relation", "evidence", "via", F.lit(True).alias("out"))
    back = edges.where("source <> target").select(F.col("target").alias("root"), F.col("source").alias("neighbour"), "relation", "evidence", "via", F.lit(False).alias("out"))
    some = out.unionByName(back).join(roots.withColumnRenamed("evidence", "_own"), "root").where(F.arrays_overlap("evidence", "_own"))
    some = some.join(direct.select(F.col("node").alias("neighbour")).distinct().withColumn("_direct", F.lit(True)), "neighbour", "left")
    result = F.array_contains(F.split(F.coalesce("via", F.lit("")), r" \| "), "result")
    useful = F.coalesce("_direct", F.lit(False)) | ((F.col("relation") == "calls") & F.col("out")) | ((F.col("relation") == "feeds") & (~F.col("out") | result))
    once = some.where(useful).groupBy("root", "neighbour").agg(F.min("relation").alias("relation"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("relation", "neighbour"))
    return once.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def derived_key(key: Column, commit: Column, position: Column) -> Column:
    """key#commit, or key#NO_GIT_COMMIT:position where there is no commit."""
    known = F.nullif(F.trim(commit), F.lit(""))
    return F.when(known.isNotNull(), F.concat(key, F.lit("#"), known)).otherwise(F.concat(key, F.lit("#NO_GIT_COMMIT:"), position.cast("string")))


def exactly_one(gold: DataFrame, visible: DataFrame, on: str, name: str) -> DataFrame:
    """The gold rows with what their id matches: one (with its ``name``), none or several visible rows."""
    per = visible.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"), F.min(name).alias("_v"))
    out = gold.join(per, on, "left")
    state = F.when(F.col("_n") == 1, "one").when(F.col("_n") > 1, "several").otherwise("none")
    return out.withColumns({"state": state, name: F.when(F.col("_n") == 1, F.col("_v"))}).drop("_n", "_v")


def first_route(targets: DataFrame, identity: list[str], route: Column, order: list[str]) -> DataFrame:
    """One row for each identity: that of the first route, then the first in order."""
    w = Window.partitionBy(*identity).orderBy(route, *[F.col(c).asc_nulls_last() for c in order])
    return targets.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def line_counts(ranges: DataFrame, by: list[str], start: str, end: str, last: Column) -> DataFrame:
    """By group the number of distinct lines of its ranges, and 0 if one range is no range of the file (start < 1, end < start, end > last or null).

    Ranges are merged in order, not expanded to lines."""
    bad = F.coalesce((F.col(start) < 1) | (F.col(end) < F.col(start)) | (F.col(end) > last), F.lit(True))
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.withColumns({"_bad": bad, "_to": F.coalesce(F.max(end).over(w), F.lit(0))})
    fresh = F.greatest(F.col(end) - F.greatest(F.col("_to"), F.col(start) - 1), F.lit(0))
    per = x.groupBy(*by).agg(F.bool_or("_bad").alias("invalid"), F.sum(fresh).alias("_n"))
    return per.select(*by, "invalid", F.when(F.col("invalid"), 0).otherwise(F.col("_n")).cast("bigint").alias("lines"))


def only_complete(attempts: DataFrame, by: list[str], complete: Column, key: str) -> DataFrame:
    """By group the key of its complete attempt, where there is exactly one; the state says one, none or several."""
    per = attempts.groupBy(*by).agg(F.count_if(complete).alias("_n"), F.min(F.when(complete, F.col(key))).alias("_k"))
    state = F.when(F.col("_n") == 1, "one").when(F.col("_n") == 0, "none").otherwise("several")
    return per.select(*by, state.alias("state"), F.when(F.col("_n") == 1, F.col("_k")).alias(key))


def folded_rank(df: DataFrame, by: list[str], text: str, *ties: str) -> DataFrame:
    """Places from 1 in each group by the text in lower case, then as written, then the ties."""
    w = Window.partitionBy(*by).orderBy(F.lower(text), text, *ties)
    return df.withColumn("place", F.row_number().over(w).cast("bigint"))


def file_rank(df: DataFrame, by: list[str], tier: dict[str, int], kind: str, count: str, path: str) -> DataFrame:
    """Places from 1 in each group by the tier of the kind, the larger count, and the path in lower case, then as written."""
    t = F.create_map(*[F.lit(x) for pair in tier.items() for x in pair])
    w = Window.partitionBy(*by).orderBy(F.coalesce(F.try_element_at(t, F.col(kind)), F.lit(len(tier))), F.col(count).desc(), F.lower(path), path)
    return df.withColumn("place", F.row_number().over(w).cast("bigint"))


def messages(events: DataFrame, by: str, order: list[str], roles: dict[str, str]) -> DataFrame:
    """One row an input: its events as messages in order, (position, role, chars), for a session export. An input's rows meet in one row."""
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]), F.col("event_type")), F.lit("other"))
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    one = F.struct(at.cast("bigint").alias("position"), role.alias("role"), F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("chars"))
    return events.select(by, one.alias("m")).groupBy(by).agg(F.sort_array(F.collect_list("m")).alias("messages"))


def pending(asked: DataFrame, answered: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """By group: what was asked, answered and is still pending. Repeated questions and answers count once."""
    a, b = asked.select(*by, *on).distinct(), answered.select(*on).distinct().withColumn("_done", F.lit(1))
    return a.join(b, on, "left").groupBy(*by).agg(F.count("*").alias("asked"), F.count("_done").alias("answered"), F.count_if(F.col("_done").isNull()).alias("pending"))


def two_stages(first: DataFrame, second: DataFrame, on: list[str], score: str) -> DataFrame:
    """The second stage's score where it exists, else the first's, with the stage; keys of the second stage alone are left out."""
    s = second.select(*on, F.col(score).alias("_second"))
    out = first.join(s, on, "left")
    return out.withColumns({score: F.coalesce("_second", F.col(score)), "stage": F.when(F.col("_second").isNotNull(), "second").otherwise("first")}).drop("_second")


def occurrence(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each row's number, from 0, among the rows of its group in order."""
    return df.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def last_of(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows of each group, with their place from the end (1 is the last)."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("from_end", F.row_number().over(w).cast("bigint")).where(F.col("from_end") <= most)


def first_wins(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity in order; nulls in the identity are a value."""
    w = Window.partitionBy(*identity).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh_first(attempts: DataFrame, session: str, tries: str, order: list[str], accepted: Column) -> DataFrame:
    """Places of attempts, fresh ones before retries and else in order, and whether each is its session's accepted one: the first that is accepted."""
    w = Window.partitionBy(session).orderBy(tries, *order)
    x = attempts.withColumns({"place": F.row_number().over(w).cast("bigint"), "_ok": F.coalesce(accepted, F.lit(False))})
    before = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("accepted", F.col("_ok") & (before == 1)).drop("_ok")


def longest_prefix(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """By group the number of leading rows whose costs together stay within the budget, and their sum; 0 where the first does not."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_s", F.sum(cost).over(w))
    x = x.withColumn("_over", F.max(F.when(F.col("_s") > budget, 1).otherwise(0)).over(w))
    fits = F.col("_over") == 0
    return x.groupBy(*by).agg(F.count_if(fits).alias("fitting"), F.coalesce(F.max(F.when(fits, F.col("_s"))), F.lit(0)).cast("bigint").alias("cost"))


def symbol_tier(symbol: Column, query: Column) -> Column:
    """How well a symbol answers a query: 0 equal, 1 equal but for case, 2 its last part is equal, 3 begins with it, 4 holds it; null if it does not. Case counts in 0 only."""
    s, q = F.lower(symbol), F.lower(query)
    last = F.element_at(F.split(s, r"[.\s]"), -1)
    return F.when(symbol == query, 0).when(s == q, 1).when(last == q, 2).when(F.startswith(s, q), 3).when(F.contains(s, q), 4)


def ranked_symbols(symbols: DataFrame, queries: DataFrame, name: str, query: str, most: int) -> DataFrame:
    """The first ``most`` answers to each query of a short list, by tier, length and name. queries: a few rows, broadcast as a list of literals."""
    asked = [r[0] for r in queries.select(query).where(F.col(query).isNotNull()).distinct().orderBy(query).limit(1001).collect()]
    if len(asked) > 1000:
        raise ValueError("more than 1000 queries at once")
    each = symbols.select(name).where(F.col(name).isNotNull()).distinct().withColumn(query, F.explode(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")))
    hit = each.withColumn("tier", symbol_tier(F.col(name), F.col(query))).where("tier is not null")
    w = Window.partitionBy(query).orderBy("tier", F.length(name), name)
    return hit.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def same_task(parts: DataFrame, by: list[str], order: str, keys: str) -> DataFrame:
    """Whether each part shares a stable key with the one before it; parts without keys go with the one before. The first part of a group is no continuation."""
    before = F.lag(keys).over(Window.partitionBy(*by).orderBy(order))
    apart = (F.size(keys) > 0) & (F.size(before) > 0) & ~F.arrays_overlap(F.col(keys), before)
    return parts.withColumn("continues", before.isNotNull() & ~F.coalesce(apart, F.lit(False)))


def uncovered_terms(asked: DataFrame, shown: DataFrame, on: list[str], term: str) -> DataFrame:
    """By group the terms asked for, and how many no shown row of the group has."""
    a = asked.select(*on, term).where(F.col(term).isNotNull()).distinct()
    s = shown.select(*on, term).distinct().withColumn("_hit", F.lit(1))
    return a.join(s, [*on, term], "left").groupBy(*on).agg(F.count("*").alias("terms"), F.count_if(F.col("_hit").isNull()).alias("uncovered"))


def evidence_hit(gold: Column, shown: Column) -> Column:
    """1.0 if any gold evidence is shown, 0.0 if none is, null without gold evidence."""
    return F.when(F.size(gold) > 0, F.arrays_overlap(gold, shown).cast("double"))


def priority(df: DataFrame, by: list[str], implementation: Column, invoked: Column, recency: Column, asked: Column, path: str) -> DataFrame:
    """Places from 1 in each group: implementations first, then what was invoked, the most recent, what a question names, and by path."""
    rank = [F.coalesce(c, F.lit(False)).desc() for c in (implementation, invoked)] + [recency.desc_nulls_last(), F.coalesce(asked, F.lit(False)).desc(), F.lower(path), F.col(path)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*rank)).cast("bigint"))


def slope_interval(df: DataFrame, by: list[str], x: Column, y: Column, z: float = 1.959963984540054) -> DataFrame:
    """Least-squares slope of y on the binary logarithm of x, its standard error and normal interval; null with fewer than three points or one x."""
    p = df.select(*by, F.log2(x).alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    s = p.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"))
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    error = F.when((F.col("n") > 2) & (F.col("_sxx") > 0), F.sqrt(rest / (F.col("n") - 2) / F.col("_sxx")))
    return s.withColumn("error", error).select(*by, "n", "slope", "error", (F.col("slope") - z * F.col("error")).alias("low"), (F.col("slope") + z * F.col("error")).alias("high"))
