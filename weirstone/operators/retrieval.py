"""Retrieval over evidence: tiers, budgets, neighbourhood units, signals, classes and rendered reads."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What words and tools say about an event's operation; fixed values. The first that holds wins for shell lines.
OPERATIONS = {
    "publish": r"(?i)\b(?:commit(?:ted)?|push(?:ed)?|publish(?:ed)?|deploy(?:ed)?|open(?:ed)?\s+(?:a\s+)?pr)\b|(?:提交|推送|发布|部署)",
    "verify": r"(?i)\b(?:test(?:ed|ing)?|pytest|unittest|verify|verified|validat(?:e|ed|ion)|check(?:ed|ing)?|lint(?:ed|ing)?|mypy|ruff|preflight|build)\b|(?:测试|验证|检查|校验)",
    "modify": r"(?i)\b(?:add(?:ed|ing)?|chang(?:e|ed|ing)|edit(?:ed|ing)?|fix(?:ed|ing)?|implement(?:ed|ing)?|remov(?:e|ed|ing)|delet(?:e|ed|ing)|replac(?:e|ed|ing)|rewrit(?:e|ten|ing)|writ(?:e|ten|ing)|creat(?:e|ed|ing)|set)\b"
    r"|(?:修改|新增|添加|删除|替换|实现|写入|创建|设置)",
    "inspect": r"(?i)\b(?:read|review(?:ed|ing)?|inspect(?:ed|ing)?|search(?:ed|ing)?|find|found|look(?:ed|ing)?|investigat(?:e|ed|ing)|compar(?:e|ed|ing)?)\b|(?:读取|查看|审查|搜索|查找|调查|比较)",
}
TOOLS = {"inspect": ("read", "grep", "glob", "search", "webfetch", "websearch"), "modify": ("edit", "write", "create", "delete", "notebookedit")}
#: Beginnings of lines that guard others, and files that mark a documentation site; fixed values.
TRIGGER = r"^\s*(?:if\b|elif\b|else\s*:|for\b|async\s+for\b|while\b|try\s*:|except\*?|finally\s*:|with\b|async\s+with\b|match\b|case\b)"
SITE_FILES = ("docusaurus.config.js", "docusaurus.config.ts")


def operations(text: Column) -> Column:
    """The operations that a text speaks of, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), n) for n, p in sorted(OPERATIONS.items())]), lambda x: x.isNotNull())


def tool_operation(tool: Column) -> Column:
    name = F.regexp_replace(F.lower(F.coalesce(tool, F.lit(""))), "[^a-z]", "")
    out = None
    for op, tools in TOOLS.items():
        hit = name.rlike("(?:" + "|".join(tools) + ")$")
        out = F.when(hit, op) if out is None else out.when(hit, op)
    return out.otherwise("execute")


def objects(text: Column) -> Column:
    """The distinct paths, dotted names and back-quoted names of a text in lower case, with the last part of each path."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"`([^`\n]{2,120})`|((?:[\w.-]+/)+[\w.-]+|\b[a-z_]\w*_\w+\b)"), F.lit(0))
    plain = F.transform(found, lambda x: F.replace(x, F.lit("`"), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(plain, F.transform(F.filter(plain, lambda x: x.contains("/")), lambda x: F.element_at(F.split(x, "/"), -1)))))


def signal_score(lo: Column, ro: Column, lp: Column, rp: Column, lt: Column, rt: Column) -> Column:
    """100 a shared object, 10 a shared operation, and up to 5 shared terms."""
    n = lambda a, b: F.size(F.array_intersect(a, b))
    return n(lo, ro) * 100 + n(lp, rp) * 10 + F.least(n(lt, rt), F.lit(5))


def is_trigger(line: Column) -> Column:
    return F.coalesce(line.rlike(TRIGGER), F.lit(False))


#: How prompts begin that no person wrote; a fixed value.
SYSTEM_PROMPT = (
    r"(?is)^\s*(?:<(?:task-notification|teammate-message|system-reminder|tool-notification|command-message|command-name|command-args)\b|(?:\[Request interrupted by user for tool use\]|Tool loaded\.)\s*$"
    r"|Base directory for this skill:\s*|This session is being continued from a previous conversation that ran out of context\.)"
)


def is_system_prompt(text: Column) -> Column:
    return F.coalesce(text.rlike(SYSTEM_PROMPT), F.lit(False))


def screen(gold: DataFrame, judged: DataFrame, keys: list[str], score: str) -> DataFrame:
    """full, partial, unmatched (a score of 0) or unknown (no judgment) for every gold row."""
    j = gold.join(judged.groupBy(*keys).agg(F.max(score).alias("_s")), keys, "left")
    out = F.when(F.col("_s").isNull(), "unknown").when(F.col("_s") >= 1, "full").when(F.col("_s") > 0, "partial").otherwise("unmatched")
    return j.withColumn("outcome", out).drop("_s")


def matched_events(requirements: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """Requirement-event pairs of a group that share an object, unless both name paths and none in common, or the
    requirement names operations and a tool call does another one. Columns of both: objects, paths, operations."""
    r, e = requirements.alias("r"), events.alias("e")
    some = lambda a, b: F.arrays_overlap(F.col(a), F.col(b))
    paths = (F.size("r.paths") == 0) | (F.size("e.paths") == 0) | some("r.paths", "e.paths")
    ops = (F.size("r.operations") == 0) | (F.col("e.kind") != "tool_call") | some("r.operations", "e.operations")
    hit = r.join(e, F.col(f"r.{by}") == F.col(f"e.{by}")).where(some("r.objects", "e.objects") & paths & ops)
    return hit.select(F.col(f"r.{by}").alias(by), "requirement_id", "event_id")


def category_examples(df: DataFrame, by: list[str], category: str, example: str) -> DataFrame:
    """Rows of each category with their least example."""
    return df.groupBy(*by, category).agg(F.count("*").alias("n"), F.min(example).alias("example"))


def relations_by_node(edges: DataFrame) -> DataFrame:
    """(node, other, relation, side): every edge at both its ends, once. edges: source, target, relation."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "relation", F.lit("out").alias("side"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "relation", F.lit("in").alias("side"))).distinct()


def scope_view(assigned: DataFrame, by: str, task: str, order: str, current: int | None = None) -> DataFrame:
    """Each input's tasks as ordered event lists, marked current (the last task, or a given one) or history."""
    last = F.max(task).over(Window.partitionBy(by)) if current is None else F.lit(current)
    x = assigned.withColumn("_cur", last)
    return x.groupBy(by, task).agg(F.sort_array(F.collect_list(order)).alias("events"), F.when(F.first("_cur") == F.col(task), "current").otherwise("history").alias("scope"))


def unique_best(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """The best row of each group if it is the only one of its score and above 0."""
    w = Window.partitionBy(*by)
    top = df.where(F.col(score) > 0).withColumn("_r", F.rank().over(w.orderBy(F.desc(score)))).where("_r = 1")
    return top.withColumn("_c", F.count("*").over(w)).where("_c = 1").drop("_r", "_c")


def nearest(points: DataFrame, buckets: DataFrame, on: list[str], at: str, center: str, key: str, name: str) -> DataFrame:
    """The bucket of the nearest center for each point in its group, ties to the lower center, then to the least name.

    One pass in order finds the last center before and the first after each point, so no point meets all buckets."""
    one = buckets.groupBy(*on, center).agg(F.min(name).alias(name))
    b = one.select(*on, F.col(center).alias("_at"), F.lit(None).cast(dict(points.dtypes)[key]).alias(key), F.struct(F.col(center).alias("c"), F.col(name).alias("n")).alias("_b"))
    p = points.select(*on, F.col(at).alias("_at"), key, F.lit(None).cast(dict(b.dtypes)["_b"]).alias("_b"))
    w = Window.partitionBy(*on).orderBy("_at")
    x = p.withColumn("_p", F.lit(True)).unionByName(b.withColumn("_p", F.lit(False)))
    x = x.withColumns({"_l": F.max("_b").over(w.rangeBetween(Window.unboundedPreceding, 0)), "_r": F.min("_b").over(w.rangeBetween(0, Window.unboundedFollowing))})
    left = F.col("_r").isNull() | (F.col("_at") - F.col("_l.c") <= F.col("_r.c") - F.col("_at"))
    best = F.when(left & F.col("_l").isNotNull(), F.col("_l.n")).otherwise(F.col("_r.n"))
    return x.where("_p and (_l is not null or _r is not null)").select(*on, key, best.alias(name))


def without_sites(files: DataFrame, by: list[str], path: str) -> DataFrame:
    """Files outside documentation sites: folders that hold one of the sites' configuration files."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    roots = files.where(F.lower(F.element_at(F.split(path, "/"), -1)).isin(*SITE_FILES) & (parent != "")).select(*by, parent.alias("_root")).distinct()
    steps = F.expr(f"transform(sequence(1, greatest(size(split({path}, '/')) - 1, 1)), i -> array_join(slice(split({path}, '/'), 1, i), '/'))")
    inside = files.select(*by, path, F.explode(steps).alias("_root")).join(roots, [*by, "_root"]).select(*by, path).distinct()
    return files.join(inside, [*by, path], "left_anti")


def evidence_class(path: Column) -> Column:
    """fixture, test, build_metadata, documentation, configuration or implementation by path; null for the rest."""
    low = F.lower(path)
    name, suffix = F.element_at(F.split(low, "/"), -1), F.regexp_extract(low, r"(\.[^./]+)$", 1)
    known = suffix.isin(T.SOURCE + T.CONFIG + T.DOCUMENT)
    out = F.when(low.rlike(r"(^|/)(fixtures?|testdata|test_data|__fixtures__|snapshots?)/"), F.when(known, "fixture"))
    out = out.when(low.rlike(r"(^|/)(tests?|__tests__|specs?|testing)/") | name.rlike(T.TEST_NAME), F.when(known, "test"))
    out = out.when(name.isin("pyproject.toml", "setup.py", "setup.cfg", "package.json", "cargo.toml", "go.mod", "pom.xml", "makefile", "dockerfile", "cmakelists.txt", "build.gradle"), "build_metadata")
    out = out.when(suffix.isin(T.DOCUMENT) | low.rlike(r"(^|/)docs?/"), "documentation").when(suffix.isin(T.CONFIG), "configuration")
    return out.when(suffix.isin(T.SOURCE), "implementation")


def quote_references(df: DataFrame, by: str, order: str, task: str, kind: str, text: str, least: int = 20) -> DataFrame:
    """Prompts that quote an earlier response: the quote's only task and its last place. Quotes of one word and
    quotes found in the responses of several tasks give no edge. Within one session, which is bounded."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    quotes = F.regexp_extract_all(text, F.lit(f'"([^"\\n]{{{least},}})"|“([^”\\n]{{{least},}})”'), F.lit(0))
    p = df.where(F.col(kind) == "user_prompt").select(by, F.col(order).alias("used_at"), F.col(task).alias("task"), F.explode(F.transform(quotes, lambda q: norm(F.substring(q, 2, 100000)))).alias("quote"))
    p = p.withColumn("quote", F.regexp_replace("quote", r"[\"”]$", "")).where(F.col("quote").rlike(r"\s|[㐀-鿿]"))
    r = df.where(F.col(kind) == "assistant_response").select(by, F.col(order).alias("made_at"), F.col(task).alias("owner"), norm(F.col(text)).alias("_t"))
    hit = p.join(r, by).where((F.col("made_at") < F.col("used_at")) & F.contains("_t", "quote"))
    one = hit.groupBy(by, "used_at", "task", "quote").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"), F.max("made_at").alias("made_at"))
    return one.where("n = 1 and owner <> task").select(by, "used_at", "task", "owner", "made_at")


def state_edges(writes: DataFrame, reads: DataFrame, on: list[str], symbol: str) -> DataFrame:
    """Edges from every writer of a state to every other reader of it, first aggregated to one row a (state, symbol)."""
    w = writes.select(*on, F.col(symbol).alias("source")).distinct()
    r = reads.select(*on, F.col(symbol).alias("target")).distinct()
    return w.join(r, on).where("source <> target")


def edge_behaviors(edges: DataFrame, behaviors: DataFrame, edge: str, behavior: str, evidence: str) -> DataFrame:
    """The behaviours that each edge shares evidence with, in order."""
    a, b = edges.select(edge, F.explode(evidence).alias("_e")), behaviors.select(behavior, F.explode(evidence).alias("_e"))
    return a.join(b, "_e").groupBy(edge).agg(F.array_sort(F.collect_set(behavior)).alias("behaviors"))


def ego(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Each node's one-hop unit: what it calls and what calls it, in order. links: source, target."""
    out = links.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("out_nodes"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("in_nodes"))
    empty = F.array().cast("array<string>")
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("out_nodes", empty).alias("out_nodes"), F.coalesce("in_nodes", empty).alias("in_nodes"))


def sections_in_turn(df: DataFrame, by: str, section: str, item: str, order: str) -> DataFrame:
    """Items taken from the sections of each group in turn, each item once, at its first turn. A group is one document."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        queues = {k: list(v.sort_values(order)[item]) for k, v in g.groupby(section, sort=True)}
        seen, out = set(), []
        while any(queues.values()):
            for k in queues:
                while queues[k]:
                    x = queues[k].pop(0)
                    if x not in seen:
                        seen.add(x)
                        out.append((g[by].iloc[0], x, k, len(out) + 1))
                        break
        return pd.DataFrame(out, columns=[by, item, section, "place"])

    kinds = dict(df.dtypes)
    return df.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {item} {kinds[item]}, {section} {kinds[section]}, place bigint")


def packed_reads(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Units of each request in order with their state: shown while they fit, oversize if the first alone is above the
    budget (it is shown by itself), deferred after the first that does not fit."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumns({"_s": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(w)})
    state = F.when((F.col("_i") == 1) & (F.col(cost) > budget), "oversize").when(F.col("_s") <= budget, "shown").otherwise("deferred")
    return x.withColumn("state", state).drop("_s", "_i")


def group_means(df: DataFrame, by: list[str], score: str, done: str) -> DataFrame:
    """Mean over all (failures count 0) and over completed rows, and the completion rate."""
    all_ = F.avg(F.when(F.col(done), F.coalesce(F.col(score), F.lit(0.0))).otherwise(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(all_, 6).alias("mean_all"), F.round(F.avg(F.when(F.col(done), F.col(score))), 6).alias("mean_completed"), F.round(F.avg(F.col(done).cast("double")), 6).alias("completion_rate"))


def tiers(passed: Column, total: Column, least: int) -> Column:
    """1 for all checks, one half for at least ``least``, else 0."""
    return F.when((total > 0) & (passed == total), 1.0).when(passed >= least, 0.5).otherwise(0.0)


def windows_of_lines(df: DataFrame, key: str, lines: str, size: int, overlap: int) -> DataFrame:
    """Overlapping runs of lines: (key, window_no, line_start, line_end)."""
    step = max(1, size - overlap)
    n = F.greatest(F.lit(1), F.ceil((F.col(lines) - overlap) / step)).cast("int")
    out = df.select(key, lines, F.posexplode(F.sequence(F.lit(0), n - 1)).alias("_p", "_k"))
    return out.select(key, (F.col("_k") + 1).alias("window_no"), (F.col("_k") * step + 1).alias("line_start"), F.least(F.col("_k") * step + size, F.col(lines)).alias("line_end"))


def cited_lines(citations: DataFrame, artifacts: DataFrame, on: list[str], most: int = 160) -> DataFrame:
    """The cited lines of stored texts; state is resolved, too_long, or missing (no such file or lines)."""
    j = citations.join(artifacts, on, "left").withColumn("_l", F.split("content", "\n", -1))
    ok = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_end") <= F.size("_l"))
    state = F.when(F.col("content").isNull() | ~ok, "missing").when(F.col("line_end") - F.col("line_start") + 1 > most, "too_long").otherwise("resolved")
    text = F.array_join(F.slice("_l", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    return j.withColumn("state", F.coalesce(state, F.lit("missing"))).withColumn("excerpt", F.when(F.col("state") == "resolved", text)).drop("_l", "content")


def resolve_quotes(quotes: DataFrame, texts: DataFrame, on: list[str], quote: str, text: str) -> DataFrame:
    """Where a quote stands in its text (0-based): unique, ambiguous or absent. Line ends are compared as newlines."""
    flat = lambda c: F.regexp_replace(c, "\r\n", "\n")
    j = quotes.join(texts, on, "left").withColumns({"_q": flat(F.col(quote)), "_t": flat(F.coalesce(F.col(text), F.lit("")))})
    first = F.expr("locate(_q, _t)")
    second = F.expr("locate(_q, _t, locate(_q, _t) + 1)")
    state = F.when((F.length("_q") == 0) | (first == 0), "absent").when(second > 0, "ambiguous").otherwise("unique")
    return j.withColumn("state", state).withColumn("char_start", F.when(F.col("state") == "unique", first - 1)).drop("_q", "_t", text)


def is_subsequence(short: list, long: list) -> bool:
    rest = iter(long)
    return all(x in rest for x in short)


def identity(parts: list[str]) -> str:
    """A change detector of an ordered list of texts: CRC-32 over each text after its length in eight bytes."""
    c = 0
    for p in parts:
        raw = p.encode()
        c = zlib.crc32(raw, zlib.crc32(len(raw).to_bytes(8, "big"), c))
    return f"{c:08x}"


def identities(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The identity of each group's texts in order; a group is one request or bundle."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [g[by].iloc[0]], "checksum": [identity([t or "" for t in g.sort_values(order)[text]])], "parts": [len(g)]})

    return df.select(by, order, text).groupBy(by).applyInPandas(run, f"{by} string, checksum string, parts bigint")


def reference_id(text: Column) -> Column:
    """A tool call's name as an id: other characters than letters, digits and ._- become _, trimmed, at most 120 long."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), 1, 120)


def reuse(new: DataFrame, old: DataFrame, content: str) -> DataFrame:
    """Files of a new state with whether a fragment of the same content is there already; the others have to be built."""
    known = old.select(F.sha2(F.coalesce(content, F.lit("")), 256).alias("_h")).distinct().withColumn("_k", F.lit(True))
    return new.withColumn("_h", F.sha2(F.coalesce(content, F.lit("")), 256)).join(known, "_h", "left").withColumn("reused", F.col("_k").isNotNull()).drop("_h", "_k")
