"""Queries of retrieval, signals and rendered reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import nested as N
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import slicing as X
from ..session import table
from .etl import events as trace

_TE = "(SELECT DISTINCT event_pk, input_id, event_type, turn_number, input_order, tool_name, content FROM trace_events)"


def event_operations(spark, d):
    e = trace(spark, d, "event_pk", "event_type", "tool_name", "content")
    op = F.when(F.col("event_type") == "tool_exchange", V.tool_operation(F.col("tool_name"))).otherwise(F.array_join(V.operations(F.col("content")), ","))
    return e.select("event_type", op.alias("operation")).groupBy("event_type", "operation").agg(F.count("*").alias("events"))


def nearest_prompt(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "event_type", "input_order")
    b = e.where("event_type = 'user_prompt'").select("input_id", F.col("input_order").alias("center"), F.col("event_pk").alias("prompt_pk"))
    return V.nearest(e.where("event_type = 'tool_exchange'"), b, ["input_id"], "input_order", "center", "event_pk", "prompt_pk").select("event_pk", "prompt_pk")


def best_matching_prompt(spark, d):
    """For each response the prompt of its input whose signal it matches best, if one does alone."""
    e = trace(spark, d, "event_pk", "input_id", "event_type", "content").where("content is not null")
    s = e.select("event_pk", "input_id", "event_type", V.objects(F.col("content")).alias("o"), V.operations(F.col("content")).alias("p"), T.words(F.col("content")).alias("t"))
    a = s.where("event_type = 'assistant_response'").toDF("event_pk", "input_id", "k", "lo", "lp", "lt").drop("k")
    b = s.where("event_type = 'user_prompt'").toDF("prompt_pk", "input_id", "k", "ro", "rp", "rt").drop("k")
    j = a.join(b, "input_id").withColumn("score", V.signal_score(*map(F.col, ("lo", "ro", "lp", "rp", "lt", "rt"))))
    return V.unique_best(j, ["event_pk"], "score").select("event_pk", "prompt_pk", F.col("score").cast("bigint").alias("score"))


def evidence_classes(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "path")
    return V.without_sites(a, ["input_id"], "path").groupBy(V.evidence_class(F.col("path")).alias("evidence_class")).agg(F.count("*").alias("files"))


def quote_references(spark, d):
    return V.quote_references(trace(spark, d), "input_id", "input_order", "turn_number", "event_type", "content")


def packed_reads(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "content").select("event_pk", "input_id", "input_order", T.token_estimate(F.col("content")).alias("tokens"))
    return V.packed_reads(e, ["input_id"], ["input_order", "event_pk"], "tokens", 3072).groupBy("input_id", "state").agg(F.count("*").alias("units"), F.sum("tokens").alias("tokens"))


def group_means(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("done"))
    return V.group_means(o, ["o_orderpriority"], "score", "done")


def check_tiers(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("ok"), F.count("*").alias("n"))
    return li.groupBy(V.tiers(F.col("ok"), F.col("n"), 2).alias("score")).agg(F.count("*").alias("orders"))


def overlapping_windows(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "content").where("content is not null").select("artifact_id", F.size(F.split("content", "\n", -1)).alias("n"))
    return V.windows_of_lines(a, "artifact_id", "n", 80, 20).select("artifact_id", *[F.col(c).cast("bigint").alias(c) for c in ("window_no", "line_start", "line_end")])


def cited_lines(spark, d):
    r = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets'").select("gold_id", "path", "line_start", "line_end").distinct()
    c = r.join(R.once(table(spark, d, "gold_conditions"), "gold_id", "input_id"), "gold_id")
    a = R.once(table(spark, d, "repo_artifacts"), "input_id", "path", "content")
    return V.cited_lines(c, a, ["input_id", "path"]).groupBy("state").agg(F.count("*").alias("citations"), F.sum(F.length("excerpt")).alias("chars"))


def bundle_identity(spark, d):
    return V.identities(trace(spark, d, "input_id", "input_order", "content"), "input_id", "input_order", "content")


def call_units(spark, d):
    a = X.anchors(table(spark, d, "repo_artifacts")).where("external").select(F.concat_ws(":", "artifact_id", "symbol").alias("source"), F.col("kind").alias("target")).distinct()
    return V.ego(a.select(F.col("source").alias("node")), a).select("node", F.array_join("out_nodes", ",").alias("out_nodes"))


def section_turns(spark, d):
    r = N.flat(table(spark, d, "gold_conditions"), "range").where("path is not null").select("gold_id", F.concat_ws(":", "field", "evidence_no").alias("section"), "path", F.col("pre").alias("o"))
    return V.sections_in_turn(r, "gold_id", "section", "path", "o")


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def oracle_sql():
    tok = "(coalesce(strlen(content), 0) + 2) // 3"
    found = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in sorted(V.OPERATIONS.items()))
    bare = "regexp_replace(lower(coalesce(tool_name, '')), '[^a-z]', '', 'g')"
    tool = f"CASE WHEN {bare} = '' THEN 'execute' " + " ".join(f"WHEN regexp_matches({bare}, '(?:{'|'.join(t)})$') THEN '{n}'" for n, t in V.TOOLS.items()) + " ELSE 'execute' END"
    some = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    low, name, suffix = "lower(path)", "list_last(string_split(lower(path), '/'))", r"regexp_extract(lower(path), '(\.[^./]+)$', 1)"
    known = f"list_contains({some(T.SOURCE + T.CONFIG + T.DOCUMENT)}, {suffix})"
    from .analysis import _words_sql

    ops = f"list_filter([{found}], lambda x: x IS NOT NULL)"
    marks = r"""list_transform(regexp_extract_all(lower(content), '`[^`\n]{2,120}`|(?:[\w.-]+/)+[\w.-]+|\b[a-z_]\w*_\w+\b'), lambda x: replace(x, '`', ''))"""
    return {
        "best_matching_prompt": f"""WITH s AS (SELECT event_pk, input_id, event_type, {_words_sql("content")} AS t, {ops} AS p, {marks} AS o FROM {_TE} WHERE content IS NOT NULL AND event_type IN ('user_prompt', 'assistant_response')),
            f AS (SELECT * REPLACE (list_concat(o, list_transform(list_filter(o, lambda x: contains(x, '/')), lambda x: list_last(string_split(x, '/')))) AS o) FROM s),
            j AS (SELECT a.event_pk, b.event_pk AS prompt_pk, 100 * len(list_intersect(a.o, b.o)) + 10 * len(list_intersect(a.p, b.p)) + least(len(list_intersect(a.t, b.t)), 5) AS score
                FROM f a JOIN f b ON a.input_id = b.input_id AND a.event_type = 'assistant_response' AND b.event_type = 'user_prompt')
            SELECT event_pk, max(prompt_pk) AS prompt_pk, max(score)::BIGINT AS score FROM (SELECT *, rank() OVER (PARTITION BY event_pk ORDER BY score DESC) AS r FROM j WHERE score > 0) WHERE r = 1 GROUP BY event_pk HAVING count(*) = 1""",
        "event_operations": f"""SELECT event_type, CASE WHEN event_type = 'tool_exchange' THEN {tool} ELSE coalesce(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ','), '') END AS operation, count(*) AS events
            FROM {_TE} GROUP BY 1, 2""",
        "evidence_classes": rf"""WITH a AS (SELECT DISTINCT artifact_id, input_id, path FROM repo_artifacts), r AS (SELECT DISTINCT input_id, regexp_extract(path, '^(.*)/[^/]+$', 1) AS root FROM a WHERE list_contains({some(V.SITE_FILES)}, {name})),
            k AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.input_id = a.input_id AND root <> '' AND starts_with(a.path, root || '/')))
            SELECT CASE WHEN regexp_matches({low}, '(^|/)(fixtures?|testdata|test_data|__fixtures__|snapshots?)/') THEN CASE WHEN {known} THEN 'fixture' END
                WHEN regexp_matches({low}, '(^|/)(tests?|__tests__|specs?|testing)/') OR regexp_matches({name}, '{T.TEST_NAME}') THEN CASE WHEN {known} THEN 'test' END
                WHEN {name} IN ('pyproject.toml', 'setup.py', 'setup.cfg', 'package.json', 'cargo.toml', 'go.mod', 'pom.xml', 'makefile', 'dockerfile', 'cmakelists.txt', 'build.gradle') THEN 'build_metadata'
                WHEN list_contains({some(T.DOCUMENT)}, {suffix}) OR regexp_matches({low}, '(^|/)docs?/') THEN 'documentation' WHEN list_contains({some(T.CONFIG)}, {suffix}) THEN 'configuration'
                WHEN list_contains({some(T.SOURCE)}, {suffix}) THEN 'implementation' END AS evidence_class, count(*) AS files FROM k GROUP BY 1""",
        "nearest_prompt": f"""SELECT event_pk, prompt_pk FROM (SELECT e.event_pk, p.event_pk AS prompt_pk, row_number() OVER (PARTITION BY e.event_pk ORDER BY abs(e.input_order - p.input_order), p.input_order) AS r
            FROM {_TE} e JOIN {_TE} p ON p.input_id = e.input_id AND p.event_type = 'user_prompt' WHERE e.event_type = 'tool_exchange') WHERE r = 1""",
        "packed_reads": f"""WITH x AS (SELECT input_id, tokens, sum(tokens) OVER w AS s, row_number() OVER w AS i FROM (SELECT *, {tok} AS tokens FROM {_TE}) WINDOW w AS (PARTITION BY input_id ORDER BY input_order, event_pk ROWS UNBOUNDED PRECEDING))
            SELECT input_id, CASE WHEN i = 1 AND tokens > 3072 THEN 'oversize' WHEN s <= 3072 THEN 'shown' ELSE 'deferred' END AS state, count(*) AS units, CAST(sum(tokens) AS BIGINT) AS tokens FROM x GROUP BY 1, 2""",
        "group_means": """SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 6) AS mean_all, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS mean_completed,
            round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS completion_rate FROM orders GROUP BY 1""",
        "check_tiers": """SELECT CASE WHEN ok = n THEN 1.0::DOUBLE WHEN ok >= 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, count(*) AS orders FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS ok, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1""",
        "overlapping_windows": """WITH n AS (SELECT DISTINCT artifact_id, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n FROM repo_artifacts WHERE content IS NOT NULL),
            k AS (SELECT artifact_id, n, unnest(range(greatest(1, (n - 20 + 59) // 60))) AS k FROM n) SELECT artifact_id, k + 1 AS window_no, k * 60 + 1 AS line_start, least(k * 60 + 80, n) AS line_end FROM k""",
        "cited_lines": """WITH g AS (SELECT DISTINCT gold_id, input_id, location_targets FROM gold_conditions), r AS (SELECT DISTINCT gold_id, input_id, t.path AS path, t.start_line AS a, coalesce(t.end_line, t.start_line) AS b
            FROM (SELECT gold_id, input_id, unnest(flatten(list_filter(location_targets, lambda x: x IS NOT NULL))) AS t FROM g) WHERE t.start_line IS NOT NULL), f AS (SELECT DISTINCT input_id, path, content FROM repo_artifacts),
            j AS (SELECT r.*, f.content, string_split(f.content, chr(10)) AS l FROM r LEFT JOIN f ON f.input_id = r.input_id AND f.path = r.path),
            s AS (SELECT *, CASE WHEN content IS NULL OR a < 1 OR b < a OR b > len(l) THEN 'missing' WHEN b - a + 1 > 160 THEN 'too_long' ELSE 'resolved' END AS state FROM j)
            SELECT state, count(*) AS citations, CAST(sum(CASE WHEN state = 'resolved' THEN length(array_to_string(l[a:b], chr(10))) END) AS BIGINT) AS chars FROM s GROUP BY state""",
    }
