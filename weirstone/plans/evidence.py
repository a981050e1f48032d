"""Queries of evidence units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as V
from ..operators import nested as N
from ..operators import relational as R
from ..session import table
from .etl import events as trace

_TE = "(SELECT DISTINCT event_pk, input_id, session_id, event_type, turn_number, input_order, evidence_id, tool_name, content FROM trace_events)"


def paired_calls(spark, d):
    """Prompts as calls and responses as their results, by session and turn."""
    e = trace(spark, d, "event_pk", "session_id", "event_type", "turn_number", "input_order").where("event_type in ('user_prompt', 'assistant_response')")
    x = e.select("session_id", "event_pk", "input_order", F.col("turn_number").cast("string").alias("call_id"), F.when(F.col("event_type") == "user_prompt", "use").otherwise("result").alias("kind"))
    return V.pair_calls(x, ["session_id"], "call_id", "kind", "input_order", "event_pk").select("event_pk", "kind", "outcome", "other")


def contiguous_lines(spark, d):
    return V.contiguous(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], F.col("l_linenumber").cast("bigint"))


def contiguous_conditions(spark, d):
    g = table(spark, d, "gold_conditions").select("input_id", "condition_id")
    return V.contiguous(g, ["input_id"], F.try_to_number(F.regexp_extract("condition_id", r"^kc_(\d+)$", 1), F.lit("999999")).cast("bigint"))


def _ranges(spark, d):
    r = N.flat(table(spark, d, "gold_conditions"), "range").where("path is not null and line_start is not null")
    return r.select("gold_id", "field", "path", "line_start", F.coalesce("line_end", "line_start").alias("line_end")).where("line_end >= line_start").distinct()


def line_hits(spark, d):
    """The lines of the mappings against those of the targets, by condition and path."""
    r = _ranges(spark, d)
    return V.line_hits(r.where("field <> 'location_targets'").drop("field").distinct(), r.where("field = 'location_targets'").drop("field"), ["gold_id", "path"], "line_start", "line_end")


def target_line_hits(spark, d):
    """Line items as ranges of days from their shipping on: returned ones against the others, by order."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    li = table(spark, d, "lineitem").select("l_orderkey", day.alias("a"), (day + F.col("l_linenumber")).alias("b"), "l_returnflag").distinct()
    return V.line_hits(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), ["l_orderkey"], "a", "b")


def call_usage(spark, d):
    e = table(spark, d, "trace_events").select("event_type", "event_pk", "ingested_at", "content")
    return V.usage(e, ["event_type"], ["event_pk"], "ingested_at", T.token_estimate(F.col("content")))


def incident_edges(spark, d):
    """Customers and parts as nodes, orders as evidence: line items feed, call or return."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    rel = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "feeds").otherwise("contains")
    e = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), rel.alias("relation")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("evidence"))
    e = e.withColumn("via", F.when(F.size("evidence") > 1, "call | result").otherwise("call"))
    late = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    roots = li.join(late, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("root")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("evidence"))
    direct = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return V.incident_edges(e, roots, direct)


def checkpoint_keys(spark, d):
    s = R.once(table(spark, d, "sessions"), "session_id", "checkpoint_ids", "canonical_checkpoint_pk")
    x = R.unnest_json(s, "checkpoint_ids", ["session_id", "canonical_checkpoint_pk"])
    pk = F.split_part(F.col("canonical_checkpoint_pk"), F.lit("#"), F.lit(1))
    return x.select("session_id", F.col("position").cast("bigint").alias("position"), V.derived_key(F.coalesce(pk, F.col("session_id")), F.when(F.col("canonical_checkpoint_pk").isNotNull(), F.col("item")), F.col("position")).alias("derived_key"))


def projected_evidence(spark, d):
    g = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets' and evidence_id is not null").select("gold_id", "evidence_id").distinct()
    return V.exactly_one(g, trace(spark, d, "event_pk", "evidence_id"), "evidence_id", "event_pk").select("gold_id", "evidence_id", "state", "event_pk")


def routed_targets(spark, d):
    g = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets'").select("gold_id", "path", "line_start", "line_end", "symbol", "route")
    one = V.first_route(g, ["gold_id", "path", "line_start", "line_end"], F.coalesce("route", F.lit("~")), ["symbol"])
    return one.groupBy("gold_id").agg(F.count("*").alias("targets"), F.count_distinct("route").alias("routes"))


def target_lines(spark, d):
    g = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets' and path is not null").select("gold_id", "path", "line_start", "line_end").distinct()
    return V.line_counts(g, ["gold_id", "path"], "line_start", "line_end", F.lit(400))


def finished_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return V.only_complete(o, ["o_custkey"], F.col("o_orderstatus") == "P", "o_orderkey")


def folded_paths(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "path")
    return V.folded_rank(a, ["input_id"], "path", "artifact_id").select("artifact_id", "place")


def ranked_files(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "path", F.lower("kind").alias("kind"), F.length("content").alias("chars"))
    x = a.withColumn("chars", F.coalesce("chars", F.lit(0)))
    return V.file_rank(x, ["input_id"], {"source": 0, "runtime_template": 1, "executable": 2, "configuration": 3}, "kind", "chars", "path").select("artifact_id", "place")


def session_messages(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "event_type", "content")
    m = V.messages(e, "input_id", ["input_order", "event_pk"], {"system": "system", "user_prompt": "user", "assistant_response": "assistant", "tool_exchange": "tool"})
    return m.select("input_id", F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["position"].cast("string"), x["role"], x["chars"].cast("string"))), ",").alias("messages"))


def pending_turns(spark, d):
    e = trace(spark, d, "input_id", "turn_number", "event_type")
    return V.pending(e.where("event_type = 'user_prompt'"), e.where("event_type = 'assistant_response'"), ["input_id", "turn_number"], ["input_id"])


def two_stage_scores(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    s = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.max("l_extendedprice"), 2).alias("score"))
    return V.two_stages(o, s, ["o_orderkey"], "score").groupBy("stage").agg(F.count("*").alias("orders"), F.round(F.max("score"), 2).alias("greatest"))


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


_TARGETS = """(SELECT gold_id, t.path AS path, t.start_line::BIGINT AS line_start, coalesce(t.end_line, t.start_line)::BIGINT AS line_end, t.symbol AS symbol, t.route AS route, t.evidence_id AS evidence_id
    FROM (SELECT gold_id, unnest(flatten(list_filter(location_targets, lambda x: x IS NOT NULL))) AS t FROM (SELECT DISTINCT gold_id, location_targets FROM gold_conditions)) WHERE t IS NOT NULL AND t.start_line IS NOT NULL)"""


def oracle_sql():
    tok = "(coalesce(strlen(content), 0) + 2) // 3"
    days = "SELECT DISTINCT l_orderkey, l_shipdate::DATE - DATE '1992-01-01' AS a, l_shipdate::DATE - DATE '1992-01-01' + l_linenumber AS b, l_returnflag = 'R' AS p FROM lineitem"
    return {
        "paired_calls": f"""WITH e AS (SELECT event_pk, session_id, turn_number, input_order, event_type = 'user_prompt' AS u FROM {_TE} WHERE event_type IN ('user_prompt', 'assistant_response')),
            f AS (SELECT session_id, turn_number, min(input_order) AS first_use, arg_min(event_pk, input_order) FILTER (WHERE u) AS use_pk, min(input_order) FILTER (WHERE u) AS use_at FROM e GROUP BY 1, 2),
            x AS (SELECT e.*, f.use_pk, f.use_at, row_number() OVER (PARTITION BY e.session_id, e.turn_number, e.u ORDER BY e.input_order) AS nu FROM e JOIN f USING (session_id, turn_number)),
            r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_number ORDER BY input_order) AS nr FROM x WHERE NOT u AND use_at < input_order),
            one AS (SELECT session_id, turn_number, event_pk AS res_pk FROM r WHERE nr = 1)
            SELECT x.event_pk, CASE WHEN x.u THEN 'use' ELSE 'result' END AS kind,
                CASE WHEN x.u THEN CASE WHEN x.nu > 1 THEN 'duplicate' WHEN one.res_pk IS NULL THEN 'open' ELSE 'paired' END
                     WHEN x.use_at IS NULL OR x.use_at > x.input_order THEN 'orphan' WHEN x.event_pk = one.res_pk THEN 'paired' ELSE 'duplicate' END AS outcome,
                CASE WHEN x.u AND x.nu = 1 THEN one.res_pk WHEN NOT x.u AND x.event_pk = one.res_pk THEN x.use_pk END AS other
            FROM x LEFT JOIN one USING (session_id, turn_number)""",
        "contiguous_lines": """SELECT l_orderkey, count(DISTINCT l_linenumber) AS numbers, min(l_linenumber)::BIGINT AS least, max(l_linenumber)::BIGINT AS greatest, 0::BIGINT AS bad, max(l_linenumber)::BIGINT - count(DISTINCT l_linenumber) AS missing
            FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)""",
        "contiguous_conditions": r"""WITH g AS (SELECT DISTINCT input_id, try_cast(nullif(regexp_extract(condition_id, '^kc_(\d+)$', 1), '') AS BIGINT) AS n FROM gold_conditions)
            SELECT input_id, count(n) AS numbers, min(n) AS least, max(n) AS greatest, count(*) FILTER (WHERE n IS NULL) AS bad, coalesce(max(n) - count(n), 0) AS missing
            FROM g GROUP BY input_id HAVING count(*) FILTER (WHERE n IS NULL) > 0 OR min(n) <> 1 OR max(n) <> count(n)""",
        "target_line_hits": f"""WITH x AS ({days}), g AS (SELECT DISTINCT l_orderkey FROM x WHERE NOT p),
            m AS (SELECT a.l_orderkey, min(greatest(b.a - a.b, a.a - b.b, 0)) AS distance FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.p AND NOT b.p GROUP BY 1)
            SELECT l_orderkey, distance::BIGINT AS distance, coalesce(distance = 0, false) AS hit_at_0, coalesce(distance <= 3, false) AS hit_at_3 FROM g LEFT JOIN m USING (l_orderkey)""",
        "call_usage": f"""SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE n = 1) AS accepted_calls, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(t) FILTER (WHERE n = 1) AS BIGINT) AS accepted_tokens
            FROM (SELECT event_type, {tok} AS t, row_number() OVER (PARTITION BY event_pk ORDER BY ingested_at DESC) AS n FROM trace_events) GROUP BY 1""",
        "incident_edges": """WITH e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'feeds' ELSE 'contains' END AS relation, list(DISTINCT l_orderkey) AS ev FROM lineitem GROUP BY 1, 2, 3),
            r AS (SELECT 's' || l_suppkey AS root, list(DISTINCT l_orderkey) AS own FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1),
            u AS (SELECT root, target AS neighbour, min(relation) AS relation FROM e JOIN r ON source = root LEFT JOIN part ON target = 'p' || p_partkey AND p_size = 1
                  WHERE list_has_any(ev, own) AND (p_partkey IS NOT NULL OR relation = 'calls' OR (relation = 'feeds' AND len(ev) > 1)) GROUP BY 1, 2)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY relation, neighbour) AS rank FROM u) WHERE rank <= 4""",
        "checkpoint_keys": """SELECT session_id, i::BIGINT AS position, coalesce(split_part(pk, '#', 1), session_id) || CASE WHEN pk IS NOT NULL AND trim(item) <> '' THEN '#' || trim(item) ELSE '#NO_GIT_COMMIT:' || i END AS derived_key
            FROM (SELECT session_id, canonical_checkpoint_pk AS pk, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS i FROM (SELECT DISTINCT session_id, canonical_checkpoint_pk, CASE WHEN json_valid(checkpoint_ids) THEN from_json(checkpoint_ids, '["VARCHAR"]') END AS l FROM sessions))""",
        "routed_targets": f"""SELECT gold_id, count(*) AS targets, count(DISTINCT route) AS routes FROM (SELECT *, row_number() OVER (PARTITION BY gold_id, path, line_start, line_end ORDER BY coalesce(route, '~'), symbol NULLS LAST) AS n FROM {_TARGETS}) WHERE n = 1 GROUP BY 1""",
        "projected_evidence": f"""WITH g AS (SELECT DISTINCT gold_id, evidence_id FROM {_TARGETS} WHERE evidence_id IS NOT NULL), v AS (SELECT evidence_id, count(*) AS n, min(event_pk) AS pk FROM (SELECT DISTINCT event_pk, evidence_id FROM trace_events WHERE evidence_id IS NOT NULL) GROUP BY 1)
            SELECT gold_id, evidence_id, CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'several' ELSE 'none' END AS state, CASE WHEN n = 1 THEN pk END AS event_pk FROM g LEFT JOIN v USING (evidence_id)""",
        "target_lines": f"""WITH r AS (SELECT DISTINCT gold_id, path, line_start, line_end FROM {_TARGETS} WHERE path IS NOT NULL),
            b AS (SELECT gold_id, path, bool_or(line_start < 1 OR line_end < line_start OR line_end > 400) AS invalid FROM r GROUP BY 1, 2),
            l AS (SELECT gold_id, path, count(DISTINCT n) AS lines FROM (SELECT gold_id, path, unnest(range(line_start, line_end + 1)) AS n FROM r) GROUP BY 1, 2)
            SELECT gold_id, path, invalid, CASE WHEN invalid THEN 0 ELSE coalesce(lines, 0) END::BIGINT AS lines FROM b LEFT JOIN l USING (gold_id, path)""",
        "finished_orders": """SELECT o_custkey, CASE count(*) FILTER (WHERE o_orderstatus = 'P') WHEN 1 THEN 'one' WHEN 0 THEN 'none' ELSE 'several' END AS state,
            CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 1 THEN min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') END AS o_orderkey FROM orders GROUP BY 1""",
        "folded_paths": "SELECT artifact_id, row_number() OVER (PARTITION BY input_id ORDER BY lower(path), path, artifact_id) AS place FROM (SELECT DISTINCT artifact_id, input_id, path FROM repo_artifacts)",
        "ranked_files": """SELECT artifact_id, row_number() OVER (PARTITION BY input_id ORDER BY CASE k WHEN 'source' THEN 0 WHEN 'runtime_template' THEN 1 WHEN 'executable' THEN 2 WHEN 'configuration' THEN 3 ELSE 4 END, chars DESC, lower(path), path) AS place
            FROM (SELECT DISTINCT artifact_id, input_id, path, lower(kind) AS k, coalesce(length(content), 0) AS chars FROM repo_artifacts)""",
        "session_messages": f"""SELECT input_id, string_agg(concat_ws(':', n, role, chars), ',' ORDER BY n) AS messages FROM (SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY input_order, event_pk) AS n,
            CASE event_type WHEN 'system' THEN 'system' WHEN 'user_prompt' THEN 'user' WHEN 'assistant_response' THEN 'assistant' WHEN 'tool_exchange' THEN 'tool' ELSE 'other' END AS role, coalesce(length(content), 0) AS chars FROM {_TE}) GROUP BY 1""",
        "pending_turns": f"""WITH a AS (SELECT DISTINCT input_id, turn_number FROM {_TE} WHERE event_type = 'user_prompt'), b AS (SELECT DISTINCT input_id, turn_number, 1 AS done FROM {_TE} WHERE event_type = 'assistant_response')
            SELECT input_id, count(*) AS asked, count(done) AS answered, count(*) FILTER (WHERE done IS NULL) AS pending FROM a LEFT JOIN b USING (input_id, turn_number) GROUP BY 1""",
        "two_stage_scores": """WITH s AS (SELECT l_orderkey, max(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
            SELECT CASE WHEN s IS NULL THEN 'first' ELSE 'second' END AS stage, count(*) AS orders, round(max(coalesce(s, o_totalprice)), 2) AS greatest FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY 1""",
    }
