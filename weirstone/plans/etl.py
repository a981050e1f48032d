"""Queries of the session ETL and its audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import sequence as S
from ..operators import trace as E
from ..session import table

_EV = "SELECT DISTINCT event_pk, input_id, session_id, repo_id, event_type, turn_number, input_order, content, evidence_id, tool_name FROM trace_events"


def events(spark, d, *columns):
    return R.once(table(spark, d, "trace_events"), *(columns or E.EVENT))


def prompt_windows(spark, d):
    e = events(spark, d, "event_pk", "input_id", "input_order", "event_type")
    w = S.asof_windows(e, ["input_id"], "input_order", F.col("event_type") == "user_prompt", {"n_agent": F.col("event_type").isin("assistant_response", "tool_exchange")})
    rule = R.first_rule([("no_prior_user_prompt", F.col("start_at").isNull()), ("no_observable_agent_event", F.col("n_agent") == 0)], "pass")
    return w.select("event_pk", "input_id", F.col("start_at").cast("bigint").alias("start_at"), "n_agent", rule.alias("rule"))


PROMPT_WINDOWS = f"""
WITH ev AS (SELECT DISTINCT event_pk, input_id, input_order, event_type FROM trace_events),
t AS (SELECT * FROM ev WHERE event_type = 'user_prompt'),
b AS (SELECT t.event_pk, t.input_id, t.input_order, max(p.input_order) AS start_at FROM t LEFT JOIN t p
      ON p.input_id = t.input_id AND p.input_order < t.input_order GROUP BY ALL),
w AS (SELECT b.event_pk, b.input_id, b.start_at, count(e.event_pk) AS n_agent FROM b LEFT JOIN ev e
      ON e.input_id = b.input_id AND e.input_order >= b.start_at AND e.input_order < b.input_order
      AND e.event_type IN ('assistant_response', 'tool_exchange') GROUP BY ALL)
SELECT event_pk, input_id, CAST(start_at AS BIGINT) AS start_at, n_agent,
  CASE WHEN start_at IS NULL THEN 'no_prior_user_prompt' WHEN n_agent = 0 THEN 'no_observable_agent_event' ELSE 'pass' END AS rule FROM w"""


def decision_distribution(spark, d):
    return prompt_windows(spark, d).groupBy("rule").agg(F.count("*").alias("prompts"))


def latest_delivery(spark, d):
    t = table(spark, d, "trace_events").select("event_pk", "event_type", "ingested_at", "input_id")
    kept = R.latest_delivery(t, ["event_pk"], ties=["input_id"])
    a = t.groupBy("event_type").agg(F.count("*").alias("delivered"))
    return a.join(kept.groupBy("event_type").agg(F.count("*").alias("kept")), "event_type")


KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "bundles": ["input_id"], "sessions": ["session_id"], "repositories": ["repo_id"], "repo_artifacts": ["artifact_id"], "trace_events": ["event_pk"], "gold_conditions": ["gold_id"],
}


def duplicate_key_audit(spark, d):
    return R.duplicate_keys({n: (table(spark, d, n), k) for n, k in KEYS.items()})


FOREIGN = {
    "lineitem_orders": ("lineitem", "orders", [("l_orderkey", "o_orderkey")]), "lineitem_part": ("lineitem", "part", [("l_partkey", "p_partkey")]), "orders_customer": ("orders", "customer", [("o_custkey", "c_custkey")]),
    "customer_nation": ("customer", "nation", [("c_nationkey", "n_nationkey")]), "trace_sessions": ("trace_events", "sessions", [("session_id", "session_id")]), "trace_bundles": ("trace_events", "bundles", [("input_id", "input_id")]),
    "artifact_bundles": ("repo_artifacts", "bundles", [("input_id", "input_id")]), "artifact_repositories": ("repo_artifacts", "repositories", [("repo_id", "repo_id")]), "gold_bundles": ("gold_conditions", "bundles", [("input_id", "input_id")]),
    "bundle_repositories": ("bundles", "repositories", [("repo_id", "repo_id")]), "session_repositories": ("sessions", "repositories", [("repo_id", "repo_id")]),
}


def foreign_key_audit(spark, d):
    return R.foreign_keys({n: (table(spark, d, a), table(spark, d, b), on) for n, (a, b, on) in FOREIGN.items()})


def dimension_two_roles(spark, d):
    s = R.once(table(spark, d, "sessions"), "session_id", "repo_id", "canonical_checkpoint_pk")
    r = table(spark, d, "repositories").select("repo_id", "repo_type_domain")
    out = R.two_roles(s, r, "repo_id", {"source": F.col("repo_id"), "canonical": F.split_part("canonical_checkpoint_pk", F.lit("#"), F.lit(1))}, ["repo_type_domain"])
    return out.groupBy("source_repo_type_domain", "canonical_repo_type_domain").agg(F.count("*").alias("sessions"))


def null_safe_mismatch(spark, d):
    s = R.once(table(spark, d, "sessions"), "session_id", "repo_id", "canonical_checkpoint_pk")
    c = F.split_part("canonical_checkpoint_pk", F.lit("#"), F.lit(1))
    return s.withColumn("canonical_repo", c).where(~F.col("repo_id").eqNullSafe(F.col("canonical_repo"))).select("session_id", "repo_id", "canonical_repo")


def semi_exists_flag(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity").where("l_quantity >= 45")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 60 days"))
    return R.exists_flag(o, li, on, "o_orderkey", "early_large").groupBy("o_orderpriority", "early_large").agg(F.count("*").alias("orders"))


def json_unnest_files(spark, d):
    s = R.once(table(spark, d, "sessions"), "session_id", "files_touched")
    return R.unnest_json(s, "files_touched", ["session_id"]).select("session_id", F.col("position").cast("bigint").alias("position"), "item")


def bool_or_rollup_flags(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    g = li.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open"), F.min("l_linenumber").cast("bigint").alias("first_line"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_linestatus") == "F").alias("finished"),
    )
    return g.where("any_returned and any_open")


def conflict_having(spark, d):
    x = table(spark, d, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")
    return R.conflicts(x, "text_md5", "lang", "(none)")


def set_except_both_ways(spark, d):
    a = table(spark, d, "repo_artifacts").select("repo_id").distinct()
    b = table(spark, d, "documents").select("repo_id").distinct()
    return R.both_ways(a, b)


def multiset_difference(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    return R.multiset_difference(e.where("user_id % 2 = 0").select("event_type"), e.where("user_id % 2 = 1").select("event_type"), ["event_type"])


def license_targets(spark, d):
    r = table(spark, d, "repositories")
    lang = F.nullif(F.trim(F.get_json_object("repo_github_metadata", "$.language")), F.lit(""))
    ok = F.try_parse_json("repo_github_metadata").isNotNull()
    return r.select("repo_id", F.nullif(F.lower(F.trim("license_type")), F.lit("")).alias("license"), F.when(ok, lang).alias("language"), ok.alias("metadata_valid"))


def cutoff_leaks(spark, d):
    e = events(spark, d, "event_pk", "input_id", "turn_number")
    b = R.once(table(spark, d, "bundles"), "input_id", "cutoff_turn")
    kept = E.before_cutoff(e, b)
    a = e.join(b.select("input_id"), "input_id").groupBy("input_id").agg(F.count("*").alias("events_all"))
    return a.join(kept.groupBy("input_id").agg(F.count("*").alias("events_visible")), "input_id", "left").select("input_id", "events_all", F.coalesce("events_visible", F.lit(0)).cast("bigint").alias("events_visible"))


def evidence_id_conflicts(spark, d):
    e = events(spark, d, "event_pk", "evidence_id").where("evidence_id is not null")
    return e.groupBy("evidence_id").agg(F.count("*").alias("events_with_id")).where("events_with_id > 1")


def tool_paths(spark, d):
    return E.tool_paths(events(spark, d)).groupBy("tool", "path_key").agg(F.count("*").alias("mentions"), F.count_distinct("path").alias("paths"))


def latest_path_read(spark, d):
    return E.read_again(events(spark, d))


def late_rows(spark, d):
    t = table(spark, d, "trace_events").where("event_ts is not null")
    late = F.unix_micros("ingested_at") - F.unix_micros("event_ts") > 86_400_000_000
    return t.groupBy("event_type").agg(F.count("*").alias("row_count"), F.count_if(late).alias("late_rows"))


def queries():
    skip = {"events", "queries", "oracle_sql", "table"}
    return {k: f for k, f in globals().items() if callable(f) and k not in skip and not k.startswith("_") and k.islower() and getattr(f, "__module__", "") == __name__}


def _keys_sql():
    part = "SELECT '{n}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM {n} GROUP BY {k})"
    return " UNION ALL ".join(part.format(n=n, k=", ".join(k)) for n, k in KEYS.items())


def _foreign_sql():
    part = "SELECT '{n}' AS check_name, count(*) AS orphan_rows, count(DISTINCT c.{x}) AS orphan_keys FROM {a} c WHERE c.{x} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} p WHERE p.{y} = c.{x})"
    return " UNION ALL ".join(part.format(n=n, a=a, b=b, x=on[0][0], y=on[0][1]) for n, (a, b, on) in FOREIGN.items())


def oracle_sql():
    s = "(SELECT DISTINCT session_id, repo_id, canonical_checkpoint_pk, files_touched FROM sessions)"
    keys = ", ".join(f"{{'t': '{t}', 'k': '{k}'}}" for t, ks in E.PATH_KEYS.items() for k in ks)
    paths = rf"""SELECT DISTINCT event_pk, input_id, input_order, tool, key AS path_key, list_aggregate(parts, 'string_agg', '/') AS path FROM
        (SELECT *, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM
        (SELECT event_pk, input_id, input_order, tool, q.k AS key, replace(trim(json_extract_string(j, '$.input.' || q.k)), chr(92), '/') AS p FROM
        (SELECT *, coalesce(tool_name, json_extract_string(j, '$.tool')) AS tool FROM
        (SELECT *, CASE WHEN json_valid(i) THEN i END AS j FROM (SELECT event_pk, input_id, input_order, tool_name, trim(regexp_extract(split_part(content, chr(10) || chr(10) || 'Tool result:', 1), '(?s)^[^\n]*\n(.*)$', 1)) AS i
            FROM ({_EV}) WHERE event_type = 'tool_exchange'))), (SELECT unnest([{keys}]) AS q) WHERE q.t = tool)
        WHERE p IS NOT NULL AND length(p) BETWEEN 1 AND 4096 AND NOT regexp_matches(p, '[\x00\r\n$`*?\[\]{{}}:]') AND p NOT IN ('/dev/null', 'dev/null') AND left(p, 1) NOT IN ('-', '~', '/') AND NOT regexp_matches(p, '(^|/)\.\.(/|$)'))
        WHERE len(parts) > 0"""
    return {
        "tool_paths": f"SELECT tool, path_key, count(*) AS mentions, count(DISTINCT path) AS paths FROM ({paths}) GROUP BY 1, 2",
        "latest_path_read": f"""SELECT input_id, path, event_pk, mentions FROM (SELECT *, row_number() OVER (PARTITION BY input_id, path ORDER BY input_order DESC, event_pk DESC) AS n, count(*) OVER (PARTITION BY input_id, path) AS mentions FROM ({paths})) WHERE n = 1""",
        "prompt_windows": PROMPT_WINDOWS,
        "decision_distribution": f"SELECT rule, count(*) AS prompts FROM ({PROMPT_WINDOWS}) GROUP BY rule",
        "latest_delivery": "SELECT event_type, count(*) AS delivered, count(DISTINCT event_pk) AS kept FROM trace_events GROUP BY event_type",
        "duplicate_key_audit": _keys_sql(),
        "foreign_key_audit": _foreign_sql(),
        "dimension_two_roles": f"""SELECT a.repo_type_domain AS source_repo_type_domain, b.repo_type_domain AS canonical_repo_type_domain, count(*) AS sessions
            FROM {s} s LEFT JOIN repositories a ON a.repo_id = s.repo_id LEFT JOIN repositories b ON b.repo_id = split_part(s.canonical_checkpoint_pk, '#', 1) GROUP BY ALL""",
        "null_safe_mismatch": f"SELECT session_id, repo_id, split_part(canonical_checkpoint_pk, '#', 1) AS canonical_repo FROM {s} s WHERE repo_id IS DISTINCT FROM split_part(canonical_checkpoint_pk, '#', 1)",
        "semi_exists_flag": """SELECT o_orderpriority, early_large, count(*) AS orders FROM (SELECT o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
            AND l_quantity >= 45 AND l_shipdate > o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY) AS early_large FROM orders) GROUP BY ALL""",
        "json_unnest_files": f"""SELECT session_id, CAST(i AS BIGINT) AS position, json_extract_string(files_touched, '$[' || i || ']') AS item FROM
            (SELECT session_id, files_touched, unnest(range(CAST(json_array_length(files_touched) AS BIGINT))) AS i FROM {s} s WHERE json_valid(files_touched) AND json_type(files_touched) = 'ARRAY')""",
        "bool_or_rollup_flags": """SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_linestatus = 'O') AS any_open, CAST(min(l_linenumber) AS BIGINT) AS first_line,
            string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_linestatus = 'F') AS finished
            FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'O')""",
        "conflict_having": """SELECT md5(text) AS text_md5, count(*) AS n_rows, min(coalesce(lang, '(none)')) AS least, max(coalesce(lang, '(none)')) AS greatest FROM documents WHERE text IS NOT NULL
            GROUP BY 1 HAVING min(coalesce(lang, '(none)')) IS DISTINCT FROM max(coalesce(lang, '(none)'))""",
        "set_except_both_ways": """SELECT repo_id, 'left_only' AS side FROM (SELECT repo_id FROM repo_artifacts EXCEPT SELECT repo_id FROM documents)
            UNION ALL SELECT repo_id, 'right_only' AS side FROM (SELECT repo_id FROM documents EXCEPT SELECT repo_id FROM repo_artifacts)""",
        "multiset_difference": """SELECT event_type, CAST(sum(n) AS BIGINT) AS left_count, CAST(sum(m) AS BIGINT) AS right_count, CAST(greatest(sum(n) - sum(m), 0) AS BIGINT) AS excess FROM
            (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END AS m FROM events) GROUP BY event_type""",
        "license_targets": """SELECT repo_id, nullif(lower(trim(license_type)), '') AS license, CASE WHEN json_valid(repo_github_metadata) THEN nullif(trim(json_extract_string(repo_github_metadata, '$.language')), '') END AS language,
            coalesce(json_valid(repo_github_metadata), false) AS metadata_valid FROM repositories""",
        "cutoff_leaks": """WITH b AS (SELECT input_id, min(cutoff_turn) AS cutoff_turn FROM bundles GROUP BY input_id), e AS (SELECT DISTINCT event_pk, input_id, turn_number FROM trace_events)
            SELECT e.input_id, count(*) AS events_all, count(*) FILTER (WHERE cutoff_turn IS NULL OR turn_number < cutoff_turn) AS events_visible FROM e JOIN b ON b.input_id = e.input_id GROUP BY e.input_id""",
        "evidence_id_conflicts": "SELECT evidence_id, count(DISTINCT event_pk) AS events_with_id FROM trace_events WHERE evidence_id IS NOT NULL GROUP BY evidence_id HAVING count(DISTINCT event_pk) > 1",
        "late_rows": """SELECT event_type, count(*) AS row_count, count(*) FILTER (WHERE epoch_us(ingested_at) - epoch_us(event_ts) > 86400000000) AS late_rows FROM trace_events WHERE event_ts IS NOT NULL GROUP BY event_type""",
    }
