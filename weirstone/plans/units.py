"""Queries of ordered choices, searches and small statistics over evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as V
from ..operators import nested as N
from ..operators import relational as R
from ..operators import retrieval as Q
from ..session import table
from .analysis import _words_sql
from .etl import events as trace

_TE = "(SELECT DISTINCT event_pk, input_id, session_id, event_type, turn_number, input_order, evidence_id, tool_name, content FROM trace_events)"


def event_occurrences(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "turn_number", "event_type", "input_order")
    return V.occurrence(e, ["input_id", "turn_number", "event_type"], ["input_order", "event_pk"]).select("event_pk", "occurrence")


def last_events(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "turn_number", "input_order")
    return V.last_of(e, ["input_id", "turn_number"], ["input_order", "event_pk"], 3).select("event_pk", "from_end")


def first_deliveries(spark, d):
    t = table(spark, d, "trace_events").select("event_pk", "event_type", "ingested_at")
    return V.first_wins(t, ["event_pk"], ["ingested_at"]).groupBy("event_type").agg(F.count("*").alias("events"), F.min(F.unix_micros("ingested_at")).alias("earliest"))


def fresh_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return V.fresh_first(o, "o_custkey", "o_orderpriority", ["o_orderkey"], F.col("o_orderstatus") == "F").select("o_orderkey", "place", "accepted")


def prefix_lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("bigint").alias("q"))
    return V.longest_prefix(li, ["l_orderkey"], ["l_linenumber", "q"], "q", 60)


def ranked_names(spark, d):
    """The part names that answer the region and nation names best."""
    q = table(spark, d, "part").select(F.lower(F.element_at(F.split("p_type", " "), -1)).alias("query")).where("query <> ''")
    return V.ranked_symbols(table(spark, d, "part").select("p_type"), q, "p_type", "query", 12)


def continued_prompts(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "event_type", "input_order", "content").where("event_type = 'user_prompt'")
    k = e.select("event_pk", "input_id", "input_order", F.coalesce(T.words(F.col("content")), F.array().cast("array<string>")).alias("keys"))
    return V.same_task(k, ["input_id"], "input_order", "keys").select("event_pk", "continues")


def uncovered_terms(spark, d):
    """Back-quoted names of the prompts that no response of the input shows."""
    e = trace(spark, d, "input_id", "event_type", "content").where("content is not null")
    n = e.select("input_id", "event_type", F.explode(F.regexp_extract_all("content", F.lit(r"`([^`\n]{2,120})`"), F.lit(1))).alias("term"))
    return V.uncovered_terms(n.where("event_type = 'user_prompt'"), n.where("event_type = 'assistant_response'"), ["input_id"], "term")


def evidence_hits(spark, d):
    g = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets'").groupBy("gold_id").agg(F.collect_set("evidence_id").alias("gold"))
    c = R.once(table(spark, d, "gold_conditions"), "gold_id", "input_id")
    s = trace(spark, d, "input_id", "evidence_id").groupBy("input_id").agg(F.collect_set("evidence_id").alias("shown"))
    j = c.join(g, "gold_id").join(s, "input_id", "left")
    return j.select("gold_id", V.evidence_hit(F.col("gold"), F.coalesce("shown", F.array().cast("array<string>"))).alias("hit"))


def prioritized_files(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "path", F.lower("kind").alias("kind"), F.length("content").alias("chars"))
    return V.priority(a, ["input_id"], F.col("kind") == "source", F.col("path").like("%/%"), F.col("chars"), F.col("path").contains("_"), "path").select("artifact_id", "place")


def log_slopes(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    s = V.slope_interval(li, ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"))
    return s.select("l_returnflag", "n", *[F.round(c, 3).alias(c) for c in ("slope", "error", "low", "high")])


def scalar_totals(spark, d):
    """One row of totals of several tables."""
    one = lambda name, c, out: table(spark, d, name).agg(c.alias(out))
    parts = [one("orders", F.count("*"), "orders"), one("lineitem", F.count_distinct("l_orderkey"), "ordered"), one("customer", F.count("*"), "customers")]
    return parts[0].select("*", parts[1].scalar().alias("ordered"), parts[2].scalar().alias("customers"))


def distinct_but_time(spark, d):
    """The rows of a table but for its delivery time: rows, and distinct ones."""
    t = table(spark, d, "repo_artifacts")
    own = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in t.drop("ingested_at", "content", "captured_at").columns]
    return t.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*own)).alias("distinct_rows"))


def located_targets(spark, d):
    """Targets and the files they name, by the composite key (input, path)."""
    g = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets'").select("gold_id", "path").distinct().join(R.once(table(spark, d, "gold_conditions"), "gold_id", "input_id"), "gold_id")
    a = table(spark, d, "repo_artifacts").select("input_id", "path").distinct().withColumn("known", F.lit(1))
    return g.join(a, ["input_id", "path"], "left").groupBy("input_id").agg(F.count("*").alias("targets"), F.count("known").alias("known"))


def evidence_duplicates(spark, d):
    return table(spark, d, "trace_events").where("evidence_id is not null").groupBy("evidence_id").agg(F.count("*").alias("rows"), F.count_distinct("event_pk").alias("events")).where("rows > 1")


def input_totals(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "path")
    t = trace(spark, d, "event_pk", "input_id", "evidence_id").groupBy("input_id").agg(F.count("*").alias("events"), F.count("evidence_id").alias("with_evidence"))
    f = a.groupBy("input_id").agg(F.count("*").alias("files"), F.count_distinct(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("folders"))
    return f.join(t, "input_id", "full").fillna(0, ["files", "folders", "events", "with_evidence"])


def prompt_operations(spark, d):
    """Signals of the prompts of a turn taken together: the union of their operations and terms."""
    e = trace(spark, d, "input_id", "turn_number", "event_type", "content").where("event_type = 'user_prompt' and content is not null")
    s = e.select("input_id", F.col("turn_number").cast("bigint").alias("turn_number"), Q.operations(F.col("content")).alias("p"), T.words(F.col("content")).alias("t"))
    g = s.groupBy("input_id", "turn_number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"), F.size(F.array_distinct(F.flatten(F.collect_list("t")))).cast("bigint").alias("terms"))
    return g.select("input_id", "turn_number", F.array_join("p", ",").alias("operations"), "terms")


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def oracle_sql():
    from .evidence import _TARGETS

    found = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in sorted(Q.OPERATIONS.items()))
    tier = "CASE WHEN p_type = q THEN 0 WHEN lower(p_type) = q THEN 1 WHEN list_last(regexp_split_to_array(lower(p_type), '[.\\s]')) = q THEN 2 WHEN starts_with(lower(p_type), q) THEN 3 WHEN contains(lower(p_type), q) THEN 4 END"
    return {
        "event_occurrences": f"SELECT event_pk, row_number() OVER (PARTITION BY input_id, turn_number, event_type ORDER BY input_order, event_pk) - 1 AS occurrence FROM {_TE}",
        "last_events": f"SELECT * FROM (SELECT event_pk, row_number() OVER (PARTITION BY input_id, turn_number ORDER BY input_order DESC, event_pk DESC) AS from_end FROM {_TE}) WHERE from_end <= 3",
        "first_deliveries": "SELECT event_type, count(*) AS events, epoch_us(min(t0)) AS earliest FROM (SELECT event_pk, any_value(event_type) AS event_type, min(ingested_at) AS t0 FROM trace_events GROUP BY 1) GROUP BY 1",
        "fresh_orders": """SELECT o_orderkey, place, ok AND n = 1 AS accepted FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY place) AS n FROM
            (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders))""",
        "prefix_lines": """SELECT l_orderkey, count(*) FILTER (WHERE s <= 60) AS fitting, coalesce(max(s) FILTER (WHERE s <= 60), 0)::BIGINT AS cost FROM
            (SELECT l_orderkey, sum(floor(l_quantity)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, floor(l_quantity) ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) GROUP BY 1""",
        "ranked_names": f"""WITH q AS (SELECT DISTINCT lower(list_last(string_split(p_type, ' '))) AS q FROM part WHERE p_type IS NOT NULL), h AS (SELECT p_type, q AS query, {tier} AS tier FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL), q WHERE q <> '')
            SELECT * FROM (SELECT p_type, query, tier, row_number() OVER (PARTITION BY query ORDER BY tier, length(p_type), p_type) AS place FROM h WHERE tier IS NOT NULL) WHERE place <= 12""",
        "continued_prompts": f"""WITH k AS (SELECT event_pk, input_id, input_order, coalesce({_words_sql("content")}, []) AS keys FROM {_TE} WHERE event_type = 'user_prompt'), l AS (SELECT *, lag(keys) OVER (PARTITION BY input_id ORDER BY input_order) AS b FROM k)
            SELECT event_pk, b IS NOT NULL AND NOT (len(keys) > 0 AND len(coalesce(b, [])) > 0 AND NOT list_has_any(keys, b)) AS continues FROM l""",
        "uncovered_terms": rf"""WITH n AS (SELECT DISTINCT input_id, event_type, unnest(regexp_extract_all(content, '`([^`\n]{{2,120}})`', 1)) AS term FROM {_TE} WHERE content IS NOT NULL),
            a AS (SELECT * FROM n WHERE event_type = 'user_prompt'), s AS (SELECT input_id, term, 1 AS hit FROM n WHERE event_type = 'assistant_response')
            SELECT input_id, count(*) AS terms, count(*) FILTER (WHERE hit IS NULL) AS uncovered FROM a LEFT JOIN s USING (input_id, term) GROUP BY 1""",
        "evidence_hits": f"""WITH g AS (SELECT gold_id, list(DISTINCT evidence_id) FILTER (WHERE evidence_id IS NOT NULL) AS gold FROM {_TARGETS} GROUP BY 1), c AS (SELECT DISTINCT gold_id, input_id FROM gold_conditions),
            s AS (SELECT input_id, list(DISTINCT evidence_id) FILTER (WHERE evidence_id IS NOT NULL) AS shown FROM trace_events GROUP BY 1)
            SELECT gold_id, CASE WHEN len(gold) > 0 THEN list_has_any(gold, coalesce(shown, []))::INT::DOUBLE END AS hit FROM g JOIN c USING (gold_id) LEFT JOIN s USING (input_id)""",
        "prioritized_files": """SELECT artifact_id, row_number() OVER (PARTITION BY input_id ORDER BY coalesce(k = 'source', false) DESC, contains(path, '/') DESC, chars DESC NULLS LAST, contains(path, '_') DESC, lower(path), path) AS place
            FROM (SELECT DISTINCT artifact_id, input_id, path, lower(kind) AS k, length(content) AS chars FROM repo_artifacts)""",
        "log_slopes": """WITH s AS (SELECT l_returnflag, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM (SELECT l_returnflag, log2(l_quantity) AS x, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1),
            e AS (SELECT *, sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx) AS error FROM s)
            SELECT l_returnflag, n, round(slope, 3) AS slope, round(error, 3) AS error, round(slope - 1.959963984540054 * error, 3) AS low, round(slope + 1.959963984540054 * error, 3) AS high FROM e""",
        "scalar_totals": "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS ordered, (SELECT count(*) FROM customer) AS customers",
        "distinct_but_time": """SELECT (SELECT count(*) FROM repo_artifacts) AS rows, count(*) AS distinct_rows FROM (SELECT DISTINCT * EXCLUDE (ingested_at, content, captured_at) FROM repo_artifacts)""",
        "located_targets": f"""WITH g AS (SELECT DISTINCT gold_id, path FROM {_TARGETS}), c AS (SELECT DISTINCT gold_id, input_id FROM gold_conditions), a AS (SELECT DISTINCT input_id, path, 1 AS known FROM repo_artifacts)
            SELECT input_id, count(*) AS targets, count(known) AS known FROM g JOIN c USING (gold_id) LEFT JOIN a USING (input_id, path) GROUP BY 1""",
        "evidence_duplicates": "SELECT evidence_id, count(*) AS rows, count(DISTINCT event_pk) AS events FROM trace_events WHERE evidence_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "input_totals": f"""WITH f AS (SELECT input_id, count(*) AS files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1)) AS folders FROM (SELECT DISTINCT artifact_id, input_id, path FROM repo_artifacts) GROUP BY 1),
            t AS (SELECT input_id, count(*) AS events, count(evidence_id) AS with_evidence FROM (SELECT DISTINCT event_pk, input_id, evidence_id FROM trace_events) GROUP BY 1)
            SELECT input_id, coalesce(files, 0) AS files, coalesce(folders, 0) AS folders, coalesce(events, 0) AS events, coalesce(with_evidence, 0) AS with_evidence FROM f FULL JOIN t USING (input_id)""",
        "prompt_operations": f"""WITH s AS (SELECT input_id, turn_number, list_filter([{found}], lambda x: x IS NOT NULL) AS p, {_words_sql("content")} AS t FROM {_TE} WHERE event_type = 'user_prompt' AND content IS NOT NULL)
            SELECT input_id, turn_number::BIGINT AS turn_number, coalesce(array_to_string(list_sort(list_distinct(flatten(list(p)))), ','), '') AS operations, len(list_distinct(flatten(list(t))))::BIGINT AS terms FROM s GROUP BY 1, 2""",
    }
