"""Queries of scoring, statistics, text and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import constraints as C
from ..operators import graph as G
from ..operators import nested as N
from ..operators import relational as R
from ..operators import scoring as K
from ..operators import sequence as S
from ..operators import stats as A
from ..operators import trace as E
from ..session import table
from .etl import events as trace

_ART = "(SELECT DISTINCT artifact_id, input_id, repo_id, path, kind, content FROM repo_artifacts)"


# -- scoring ---------------------------------------------------------------------
def _spans(spark, d):
    """Line ranges per (part, supplier side) taken from the order lines: gold from even, predictions from odd orders."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    r = li.select("l_partkey", "l_orderkey", (F.col("l_linenumber") * 20).cast("bigint").alias("a"), (F.col("l_linenumber") * 20 + F.col("q")).alias("b"))
    gold = S.islands(r.where("l_orderkey % 2 = 0"), ["l_partkey"], "a", "b").drop("merged")
    return gold, S.islands(r.where("l_orderkey % 2 = 1"), ["l_partkey"], "a", "b").drop("merged")


def span_overlap_score(spark, d):
    gold, predicted = _spans(spark, d)
    return K.line_prf(predicted, gold, ["l_partkey"], "a", "b")


def smallest_container(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("at")).distinct()
    spans = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("lo"), (F.col("p_size") + 20).cast("bigint").alias("hi"), F.col("p_name").alias("name"))
    wide = spans.unionByName(spans.select("l_partkey", F.lit(0).cast("bigint").alias("lo"), F.lit(60).cast("bigint").alias("hi"), F.lit("whole").alias("name")))
    return K.smallest_container(li, wide, ["l_partkey"], "at", "lo", "hi", ["l_orderkey", "l_linenumber", "l_partkey", "at"], "name").groupBy((F.col("container") == "whole").alias("whole")).agg(F.count("*").alias("points"))


def evidence_set_relation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("id"), "l_returnflag")
    g = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("id"))).alias("gold"), F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("id"))).alias("cand"))
    return g.withColumn("relation", K.set_relation(F.col("gold"), F.col("cand"))).groupBy("relation").agg(F.count("*").alias("orders"))


def symbol_location_scores(spark, d):
    r = N.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets'").select("gold_id", "path", "symbol", F.col("line_start").alias("a"), F.col("line_end").alias("b"), "evidence_no").distinct()
    y = r.toDF("gold_id", "path2", "symbol2", "a2", "b2", "evidence_no2")
    j = r.join(y, "gold_id").where("path = path2 and evidence_no < evidence_no2")
    s = K.location_score(K.symbol_compatible(F.col("symbol"), F.col("symbol2")), (F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b")))
    return j.withColumn("score", s).groupBy("gold_id").agg(F.max("score").alias("best_score"), F.count("*").alias("pairs"))


def optimal_assignment(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    b = e.withColumns({"block": F.expr("vec_id div 10"), "slot": F.col("vec_id") % 10})
    left, right = b.where("slot < 5").select("block", F.col("slot").alias("l"), F.col("x").alias("lx")), b.where("slot >= 5").select("block", F.col("slot").alias("r"), F.col("x").alias("rx"))
    scores = left.join(right, "block").select("block", "l", "r", F.round(F.abs(F.col("lx") - F.col("rx")), 6).alias("score"))
    return K.assign(scores, "block", "l", "r", "score").groupBy("block").agg(F.round(F.sum("score"), 5).alias("total_score"))


def _contents(spark, d):
    return trace(spark, d, "input_id", "content").select("input_id", F.md5(F.col("content").cast("binary")).alias("item"))


def similar_inputs(spark, d):
    return K.set_links(_contents(spark, d), "input_id", "item", 0.98)


def similar_input_members(spark, d):
    return K.set_members(_contents(spark, d), "input_id", "item", 0.98)


def _baskets(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderpriority")


def similar_basket_members(spark, d):
    """Customers by the set of priorities of their orders: many equal sets, and sets within 0.8 of each other."""
    return K.set_members(_baskets(spark, d), "o_custkey", "o_orderpriority", 0.8)


def similar_basket_links(spark, d):
    return K.set_links(_baskets(spark, d), "o_custkey", "o_orderpriority", 0.8)


# -- statistics ------------------------------------------------------------------
def grouping_sets_all(spark, d):
    return A.means_with_all(table(spark, d, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("n_chars")), ["lang", "source"], "n_chars")


def paired_means_gain(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'view')")
    return A.paired_gain(e.withColumn("bucket", F.col("user_id") % 7), ["user_id"], "event_type", "value", "click", "view", ["bucket"])


def percentiles(spark, d):
    return A.percentiles(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", [0.5, 0.9])


def ols_slope(spark, d):
    return A.slope(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")


def spearman_rank(spark, d):
    return A.spearman(table(spark, d, "lineitem").select("l_shipdate", "l_returnflag", "l_quantity", "l_discount"), ["l_returnflag"], "l_quantity", "l_discount")


def _cluster_differences(spark, d):
    e = table(spark, d, "events").where("value is not null")
    m = e.withColumns({"bucket": F.col("user_id") % 5, "cluster": F.col("user_id") % 60}).groupBy("bucket", "cluster").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("t"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    return m.select("bucket", "cluster", F.round(F.col("t") - F.col("b"), 9).alias("diff"))


def signflip_exact(spark, d):
    return A.signflip_exact(_cluster_differences(spark, d), ["bucket"], "diff")


def holm_adjust(spark, d):
    p = A.signflip_exact(_cluster_differences(spark, d), ["bucket"], "diff").withColumn("family", F.lit("views"))
    return A.holm(p, ["family"], "bucket", "p_value").select("bucket", "p_value", F.round("adjusted", 6).alias("adjusted"))


def bootstrap_ci(spark, d):
    e = table(spark, d, "events").select("event_type", "value", (F.col("user_id") % 50).alias("cluster"))
    return A.bootstrap(e, "event_type", "value", "cluster")


# -- text ------------------------------------------------------------------------
def file_kinds(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "path", "content")
    return a.select(T.file_kind(F.col("path"), F.col("content")).alias("kind"), T.extension(F.col("path")).alias("suffix")).groupBy("kind", "suffix").agg(F.count("*").alias("files"))


def sensitive_scan(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike(T.EMAIL)).alias("with_email"), F.coalesce(F.sum(F.regexp_count("text", F.lit(T.EMAIL))), F.lit(0)).cast("bigint").alias("emails"))


def email_redact(spark, d):
    e = trace(spark, d, "event_pk", "content").where("content like '%@%'")
    return e.select("event_pk", F.md5(T.redact_emails(F.col("content")).cast("binary")).alias("redacted_md5"))


def term_overlap(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "event_type", "turn_number", "content").where("content is not null")
    s = e.select("input_id", "turn_number", "event_type", F.explode(T.words(T.invocation(F.col("content")))).alias("term"))
    p = s.where("event_type = 'user_prompt'").select("input_id", "turn_number", "term").distinct()
    r = s.where("event_type = 'assistant_response'").select("input_id", "turn_number", "term").distinct()
    return p.join(r, ["input_id", "turn_number", "term"]).groupBy("input_id", "turn_number").agg(F.count("*").alias("shared_terms")).select("input_id", F.col("turn_number").cast("bigint").alias("turn_number"), "shared_terms")


def source_tokens(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "repo_id", "kind", "content")
    return a.groupBy(F.lower("kind").alias("kind")).agg(F.count("*").alias("files"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"))


def failure_fingerprints(spark, d):
    e = trace(spark, d, "event_pk", "content").where("content like '%FAILED%'")
    line = F.regexp_extract("content", r"(FAILED [^\n]*)", 1)
    return e.select(T.fingerprint(line).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("failures"))


def numbered_source(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "content").where("content is not null")
    return a.select("artifact_id", F.length(T.numbered(F.col("content"))).cast("bigint").alias("rendered_chars"))


def tool_split(spark, d):
    e = trace(spark, d, "event_pk", "event_type", "tool_name", "content").where("event_type = 'tool_exchange'")
    x = e.select("event_pk", F.length(T.invocation(F.col("content"))).cast("bigint").alias("invocation_chars"), F.get_json_object(T.tool_input(F.col("content")), "$.tool").alias("tool"))
    return x


# -- graphs ----------------------------------------------------------------------
def _links(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    return G.undirected(c.unionByName(o).unionByName(n), "a", "b")


def one_hop_neighbors(spark, d):
    return G.neighbours(spark.createDataFrame([("n3",), ("n7",)], "node string"), _links(spark, d))


def bounded_bfs(spark, d):
    return G.bounded_bfs(spark.createDataFrame([("r1",)], "node string"), _links(spark, d), 3).groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("nodes"), F.min("node").alias("least_node"))


def component_labels(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    return G.components(G.undirected(o, "a", "b")).groupBy("component").agg(F.count("*").alias("nodes"))


def merged_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_orderkey").cast("string").alias("evidence"), F.nullif("l_linestatus", F.lit("F")).alias("via"))
    return R.merge_edges(li).where("merged > 1")


def top_neighbour_edges(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other")).agg(F.count("*").alias("weight"))
    roots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return G.top_edges(li, roots, [F.desc("weight"), F.col("other")]).select("node", "other", "weight", F.col("edge_rank").cast("bigint").alias("edge_rank"))


def reference_edges(spark, d):
    return E.reference_edges(trace(spark, d))


def task_assignment(spark, d):
    return E.assign_tasks(trace(spark, d)).groupBy("rule").agg(F.count("*").alias("events"), F.count_distinct("input_id").alias("inputs"))


def constraint_report(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "event_type", "turn_number", "tool_name", "input_order")
    dup = e.groupBy("input_id", "input_order").agg(F.count("*").alias("n")).where("n > 1")
    g = R.once(table(spark, d, "gold_conditions"), "gold_id", "input_id", "condition_id")
    twice = g.groupBy("input_id", "condition_id").agg(F.count("*").alias("n")).where("n > 1")
    return C.report(
        [
            C.Constraint("unknown_event_type", e.where("event_type not in ('system', 'user_prompt', 'assistant_response', 'tool_exchange')"), "event_pk"),
            C.Constraint("tool_name_outside_exchange", e.where("tool_name is not null and event_type <> 'tool_exchange'"), "event_pk"),
            C.Constraint("exchange_without_tool_name", e.where("tool_name is null and event_type = 'tool_exchange'"), "event_pk"),
            C.Constraint("negative_turn", e.where("turn_number < 0"), "event_pk"),
            C.Constraint("repeated_position", dup, "input_id"),
            C.Constraint("condition_twice_in_input", twice, "input_id"),
            C.Constraint("malformed_condition_id", g.where("condition_id is null or not condition_id rlike '^kc_[0-9]{3}$'"), "gold_id"),
        ]
    )


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def _words_sql(text):
    """The terms of a text, as ``functions.text.words`` has them."""
    stop = ", ".join(f"'{w}'" for w in T.STOP)
    pattern = T.WORD.replace(r"\u4e00-\u9fff", r"\x{4e00}-\x{9fff}")
    return f"""(SELECT list_distinct(list_concat(k, list_filter(flatten(list_transform(k, lambda t: regexp_split_to_array(t, '[/_.-]+'))), lambda t: length(t) >= 3 AND NOT list_contains([{stop}], t))))
        FROM (SELECT list_filter(list_transform(regexp_extract_all(lower({text}), '{pattern}', 1), lambda t: regexp_replace(replace(t, chr(92), '/'), '^[./-]+|[./-]+$', '', 'g')), lambda t: t <> '' AND NOT list_contains([{stop}], t)) AS k))"""


def _kind_sql(path, content):
    """The kind of a file, as ``functions.text.file_kind`` has it."""
    some = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    name = f"list_last(string_split(lower({path}), '/'))"
    folders = f"list_slice(string_split(lower({path}), '/'), 1, -2)"
    suffix = f"regexp_extract({name}, '^.+(\\.[^.]+)$', 1)"
    head = f"coalesce(left({content}, {T.HEAD_BYTES}), '')"
    manifest = f"(({name} LIKE 'requirements%' AND {suffix} IN ('', '.in', '.txt')) OR list_contains({folders}, 'requirements'))"
    has = lambda xs: f"list_contains({some(xs)}, {suffix})"
    mark = T.TEMPLATE_MARK.replace("'", "''")
    return f"""CASE WHEN list_has_any({folders}, {some(T.FOLDERS)}) THEN NULL WHEN list_contains({some(T.NAMES)}, {name}) OR regexp_matches({name}, '{T.TEST_NAME}') OR regexp_matches({name}, '{T.TEST_NEEDS}') THEN NULL
        WHEN {has(T.BINARY)} OR ({has(T.DOCUMENT)} AND NOT {manifest}) OR contains({head}, chr(0)) THEN NULL WHEN {has(T.SOURCE)} THEN 'source' WHEN {has(T.TEMPLATE)} THEN 'runtime_template'
        WHEN {suffix} = '.html' THEN CASE WHEN list_has_any({folders}, ['templates', 'views']) OR regexp_matches({head}, '{mark}') THEN 'runtime_template' END
        WHEN {has(T.EXECUTABLE)} OR ({suffix} = '' AND {head} LIKE '#!%') THEN 'executable' WHEN {manifest} OR {has(T.CONFIG)} THEN 'configuration' END"""


def oracle_sql():
    isl = """(SELECT l_partkey, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_partkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM
        (SELECT *, CASE WHEN pb IS NULL OR a > pb + 1 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(b) OVER (PARTITION BY l_partkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM
        (SELECT l_partkey, CAST(l_linenumber * 20 AS BIGINT) AS a, CAST(l_linenumber * 20 + CAST(l_quantity AS BIGINT) AS BIGINT) AS b FROM lineitem WHERE l_orderkey % 2 = {m}) r) r2) r3) r4 GROUP BY l_partkey, g)"""
    lines = "(SELECT DISTINCT l_partkey, unnest(range(a, b + 1)) AS x FROM {i})"
    te = "(SELECT DISTINCT event_pk, input_id, event_type, turn_number, input_order, tool_name, content FROM trace_events)"
    inv = "split_part(content, chr(10) || chr(10) || 'Tool result:', 1)"
    sets = """WITH s AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), []) AS items FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
            c AS (SELECT items, min(o_custkey) AS representative, count(*) AS members FROM s GROUP BY 1),
            p AS (SELECT a.items, a.representative AS x, b.representative AS y, b.members, len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) AS j FROM c a JOIN c b ON a.items <> b.items WHERE len(a.items) + len(b.items) > 0)"""
    own = {
        "similar_basket_members": f"""{sets}, l AS (SELECT items, sum(members) AS near FROM p WHERE j >= 0.8 GROUP BY 1)
            SELECT o_custkey, representative, members, (members - 1 + coalesce(near, 0))::BIGINT AS links FROM s JOIN c USING (items) LEFT JOIN l USING (items)""",
        "similar_basket_links": f"""{sets} SELECT least(x, y) AS left_id, greatest(x, y) AS right_id, round(j, 6) AS similarity FROM p WHERE j >= 0.8 AND x < y
            UNION ALL SELECT representative, o_custkey, 1.0::DOUBLE FROM s JOIN c USING (items) WHERE o_custkey <> representative""",
        "similar_input_members": """WITH i AS (SELECT DISTINCT input_id, md5(content) AS item FROM trace_events WHERE input_id IS NOT NULL), s AS (SELECT input_id, coalesce(list_sort(list(item) FILTER (WHERE item IS NOT NULL)), []) AS items FROM i GROUP BY 1),
            c AS (SELECT items, min(input_id) AS representative, count(*) AS members FROM s GROUP BY 1),
            l AS (SELECT a.items, sum(b.members) AS near FROM c a JOIN c b ON a.items <> b.items AND len(list_intersect(a.items, b.items)) >= 0.98 * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) AND len(a.items) > 0 GROUP BY 1)
            SELECT input_id, representative, members, (members - 1 + coalesce(near, 0))::BIGINT AS links FROM s JOIN c USING (items) LEFT JOIN l USING (items)""",
        "file_kinds": f"""SELECT {_kind_sql("path", "content")} AS kind, regexp_extract(regexp_replace(lower(replace(trim(path), chr(92), '/')), '/+$', ''), '(\\.[a-z0-9_+-]+)$', 1) AS suffix, count(*) AS files
            FROM (SELECT DISTINCT artifact_id, path, content FROM repo_artifacts) GROUP BY 1, 2""",
        "term_overlap": f"""WITH s AS (SELECT DISTINCT input_id, turn_number, event_type, unnest({_words_sql(inv)}) AS term FROM {te} WHERE content IS NOT NULL AND event_type IN ('user_prompt', 'assistant_response'))
            SELECT input_id, turn_number::BIGINT AS turn_number, count(*) AS shared_terms FROM (SELECT input_id, turn_number, term FROM s GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL""",
    }
    return own | {
        "span_overlap_score": f"""WITH p AS (SELECT l_partkey, count(*) AS n FROM {lines.format(i=isl.format(m=1))} GROUP BY 1), g AS (SELECT l_partkey, count(*) AS n FROM {lines.format(i=isl.format(m=0))} GROUP BY 1),
            h AS (SELECT l_partkey, count(*) AS n FROM {lines.format(i=isl.format(m=1))} JOIN {lines.format(i=isl.format(m=0))} USING (l_partkey, x) GROUP BY 1),
            j AS (SELECT l_partkey, coalesce(p.n, 0) AS predicted_lines, coalesce(g.n, 0) AS gold_lines, coalesce(h.n, 0) AS hits FROM p FULL JOIN g USING (l_partkey) LEFT JOIN h USING (l_partkey))
            SELECT l_partkey, predicted_lines, gold_lines, hits, round(CASE WHEN predicted_lines > 0 THEN hits / predicted_lines ELSE 0 END, 6) AS precision, round(CASE WHEN gold_lines > 0 THEN hits / gold_lines ELSE 0 END, 6) AS recall,
            round(CASE WHEN hits > 0 THEN 2 * hits / (predicted_lines + gold_lines) ELSE 0 END, 6) AS f1 FROM j""",
        "smallest_container": """SELECT whole, count(*) AS points FROM (SELECT CASE WHEN CAST(l_quantity AS BIGINT) BETWEEN p_size AND p_size + 20 THEN false ELSE true END AS whole FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) JOIN part ON p_partkey = l_partkey) GROUP BY whole""",
        "evidence_set_relation": """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), g AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'), c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'),
            n AS (SELECT o.l_orderkey, (SELECT count(*) FROM g WHERE g.l_orderkey = o.l_orderkey) AS ng, (SELECT count(*) FROM c WHERE c.l_orderkey = o.l_orderkey) AS nc, (SELECT count(*) FROM g JOIN c USING (l_orderkey, l_suppkey) WHERE g.l_orderkey = o.l_orderkey) AS nb FROM o)
            SELECT CASE WHEN ng = 0 THEN NULL WHEN nb = 0 THEN 'disjoint' WHEN nb = ng AND nb = nc THEN 'exact' WHEN nb = ng THEN 'superset' WHEN nb = nc THEN 'proper_subset' ELSE 'partial_overlap' END AS relation, count(*) AS orders FROM n GROUP BY 1""",
        "symbol_location_scores": """WITH g AS (SELECT DISTINCT gold_id, location_targets FROM gold_conditions), o AS (SELECT gold_id, i, location_targets[i] AS l FROM (SELECT gold_id, location_targets, unnest(range(1, len(location_targets) + 1)) AS i FROM g) WHERE location_targets[i] IS NOT NULL),
            r AS (SELECT DISTINCT gold_id, i, t.path AS path, t.symbol AS symbol, t.start_line AS a, coalesce(t.end_line, t.start_line) AS b FROM (SELECT gold_id, i, unnest(l) AS t FROM o) WHERE t.start_line IS NOT NULL),
            j AS (SELECT x.gold_id, x.symbol AS s, y.symbol AS s2, x.a <= y.b AND y.a <= x.b AS lines FROM r x JOIN r y ON x.gold_id = y.gold_id AND x.path = y.path AND x.i < y.i),
            k AS (SELECT gold_id, lines, CASE WHEN coalesce(s, '') = '' OR coalesce(s2, '') = '' THEN false WHEN s = s2 THEN true WHEN contains(s, '.') AND contains(s2, '.') THEN split(s, '.')[-2:] = split(s2, '.')[-2:] ELSE false END AS sym FROM j)
            SELECT gold_id, max(CASE WHEN sym AND lines THEN 1.0::DOUBLE WHEN sym OR lines THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS best_score, count(*) AS pairs FROM k GROUP BY gold_id""",
        "optimal_assignment": """WITH e AS (SELECT vec_id // 10 AS block, vec_id % 10 AS slot, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings),
            s AS (SELECT l.block, l.slot AS l, r.slot AS r, round(abs(l.x - r.x), 6) AS w FROM e l JOIN e r ON l.block = r.block AND l.slot < 5 AND r.slot >= 5)
            SELECT a.block, round(max(a.w + b.w + c.w + d.w + f.w), 5) AS total_score FROM s a JOIN s b ON b.block = a.block AND b.l = 1 AND b.r <> a.r JOIN s c ON c.block = a.block AND c.l = 2 AND c.r NOT IN (a.r, b.r)
            JOIN s d ON d.block = a.block AND d.l = 3 AND d.r NOT IN (a.r, b.r, c.r) JOIN s f ON f.block = a.block AND f.l = 4 AND f.r NOT IN (a.r, b.r, c.r, d.r) WHERE a.l = 0 GROUP BY a.block""",
        "grouping_sets_all": """SELECT CASE WHEN grouping(l) = 1 THEN 'All' ELSE l END AS lang, CASE WHEN grouping(s) = 1 THEN 'All' ELSE s END AS source, count(*) AS n, round(avg(CAST(n_chars AS DOUBLE)), 6) AS mean_value
            FROM (SELECT coalesce(lang, '(null)') AS l, coalesce(source, '(null)') AS s, n_chars FROM documents) GROUP BY CUBE (l, s)""",
        "paired_means_gain": """WITH p AS (SELECT user_id % 7 AS bucket, user_id, avg(value) FILTER (WHERE event_type = 'click') AS b, avg(value) FILTER (WHERE event_type = 'view') AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
            m AS (SELECT bucket, count(*) AS pairs, avg(b) AS mb, avg(t) AS mt FROM p WHERE b IS NOT NULL AND t IS NOT NULL GROUP BY bucket)
            SELECT bucket, pairs, round(mb, 6) AS baseline_mean, round(mt, 6) AS treated_mean, round(mt - mb, 6) AS difference, round((mt / nullif(mb, 0) - 1) * 100, 6) AS gain_percent FROM m""",
        "percentiles": """SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, quantile_disc(o_totalprice, 0.5) AS rank_p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, quantile_disc(o_totalprice, 0.9) AS rank_p90 FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority""",
        "ols_slope": "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem GROUP BY l_returnflag",
        "spearman_rank": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rx,
            rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS ry FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
            SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY l_returnflag""",
        "signflip_exact": _signflip_sql(),
        "holm_adjust": f"""WITH p AS ({_signflip_sql()}), r AS (SELECT *, row_number() OVER (ORDER BY p_value, bucket) AS r, count(*) OVER () AS m FROM p)
            SELECT bucket, p_value, round(max(least(1.0, (m - r + 1) * p_value)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""",
        "sensitive_scan": r"""SELECT source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS with_email,
            CAST(sum(len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))) AS BIGINT) AS emails FROM documents WHERE text IS NOT NULL GROUP BY source""",
        "email_redact": rf"""SELECT event_pk, md5(regexp_replace(content, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[REDACTED:EMAIL]', 'g')) AS redacted_md5 FROM {te} WHERE contains(content, '@')""",
        "source_tokens": f"SELECT lower(kind) AS kind, count(*) AS files, CAST(sum((coalesce(strlen(content), 0) + 2) // 3) AS BIGINT) AS tokens FROM {_ART} GROUP BY 1",
        "failure_fingerprints": rf"""SELECT regexp_replace(regexp_replace(regexp_replace(regexp_extract(content, '(FAILED [^\n]*)', 1), '/tmp/[^ \n]+', '<tmp>', 'g'), '''[^''\n]*''|"[^"\n]*"', '<str>', 'g'), '[0-9]+', '<n>', 'g') AS fingerprint,
            count(*) AS failures FROM {te} WHERE contains(content, 'FAILED') GROUP BY 1""",
        "numbered_source": """WITH a AS (SELECT DISTINCT artifact_id, content, length(content) - length(replace(content, chr(10), '')) + 1 AS n FROM repo_artifacts WHERE content IS NOT NULL)
            SELECT artifact_id, CAST(length(content) + (SELECT sum(length(CAST(i AS VARCHAR)) + 3) FROM range(1, a.n + 1) t(i)) AS BIGINT) AS rendered_chars FROM a""",
        "tool_split": f"""SELECT event_pk, CAST(CASE WHEN strpos(content, chr(10) || chr(10) || 'Tool result:') > 0 THEN strpos(content, chr(10) || chr(10) || 'Tool result:') - 1 ELSE length(content) END AS BIGINT) AS invocation_chars,
            CASE WHEN json_valid(j) THEN json_extract_string(j, '$.tool') END AS tool FROM (SELECT *, trim(regexp_extract(split_part(content, chr(10) || chr(10) || 'Tool result:', 1), '(?s)^[^\n]*\n(.*)$', 1)) AS j FROM {te} WHERE event_type = 'tool_exchange')""",
        "one_hop_neighbors": "WITH l AS (" + _LINKS + ") SELECT DISTINCT b AS node FROM l WHERE a IN ('n3', 'n7') AND b NOT IN ('n3', 'n7')",
        "bounded_bfs": "WITH RECURSIVE l AS (" + _LINKS + """), w(node, depth) AS (SELECT 'r1', 0 UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 3),
            m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS nodes, min(node) AS least_node FROM m GROUP BY depth""",
        "component_labels": """SELECT least(min('o' || o_orderkey), min('c' || o_custkey)) AS component, count(*) + 1 AS nodes FROM orders GROUP BY o_custkey""",
        "merged_edges": """SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relation, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS evidence,
            string_agg(DISTINCT nullif(l_linestatus, 'F'), ' | ' ORDER BY nullif(l_linestatus, 'F')) AS via, count(*) AS merged FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
        "top_neighbour_edges": """SELECT node, other, weight, edge_rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS edge_rank FROM (SELECT l_suppkey AS node, l_partkey AS other, count(*) AS weight FROM lineitem
            WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL)) WHERE edge_rank <= 4""",
        "constraint_report": f"""WITH e AS {te}, g AS (SELECT DISTINCT gold_id, input_id, condition_id FROM gold_conditions), d AS (SELECT input_id FROM e GROUP BY input_id, input_order HAVING count(*) > 1), t AS (SELECT input_id FROM g GROUP BY input_id, condition_id HAVING count(*) > 1)
            SELECT 'unknown_event_type' AS check_name, count(*) AS violations, min(CAST(event_pk AS VARCHAR)) AS example FROM e WHERE event_type NOT IN ('system', 'user_prompt', 'assistant_response', 'tool_exchange')
            UNION ALL SELECT 'tool_name_outside_exchange', count(*), min(CAST(event_pk AS VARCHAR)) FROM e WHERE tool_name IS NOT NULL AND event_type <> 'tool_exchange'
            UNION ALL SELECT 'exchange_without_tool_name', count(*), min(CAST(event_pk AS VARCHAR)) FROM e WHERE tool_name IS NULL AND event_type = 'tool_exchange'
            UNION ALL SELECT 'negative_turn', count(*), min(CAST(event_pk AS VARCHAR)) FROM e WHERE turn_number < 0
            UNION ALL SELECT 'repeated_position', count(*), min(input_id) FROM d UNION ALL SELECT 'condition_twice_in_input', count(*), min(input_id) FROM t
            UNION ALL SELECT 'malformed_condition_id', count(*), min(CAST(gold_id AS VARCHAR)) FROM g WHERE condition_id IS NULL OR NOT regexp_full_match(condition_id, 'kc_[0-9]{{3}}')""",
    }


_LINKS = """SELECT DISTINCT a, b FROM (SELECT x AS a, y AS b FROM e UNION ALL SELECT y AS a, x AS b FROM e)"""
_LINKS = _LINKS.replace(
    "e UNION ALL",
    "(SELECT 'c' || c_custkey AS x, 'n' || c_nationkey AS y FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) e UNION ALL",
).replace(
    "AS b FROM e)",
    "AS b FROM (SELECT 'c' || c_custkey AS x, 'n' || c_nationkey AS y FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) e)",
)


def _signflip_sql():
    return """WITH m AS (SELECT user_id % 5 AS bucket, user_id % 60 AS cluster, avg(value) FILTER (WHERE event_type = 'view') AS t, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events WHERE value IS NOT NULL GROUP BY ALL),
        d AS (SELECT bucket, round(t - b, 9) AS diff, row_number() OVER (PARTITION BY bucket ORDER BY round(t - b, 9), cluster) - 1 AS i FROM m WHERE t IS NOT NULL AND b IS NOT NULL),
        k AS (SELECT bucket, count(*) AS n, sum(diff) AS seen FROM d GROUP BY bucket),
        s AS (SELECT k.bucket, k.n, k.seen, unnest(range(CAST(power(2, k.n) AS BIGINT))) AS mask FROM k),
        z AS (SELECT s.bucket, s.n, s.mask, s.seen, sum(CASE WHEN (s.mask >> d.i) % 2 = 1 THEN -d.diff ELSE d.diff END) AS total FROM s JOIN d ON d.bucket = s.bucket GROUP BY ALL)
        SELECT bucket, n AS clusters, round(avg(CASE WHEN total >= seen - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM z GROUP BY ALL"""
