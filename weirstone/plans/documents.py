"""Queries of the table-valued text operators, of reviews and of slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import relational as R
from ..operators import review as V
from ..operators import sequence as S
from ..operators import slicing as X
from ..session import table
from .etl import events as trace

_TE = "(SELECT DISTINCT event_pk, input_id, session_id, event_type, turn_number, input_order, content FROM trace_events)"


def markdown_sections(spark, d):
    return D.sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "section_no", "level", "title", "line_start")


def demand_spans(spark, d):
    return D.demands(trace(spark, d, "event_pk", "event_type", "content").where("event_type = 'user_prompt'"), "event_pk", "content")


def paragraph_blocks(spark, d):
    p = D.paragraphs(trace(spark, d, "event_pk", "event_type", "content").where("event_type = 'assistant_response'"), "event_pk", "content")
    return p.groupBy("kind").agg(F.count("*").alias("blocks"), F.count_distinct("event_pk").alias("events"))


def patch_paths(spark, d):
    return D.patch_paths(trace(spark, d, "event_pk", "content").where("content like '%+++ %' or content like '%*** % File:%'"), "event_pk", "content")


def shell_paths(spark, d):
    e = trace(spark, d, "event_pk", "event_type", "content").where("event_type = 'tool_exchange'")
    c = e.select("event_pk", F.get_json_object(T.tool_input(F.col("content")), "$.input.command").alias("command"))
    return D.shell_paths(c, "event_pk", "command").groupBy("status").agg(F.count("*").alias("rows_with_status"))


def json_leaves(spark, d):
    e = R.once(table(spark, d, "repositories"), "repo_id", "repo_github_metadata")
    return D.json_leaves(e, "repo_id", "repo_github_metadata").groupBy("pointer").agg(F.count("*").alias("repositories"))


def prompt_leaks(spark, d):
    """Prompts whose text an earlier event of their input shows already: equal texts by their digest, longer ones by containment."""
    e = trace(spark, d, "event_pk", "input_id", "input_order", "event_type", "content").where("content is not null")
    p = e.where("event_type = 'user_prompt'").select("input_id", F.col("event_pk").alias("prompt_pk"), F.col("input_order").alias("at"), F.col("content").alias("prompt"))
    j = p.join(e.select("input_id", "input_order", "content"), "input_id").where("input_order < at").where(D.leaks(F.col("prompt"), F.col("content")))
    return j.groupBy("prompt_pk").agg(F.count("*").alias("shown_before"))


def named_symbols(spark, d):
    """Definitions of an artifact that its own input's trace names, by the symbol's last part."""
    from ..operators import code

    defs = code.definitions(table(spark, d, "repo_artifacts")).join(R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id"), "artifact_id")
    names = defs.select("input_id", F.element_at(F.split("symbol", r"\."), -1).alias("name")).distinct()
    words = trace(spark, d, "event_pk", "input_id", "content").select("event_pk", "input_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w{3,})\b"), F.lit(1)))).alias("name"))
    return words.join(names, ["input_id", "name"]).groupBy("input_id", "name").agg(F.count("*").alias("events"))


def covered_spans(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("bigint").alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("bigint").alias("b"), F.lit(80).cast("bigint").alias("n"))
    return D.covered(li, "l_orderkey", "a", "b", "n")


def outermost_spans(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("bigint").alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("bigint").alias("b"))
    return D.drop_contained(li, ["l_orderkey"], "a", "b")


def latest_shown_lines(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "content").select("event_pk", "input_id", "input_order", F.explode(F.split("content", "\n", -1)).alias("line")).where("length(trim(line)) > 20")
    f = D.first_seen_lines(e.groupBy("input_id", "input_order", "line").agg(F.count("*").alias("n")), ["input_id"], "input_order", "line")
    return f.groupBy("input_id").agg(F.count("*").alias("distinct_lines"))


def review_gaps(spark, d):
    g = R.once(table(spark, d, "gold_conditions"), "gold_id", "gold_source").where("gold_source is not null").withColumnRenamed("gold_source", "reviewer")
    sides = [g.select("gold_id").distinct(), g.select("reviewer").distinct()]
    return V.missing_cells(sides, g, ["gold_id", "reviewer"]).groupBy("reviewer").agg(F.count("*").alias("missing"))


def snippet_shards(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "input_id", "content").where("content is not null").select("artifact_id", "input_id", T.token_estimate(F.col("content")).alias("tokens"))
    return V.next_fit(a, "input_id", "artifact_id", "tokens", 3072).groupBy("input_id").agg(F.max("shard_no").alias("shards"), F.sum("tokens").alias("tokens"))


def coverage_order(spark, d):
    """Files of each gold record in the order in which they cover its evidence."""
    from ..operators import nested

    r = nested.flat(table(spark, d, "gold_conditions"), "range").where("path is not null").select("gold_id", "path", F.concat_ws(":", "field", "evidence_no").alias("member"), F.lit(1.0).alias("weight")).distinct()
    return V.greedy_coverage(r, "gold_id", "path", "member", "weight")


def read_later(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "turn_number", "event_type", "tool_name")
    shown = e.where("event_type = 'tool_exchange' and tool_name = 'Grep'").select("input_id", "turn_number", "event_pk")
    read = e.where("event_type = 'tool_exchange' and tool_name = 'Read'").select("input_id", "turn_number")
    return V.selected_later(shown, read, ["input_id"], "turn_number").select("event_pk", "selected_later")


def result_anchors(spark, d):
    return X.anchors(table(spark, d, "repo_artifacts")).groupBy("kind").agg(F.count("*").alias("anchors"), F.sum(F.size("depends_on")).alias("slice_lines"))


def behavior_rows(spark, d):
    return X.behaviors(X.anchors(table(spark, d, "repo_artifacts"))).select("artifact_id", "symbol", "behavior_no", "result_line", "kind")


def ranges_in_files(spark, d):
    """Gold line ranges with whether they lie within the file of their path in their input."""
    from ..operators import nested

    g = nested.flat(table(spark, d, "gold_conditions"), "range").where("field = 'location_targets' and path is not null")
    r = g.join(R.once(table(spark, d, "gold_conditions"), "gold_id", "input_id"), "gold_id").select("input_id", "path", F.col("line_start").alias("a"), F.col("line_end").alias("b")).distinct()
    a = R.once(table(spark, d, "repo_artifacts"), "input_id", "path", "content").where("content is not null").select("input_id", "path", F.lit(1).cast("bigint").alias("a"), F.size(F.split("content", "\n", -1)).cast("bigint").alias("b"))
    return V.covered_ranges(r, a, ["input_id", "path"], "a", "b").groupBy("inside").agg(F.count("*").alias("ranges"))


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def oracle_sql():
    li = "(SELECT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS a, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS b FROM lineitem)"
    return {
        "covered_spans": f"""WITH u AS (SELECT DISTINCT l_orderkey, unnest(range(a, b)) AS x FROM {li}), o AS (SELECT DISTINCT l_orderkey FROM lineitem)
            SELECT o.l_orderkey, count(u.x) AS covered_chars, count(u.x) >= 80 AS full FROM o LEFT JOIN u ON u.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey""".replace("AS full", 'AS "full"'),
        "outermost_spans": f"""WITH s AS (SELECT DISTINCT * FROM {li}) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.l_orderkey = s.l_orderkey AND t.a <= s.a AND t.b >= s.b AND (t.a < s.a OR t.b > s.b))""",
        "latest_shown_lines": f"""SELECT input_id, count(DISTINCT line) AS distinct_lines FROM (SELECT input_id, unnest(string_split(content, chr(10))) AS line FROM {_TE}) WHERE length(trim(line, ' ')) > 20 GROUP BY input_id""",
        "review_gaps": """WITH g AS (SELECT DISTINCT gold_id, gold_source AS reviewer FROM gold_conditions WHERE gold_source IS NOT NULL), r AS (SELECT reviewer, count(*) AS have FROM g GROUP BY reviewer), n AS (SELECT count(DISTINCT gold_id) AS n FROM g)
            SELECT reviewer, n - have AS missing FROM r, n WHERE n > have""",
        "read_later": """WITH e AS (SELECT DISTINCT event_pk, input_id, turn_number, event_type, tool_name FROM trace_events WHERE event_type = 'tool_exchange')
            SELECT event_pk, EXISTS (SELECT 1 FROM e r WHERE r.tool_name = 'Read' AND r.input_id = s.input_id AND r.turn_number > s.turn_number) AS selected_later FROM e s WHERE tool_name = 'Grep'""",
        "prompt_leaks": rf"""WITH e AS (SELECT DISTINCT event_pk, input_id, input_order, event_type, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS c FROM trace_events WHERE content IS NOT NULL)
            SELECT p.event_pk AS prompt_pk, count(*) AS shown_before FROM e p JOIN e o ON o.input_id = p.input_id AND o.input_order < p.input_order AND (o.c = p.c OR length(p.c) >= 20 AND contains(o.c, p.c)) WHERE p.event_type = 'user_prompt' GROUP BY p.event_pk""",
        "ranges_in_files": """WITH g AS (SELECT DISTINCT gold_id, input_id, location_targets FROM gold_conditions), r AS (SELECT DISTINCT input_id, t.path AS path, t.start_line AS a, coalesce(t.end_line, t.start_line) AS b FROM (SELECT input_id, unnest(flatten(list_filter(location_targets, lambda x: x IS NOT NULL))) AS t FROM g) WHERE t.start_line IS NOT NULL AND t.path IS NOT NULL),
            f AS (SELECT DISTINCT input_id, path, length(content) - length(replace(content, chr(10), '')) + 1 AS n FROM repo_artifacts WHERE content IS NOT NULL)
            SELECT EXISTS (SELECT 1 FROM f WHERE f.input_id = r.input_id AND f.path = r.path AND r.a >= 1 AND r.b <= f.n) AS inside, count(*) AS ranges FROM r GROUP BY 1""",
    }
