"""Queries over ordered sequences, budgets and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..operators import sequence as S
from ..session import table
from .etl import events as trace

_TE = "(SELECT DISTINCT event_pk, input_id, session_id, event_type, turn_number, input_order, content FROM trace_events)"


def asof_previous_event(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = S.asof_previous(e, ["user_id"], [F.col("ts"), F.col("event_id")], {"previous_purchase": F.col("event_id")}, F.col("event_type") == "purchase")
    return out.where("event_type = 'error'").select("event_id", "user_id", "previous_purchase")


def range_window_counts(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    ranked = S.round_robin(e, "user_id", ["ts", "event_id"])
    w = S.asof_windows(ranked, ["user_id"], "k", F.col("event_type") == "purchase", {"clicks": F.col("event_type") == "click", "errors": F.col("event_type") == "error"})
    return w.select("event_id", "user_id", F.col("start_at").cast("bigint").alias("start_at"), "clicks", "errors")


def sessionize_prompts(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "event_type")
    s = S.segments(e, ["input_id"], "input_order", F.col("event_type") == "user_prompt")
    return s.groupBy("input_id", "segment_no").agg(F.count("*").alias("events"), F.max("sequence_index").cast("bigint").alias("last_index"), F.min("event_pk").alias("first_pk"))


def adjacent_precedes(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "turn_number", "session_id")
    return S.precedes(e, ["input_id"], "turn_number", "event_pk").select("input_id", "source", "target", F.col("at").cast("bigint").alias("at"))


def recent_since_last_user(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "event_type")
    out = S.asof_previous(e, ["input_id"], [F.col("input_order")], {"last_user": F.col("input_order")}, F.col("event_type") == "user_prompt")
    return out.where("event_type = 'tool_exchange'").select("event_pk", F.col("last_user").cast("bigint").alias("last_user"), (F.col("input_order") - F.col("last_user")).cast("bigint").alias("distance"))


def monotonic_violations(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "turn_number")
    return S.order_violations(e, ["input_id"], "input_order", "turn_number").select("event_pk", F.col("turn_number").cast("bigint").alias("turn_number"), F.col("previous").cast("bigint").alias("previous"))


def _days(spark, d):
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    return table(spark, d, "events").select("user_id", day.alias("day_start")).distinct().withColumn("day_end", F.col("day_start"))


def islands_merge(spark, d):
    return S.islands(_days(spark, d), ["user_id"], "day_start", "day_end")


def range_complement(spark, d):
    return S.complement(islands_merge(spark, d), ["user_id"], "day_start", "day_end")


def chunk_lines(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "content")
    c = S.line_chunks(a, "content", ["artifact_id"], 40)
    return c.select("artifact_id", *[F.col(x).cast("bigint").alias(x) for x in ("chunk_no", "line_start", "line_end")])


def round_robin_sources(spark, d):
    x = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    return S.round_robin(x, "source", ["doc_id"]).select("doc_id", "source", F.col("k").cast("bigint").alias("k"))


def lane_interleave(spark, d):
    x = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    r = S.round_robin(x, "source", ["doc_id"])
    return r.select("doc_id", "source", ((F.col("k") - 1) % 16).cast("bigint").alias("lane_row"), F.expr("(k - 1) div 16").cast("bigint").alias("lane"))


def budget_prefix(spark, d):
    x = table(spark, d, "documents").where("source is not null").select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return S.budget_prefix(x, ["source"], ["doc_id"], "tokens", 3072).select("doc_id", "source", "tokens", "running_cost")


def budget_skip(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "content").select("event_pk", "input_id", "input_order", T.token_estimate(F.col("content")).alias("tokens"))
    return S.budget_skip(e, "input_id", "input_order", "tokens", 3072)


def head_tail_view(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order", "content").select("event_pk", "input_id", "input_order", T.token_estimate(F.col("content")).alias("tokens"))
    return S.head_tail(e, "input_id", "input_order", "tokens", 2048)


def tertile_bins(spark, d):
    x = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", "source").where("source is not null")
    return S.tertiles(x, ["n_chars", "doc_id"], ["source"]).groupBy("source", "bin").agg(F.count("*").alias("documents"), F.max("n_chars").alias("most_chars"))


def capped_per_repository(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "repo_id", "path")
    return S.capped(a, ["repo_id"], [F.col("path"), F.col("artifact_id")], 5).select("artifact_id", "repo_id", F.col("rank_in_group").cast("bigint").alias("rank_in_group"))


def timeline_page(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "input_order")
    p = S.page(e, ["input_id"], [F.col("input_order"), F.col("event_pk")], 10, 10)
    return p.select("event_pk", *[F.col(c).cast("bigint").alias(c) for c in ("item_no", "total", "next_offset")])


def topk_tiered_search(spark, d):
    """The 12 best hits for a query: equal path, path part, then number of its words in the text."""
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "path", "content").where("content is not null")
    low = F.lower("content")
    n = sum(low.contains(w).cast("int") for w in ("cursor", "payload", "ledger"))
    tier = F.when(F.lower("path") == "cursor", 0).when(F.lower("path").contains("cursor"), 1).when(n == 3, 2).when(n > 0, 3)
    return a.select("artifact_id", "path", tier.cast("bigint").alias("tier"), n.cast("bigint").alias("words_found")).where("tier is not null").orderBy("tier", F.desc("words_found"), "artifact_id").limit(12)


def case_event_order(spark, d):
    e = trace(spark, d, "event_pk", "input_id", "turn_number", "event_type")
    rank = F.when(F.col("event_type") == "system", 0).when(F.col("event_type") == "user_prompt", 1).when(F.col("event_type") == "assistant_response", 2).otherwise(3)
    e = e.withColumn("type_rank", rank)
    return S.round_robin(e, "input_id", ["turn_number", "type_rank", "event_pk"]).select("event_pk", F.col("k").cast("bigint").alias("place"))


def group_hints(spark, d):
    a = R.once(table(spark, d, "repo_artifacts"), "artifact_id", "repo_id", "path")
    g = a.where("path like '%/%'").groupBy("repo_id", F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("files"))
    return S.capped(g, ["repo_id"], [F.desc("files"), F.col("folder")], 3).select("repo_id", "folder", "files", F.col("rank_in_group").cast("bigint").alias("place"))


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def oracle_sql():
    days = "(SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events)"
    isl = f"(SELECT user_id, min(day) AS day_start, max(day) AS day_end, count(*) AS merged FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM {days}) GROUP BY user_id, g)"
    rank = "CASE event_type WHEN 'system' THEN 0 WHEN 'user_prompt' THEN 1 WHEN 'assistant_response' THEN 2 ELSE 3 END"
    docs = "(SELECT doc_id, source, (coalesce(strlen(text), 0) + 2) // 3 AS tokens FROM documents WHERE source IS NOT NULL)"
    art = "(SELECT DISTINCT artifact_id, repo_id, path FROM repo_artifacts)"
    skip = f"""WITH RECURSIVE e AS (SELECT event_pk, input_id, input_order, (coalesce(strlen(content), 0) + 2) // 3 AS tokens, row_number() OVER (PARTITION BY input_id ORDER BY input_order) AS i FROM {_TE}),
        w AS (SELECT event_pk, input_id, input_order, tokens, i, tokens <= 3072 AS fits, 3072 - CASE WHEN tokens <= 3072 THEN tokens ELSE 0 END AS room FROM e WHERE i = 1
              UNION ALL SELECT e.event_pk, e.input_id, e.input_order, e.tokens, e.i, e.tokens <= w.room, w.room - CASE WHEN e.tokens <= w.room THEN e.tokens ELSE 0 END FROM w JOIN e ON e.input_id = w.input_id AND e.i = w.i + 1)
        SELECT event_pk, input_id, input_order, tokens FROM w WHERE fits"""
    return {
        "budget_skip": skip,
        "head_tail_view": f"""SELECT event_pk, input_id, input_order, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY input_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM
            (SELECT event_pk, input_id, input_order, (coalesce(strlen(content), 0) + 2) // 3 AS tokens, least(2 * row_number() OVER (PARTITION BY input_id ORDER BY input_order) - 1, 2 * row_number() OVER (PARTITION BY input_id ORDER BY input_order DESC)) AS turn FROM {_TE})) WHERE spent <= 2048""",
        "asof_previous_event": """SELECT e.event_id, e.user_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR p.ts = e.ts AND p.event_id < e.event_id)
            ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS previous_purchase FROM events e WHERE e.event_type = 'error'""",
        "range_window_counts": """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
            t AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY k) AS start_at FROM r WHERE event_type = 'purchase')
            SELECT t.event_id, t.user_id, t.start_at, count(e.k) FILTER (WHERE e.event_type = 'click') AS clicks, count(e.k) FILTER (WHERE e.event_type = 'error') AS errors
            FROM t LEFT JOIN r e ON e.user_id = t.user_id AND e.k >= t.start_at AND e.k < t.k GROUP BY ALL""",
        "sessionize_prompts": f"""SELECT input_id, segment_no, count(*) AS events, count(*) AS last_index, min(event_pk) AS first_pk FROM (SELECT *, CAST(count(*) FILTER (WHERE event_type = 'user_prompt')
            OVER (PARTITION BY input_id ORDER BY input_order) AS BIGINT) AS segment_no FROM {_TE}) WHERE segment_no > 0 GROUP BY ALL""",
        "adjacent_precedes": f"""WITH p AS (SELECT input_id, turn_number, count(*) AS n, min(event_pk) AS t FROM {_TE} GROUP BY ALL),
            q AS (SELECT *, lead(n) OVER w AS n2, lead(t) OVER w AS t2 FROM p WINDOW w AS (PARTITION BY input_id ORDER BY turn_number))
            SELECT input_id, t AS source, t2 AS target, CAST(turn_number AS BIGINT) AS at FROM q WHERE n = 1 AND n2 = 1""",
        "recent_since_last_user": f"""SELECT event_pk, CAST(last_user AS BIGINT) AS last_user, CAST(input_order - last_user AS BIGINT) AS distance FROM (SELECT *, max(CASE WHEN event_type = 'user_prompt' THEN input_order END)
            OVER (PARTITION BY input_id ORDER BY input_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM {_TE}) WHERE event_type = 'tool_exchange'""",
        "monotonic_violations": f"""SELECT event_pk, CAST(turn_number AS BIGINT) AS turn_number, CAST(previous AS BIGINT) AS previous FROM (SELECT *, lag(turn_number) OVER (PARTITION BY input_id ORDER BY input_order) AS previous FROM {_TE}) WHERE turn_number < previous""",
        "islands_merge": f"SELECT user_id, day_start, day_end, merged FROM {isl}",
        "range_complement": f"SELECT user_id, prev + 1 AS gap_start, day_start - 1 AS gap_end FROM (SELECT *, lag(day_end) OVER (PARTITION BY user_id ORDER BY day_start) AS prev FROM {isl}) WHERE prev IS NOT NULL",
        "chunk_lines": """WITH a AS (SELECT DISTINCT artifact_id, content FROM repo_artifacts WHERE content IS NOT NULL), n AS (SELECT artifact_id, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n FROM a),
            c AS (SELECT artifact_id, n, unnest(range(0, (n + 39) // 40)) AS i FROM n)
            SELECT artifact_id, CAST(i + 1 AS BIGINT) AS chunk_no, CAST(i * 40 + 1 AS BIGINT) AS line_start, CAST(least(i * 40 + 40, n) AS BIGINT) AS line_end FROM c""",
        "round_robin_sources": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL",
        "lane_interleave": "SELECT doc_id, source, (k - 1) % 16 AS lane_row, (k - 1) // 16 AS lane FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL)",
        "budget_prefix": f"SELECT doc_id, source, tokens, running_cost FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cost FROM {docs}) WHERE running_cost <= 3072",
        "tertile_bins": """SELECT source, bin, count(*) AS documents, max(n_chars) AS most_chars FROM (SELECT source, n_chars, CASE WHEN i < n // 3 THEN 'small' WHEN i < 2 * n // 3 THEN 'medium' ELSE 'large' END AS bin FROM
            (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL)) GROUP BY ALL""",
        "capped_per_repository": f"SELECT artifact_id, repo_id, k AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, artifact_id) AS k FROM {art}) WHERE k <= 5",
        "timeline_page": f"""SELECT event_pk, k AS item_no, total, CAST(CASE WHEN total > 20 THEN 20 END AS BIGINT) AS next_offset FROM (SELECT event_pk, row_number() OVER (PARTITION BY input_id ORDER BY input_order, event_pk) AS k,
            count(*) OVER (PARTITION BY input_id) AS total FROM {_TE}) WHERE k BETWEEN 11 AND 20""",
        "topk_tiered_search": """SELECT artifact_id, path, tier, words_found FROM (SELECT artifact_id, path, CAST(n AS BIGINT) AS words_found, CAST(CASE WHEN lower(path) = 'cursor' THEN 0 WHEN contains(lower(path), 'cursor') THEN 1 WHEN n = 3 THEN 2 WHEN n > 0 THEN 3 END AS BIGINT) AS tier
            FROM (SELECT DISTINCT artifact_id, path, CAST(contains(lower(content), 'cursor') AS INT) + CAST(contains(lower(content), 'payload') AS INT) + CAST(contains(lower(content), 'ledger') AS INT) AS n FROM repo_artifacts WHERE content IS NOT NULL))
            WHERE tier IS NOT NULL ORDER BY tier, words_found DESC, artifact_id LIMIT 12""",
        "case_event_order": f"SELECT event_pk, row_number() OVER (PARTITION BY input_id ORDER BY turn_number, {rank}, event_pk) AS place FROM {_TE}",
        "group_hints": f"""SELECT repo_id, folder, files, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, folder) AS place FROM (SELECT repo_id, split_part(path, '/', 1) AS folder, count(*) AS files FROM {art} WHERE contains(path, '/') GROUP BY ALL)) WHERE place <= 3""",
    }
