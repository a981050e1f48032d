"""Queries of source-code analysis and of the event-log stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as X
from ..session import table
from ..streaming import log as L


def code_definitions(spark, d):
    return X.definitions(table(spark, d, "repo_artifacts"))


def code_evidence(spark, d):
    return X.evidence(table(spark, d, "repo_artifacts")).groupBy("kind").agg(F.count("*").alias("records"), F.count_distinct("artifact_id").alias("files"))


def code_calls(spark, d):
    return X.calls(table(spark, d, "repo_artifacts")).groupBy("attribute").agg(F.count("*").alias("calls"), F.count_distinct("callee").alias("names"))


def code_edges(spark, d):
    return X.call_edges(table(spark, d, "repo_artifacts"))


def resolved_calls(spark, d):
    return X.resolved_calls(table(spark, d, "repo_artifacts"))


def event_log_replay(spark, d):
    """The log's outcome for a replay of every delivery: accepted, repeated, conflicting and late rows. A response closes its turn."""
    e = table(spark, d, "trace_events").select("session_id", F.col("turn_number").cast("bigint").alias("turn_number"), F.col("event_pk").cast("string").alias("event_key"), F.md5(F.col("content").cast("binary")).alias("data"), F.col("ingested_at").alias("at"), (F.col("event_type") == "assistant_response").alias("closes"))
    return L.replay(e).groupBy("outcome").agg(F.count("*").alias("events"))


def queries():
    skip = {"queries", "oracle_sql"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}


def oracle_sql():
    return {
        "event_log_replay": """WITH r AS (SELECT session_id AS s, turn_number AS t, event_pk::VARCHAR AS k, md5(content) AS x, ingested_at AS a, event_type = 'assistant_response' AS c FROM trace_events),
            n AS (SELECT *, row_number() OVER w AS n, first_value(x) OVER w AS f FROM r WINDOW w AS (PARTITION BY s, t, k ORDER BY a, x NULLS FIRST)),
            m AS (SELECT *, coalesce(bool_or(c AND n = 1) OVER (PARTITION BY s, t ORDER BY a, k, x NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM n),
            l AS (SELECT *, first_value(closed) OVER (PARTITION BY s, t, k ORDER BY a, x NULLS FIRST) AS late FROM m)
            SELECT CASE WHEN late THEN 'late' WHEN n = 1 THEN 'accepted' WHEN x IS NOT DISTINCT FROM f THEN 'repeated' ELSE 'conflict' END AS outcome, count(*) AS events FROM l GROUP BY 1""",
    }
