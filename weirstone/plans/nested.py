"""Queries of the nested-record operator (problem 5)."""

from __future__ import annotations

from ..operators import nested
from ..session import table


def p5_found(spark, d):
    return nested.line_ranges(table(spark, d, "gold_conditions"))


def p5_conditions(spark, d):
    return nested.flat(table(spark, d, "gold_conditions"), "condition")


def p5_evidence(spark, d):
    return nested.flat(table(spark, d, "gold_conditions"), "evidence")


def p5_locations(spark, d):
    return nested.flat(table(spark, d, "gold_conditions"), "location")


def p5_ranges(spark, d):
    return nested.flat(table(spark, d, "gold_conditions"), "range")


def p5_target_ranges(spark, d):
    """The line ranges of location_targets alone, which SQL can walk too."""
    return p5_found(spark, d).where("field = 'location_targets'")


def oracle_sql():
    return {
        "p5_target_ranges": """WITH g AS (SELECT DISTINCT gold_id, location_targets FROM gold_conditions WHERE gold_id IS NOT NULL), o AS (SELECT gold_id, unnest(location_targets) AS x, generate_subscripts(location_targets, 1) AS i FROM g),
            r AS (SELECT gold_id, i, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM o)
            SELECT gold_id, 'location_targets' AS field, i::BIGINT AS evidence_no, 1::BIGINT AS location_no, k::BIGINT AS range_no, t.start_line::BIGINT AS line_start, coalesce(t.end_line, t.start_line)::BIGINT AS line_end FROM r WHERE t.start_line IS NOT NULL""",
    }


def queries():
    return {k: f for k, f in globals().items() if k.startswith("p5_")}
