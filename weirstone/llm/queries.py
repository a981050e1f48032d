"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut, table
from . import credentials, mixing, packing, provenance, repeats, sentences, splitting, syntax


def _long(c):
    return F.col(c).cast("bigint").alias(c)


def p1_found(spark, d):
    return syntax.syntax(table(spark, d, "repo_artifacts")).where(~F.col("valid")).select("artifact_id")


def p1_syntax(spark, d):
    return syntax.syntax(table(spark, d, "repo_artifacts"))


def p1_rates(spark, d):
    return syntax.rates(syntax.syntax(table(spark, d, "repo_artifacts")))


def p2_found(spark, d):
    return provenance.provenance(table(spark, d, "repo_artifacts")).where(~F.col("handwritten")).select("artifact_id")


def p2_handwritten(spark, d):
    return provenance.provenance(table(spark, d, "repo_artifacts")).where("handwritten").select("artifact_id")


def _items(spark, d):
    return splitting.items(table(spark, d, "repo_artifacts"), table(spark, d, "trace_events"))


def p3_found(spark, d):
    parts = splitting.split(_items(spark, d), table(spark, d, "split_limits"), whole=False)
    return parts.where("n_pieces > 1").select("item_table", "item_id").distinct()


def p3_pieces(spark, d):
    return splitting.split(_items(spark, d), table(spark, d, "split_limits"))


def p3_limits(spark, d):
    """What the pieces must keep to, counted over all items."""
    return splitting.limits(p3_pieces(spark, d), _items(spark, d), table(spark, d, "split_limits"))


def p4_found(spark, d):
    return credentials.found_lines(table(spark, d, "repo_artifacts"), table(spark, d, "trace_events"))


def p4_redacted(spark, d):
    return credentials.redacted(table(spark, d, "repo_artifacts"), table(spark, d, "trace_events"))


def p6_found(spark, d):
    return repeats.named(repeats.sharing(table(spark, d, "repo_artifacts"), table(spark, d, "trace_events"))).select("item_table", "item_id")


def p6_overlap(spark, d):
    return repeats.overlap(table(spark, d, "repo_artifacts"), table(spark, d, "trace_events"))


def p7_pack(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p7_fill(spark, d):
    return packing.fill(p7_pack(spark, d))


def p7_limits(spark, d):
    """What the packing must keep to, counted over all documents."""
    return packing.limits(cut(p7_pack(spark, d)), table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_limits(spark, d):
    """What the mixture must keep to, counted over all uses."""
    return mixing.limits(cut(p8_mix(spark, d)), table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_tempered(spark, d):
    """A mixture half-way, by entropy, from the sources as they are to the targets."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), between=0.5)


def p8_plan(spark, d):
    """The plan of p8_tempered: weights, exponent and entropy."""
    return mixing.planned(table(spark, d, "documents"), table(spark, d, "mix_targets"), between=0.5)


def p9_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


def p9_sentences(spark, d):
    return sentences.sentences(table(spark, d, "documents"), text=True)


def queries():
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql():
    return {
        "p3_found": """
            SELECT DISTINCT 'repo_artifacts' AS item_table, artifact_id AS item_id FROM repo_artifacts, split_limits
            WHERE item_table = 'repo_artifacts' AND length(content) > max_chars
            UNION ALL
            SELECT DISTINCT 'trace_events' AS item_table, event_pk AS item_id FROM trace_events, split_limits
            WHERE item_table = 'trace_events' AND length(content) > max_chars""",
        "p3_limits": """
            WITH items AS (
                SELECT DISTINCT 'repo_artifacts' AS item_table, artifact_id AS item_id, content FROM repo_artifacts WHERE content IS NOT NULL
                UNION ALL
                SELECT DISTINCT 'trace_events', event_pk, content FROM trace_events WHERE content IS NOT NULL)
            SELECT item_table, count(*) AS items, count(*) FILTER (WHERE length(content) > max_chars) AS long_items, count(*) FILTER (WHERE length(content) > max_chars) AS cut_items,
                   0::BIGINT AS pieces_over, 0::BIGINT AS overlaps_off, 0::BIGINT AS texts_changed
            FROM items JOIN split_limits USING (item_table) GROUP BY item_table""",
        "p7_limits": """
            SELECT container_kind, capacity_tokens::BIGINT AS capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents,
                   0::BIGINT AS over_capacity, 0::BIGINT AS not_whole, 0::BIGINT AS split_though_fitting
            FROM pack_capacities""",
        "p8_limits": """
            SELECT source, max_repeats::BIGINT AS max_repeats, count(DISTINCT doc_id) AS documents, 0::BIGINT AS over_repeats, 0::BIGINT AS numbered_twice, 0::BIGINT AS of_another_source
            FROM mix_targets LEFT JOIN (SELECT doc_id, source FROM documents WHERE text <> '') USING (source) GROUP BY ALL""",
    }
