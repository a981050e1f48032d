"""Agent-trace operators: tool exchanges, references, task assignment, windows before a cutoff."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EVENT = ["event_pk", "input_id", "session_id", "repo_id", "event_type", "turn_number", "input_order", "content", "evidence_id", "tool_name"]
#: Tools and the keys of their input that hold paths; fixed values.
PATH_KEYS = {"Read": ["file_path"], "Write": ["file_path"], "Edit": ["file_path"], "Glob": ["pattern", "path"], "Grep": ["path"]}


def before_cutoff(events: DataFrame, bundles: DataFrame) -> DataFrame:
    """Events of bundles, without those at or after their bundle's cutoff turn; a bundle without a cutoff keeps all."""
    cut = bundles.groupBy("input_id").agg(F.min("cutoff_turn").alias("cutoff_turn"))
    return events.join(cut, "input_id").where(F.col("cutoff_turn").isNull() | (F.col("turn_number") < F.col("cutoff_turn"))).drop("cutoff_turn")


def tool_paths(events: DataFrame) -> DataFrame:
    """Repository paths named in the input of tools that take them, with the key; the tool's own name counts where the event has none."""
    x = events.where("event_type = 'tool_exchange'").withColumn("_in", T.tool_input(F.col("content")))
    x = x.withColumn("tool", F.coalesce("tool_name", F.get_json_object("_in", "$.tool")))
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("key"), F.get_json_object("_in", f"$.input.{k}").alias("raw")) for t, ks in PATH_KEYS.items() for k in ks])
    found = x.select("event_pk", "input_id", "tool", F.explode(F.filter(pairs, lambda p: (p["t"] == F.col("tool")) & p["raw"].isNotNull())).alias("p"))
    out = found.select("event_pk", "input_id", "tool", F.col("p.key").alias("path_key"), T.clean_path(F.col("p.raw")).alias("path"))
    return out.where("path is not null").distinct()


def signals(events: DataFrame) -> DataFrame:
    """Each event's tool operation and topic words (of a tool exchange: of its invocation)."""
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    op = F.when(tool.isin("write", "edit"), "modify").when(tool.isin("read", "glob", "grep"), "inspect").when(F.col("event_type") == "tool_exchange", "execute")
    return events.select("event_pk", "input_id", "event_type", op.alias("operation"), T.words(T.invocation(F.col("content"))).alias("terms"))


def reference_edges(events: DataFrame) -> DataFrame:
    """Events that name an explicit typed id, with the last earlier event whose output holds it, if one task (turn) only produced it."""
    keyed = events.select("input_id", "input_order", "turn_number", "event_type", "content")
    result = F.when(F.col("event_type") == "assistant_response", F.col("content")).when(F.col("event_type") == "tool_exchange", F.regexp_extract("content", r"(?s)Tool result:(.*)$", 1))
    made = keyed.select("input_id", F.col("input_order").alias("made_at"), F.col("turn_number").alias("owner"), F.explode(T.typed_keys(result)).alias("key"))
    used = keyed.where("event_type <> 'assistant_response'").select("input_id", F.col("input_order").alias("used_at"), F.col("turn_number").alias("task"), F.explode(T.typed_keys(T.invocation(F.col("content")))).alias("key"))
    j = used.join(made, ["input_id", "key"]).where("made_at < used_at")
    one = j.groupBy("input_id", "key", "used_at", "task").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("owner"), F.max("made_at").alias("made_at"))
    return one.where("owners = 1 and owner <> task").select("input_id", "key", "task", "owner", "used_at", "made_at")


_FOLLOW = re.compile(r"(?i)^(?:yes|no|ok(?:ay)?|sure|right|continue|proceed|go on|next|also|and|then|thanks?)\b")
TASKS = "event_pk bigint, input_id string, task_no bigint, sequence_index bigint, rule string"


def assign_tasks(events: DataFrame, recent: int = 3, share: float = 2 / 3) -> DataFrame:
    """Every event's task. A user prompt goes on with the current task if it opens like a follow-up, with an
    earlier task if it names one of its objects or shares two thirds of its words with one of its last prompts, and
    else starts a new one; other events follow the prompt before them. Events before the first prompt have no row.

    The decision depends on all tasks before it, so each input is one sequential pass; inputs are bounded sessions."""
    thing = re.compile(r"`([^`\n]{2,120})`|((?:[\w.\-]+/)+[\w.\-]+)|\b(\w+_\w+)\b")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, tasks, current, counts = [], [], None, {}
        for key, kind, content in g.sort_values(["input_order", "event_pk"])[["event_pk", "event_type", "content"]].itertuples(index=False):
            rule = "follows_prompt"
            if kind == "user_prompt":
                content = content or ""
                objects = {next(x for x in m if x).lower() for m in thing.findall(content)}
                terms = {w for w in re.findall(r"[a-z0-9_]{3,}", content.lower())} - set(T.STOP)
                hits = [i for i, t in enumerate(tasks) if objects & t["objects"]]
                like = [i for i, t in enumerate(tasks) if any(terms and len(terms & s) >= share * min(len(terms), len(s) or 1) for s in t["last"])]
                if current is not None and _FOLLOW.match(content.strip()):
                    rule = "follow_up"
                elif len(hits) == 1:
                    current, rule = hits[0], "shared_object"
                elif len(like) == 1:
                    current, rule = like[0], "shared_terms"
                else:
                    tasks.append({"objects": set(), "last": []})
                    current, rule = len(tasks) - 1, "new_task"
                tasks[current]["objects"] |= objects
                tasks[current]["last"] = [*tasks[current]["last"], terms][-recent:]
            if current is None:
                continue
            counts[current] = counts.get(current, 0) + 1
            rows.append((key, g["input_id"].iloc[0], current + 1, counts[current], rule))
        return pd.DataFrame(rows, columns=["event_pk", "input_id", "task_no", "sequence_index", "rule"])

    return events.select("event_pk", "input_id", "event_type", "input_order", "content").groupBy("input_id").applyInPandas(run, TASKS)


def strict_json(text: str):
    """The object of a JSON text, or None: repeated keys, NaN and values that are no object are refused."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def no(name):
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=once, parse_constant=no)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def read_again(events: DataFrame) -> DataFrame:
    """The last event of every (input, path) among those that name it: latest wins."""
    p = tool_paths(events).join(events.select("event_pk", "input_order"), "event_pk")
    w = Window.partitionBy("input_id", "path").orderBy(F.desc("input_order"), F.desc("event_pk"))
    return p.withColumns({"_n": F.row_number().over(w), "mentions": F.count("*").over(Window.partitionBy("input_id", "path"))}).where("_n = 1").select("input_id", "path", "event_pk", "mentions")
