"""Problem 5: deeply nested records as related flat tables.

A depth-first walk gives every node of a record an interval label: ``pre`` on
entering, ``post`` on leaving, from one counter.  Nodes of all types leave the
walk as flat rows; a node's parent of some type is the one whose interval
contains its own, found by a window over the record's nodes in pre-order, so
neither a join nor the original nesting is needed.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAPPINGS = ("condition_by_condition", "holistic_alignment")
#: Spellings of the keys, old and new.
KEYS = {
    "evidence": ("evidence",),
    "locations": ("locations",),
    "ranges": ("line_ranges", "lineRanges"),
    "start": ("start", "start_line", "startLine"),
    "end": ("end", "end_line", "endLine"),
}
_TEXTS = {
    "evidence_id": ("evidence_id", "evidenceId"),
    "evidence_type": ("evidence_type", "evidenceType"),
    "relation": ("relation",),
    "strength": ("strength",),
    "confidence": ("confidence",),
    "path": ("file_path", "filePath", "path"),
    "excerpt": ("excerpt",),
    "explanation": ("explanation", "mapping_explanation", "mappingExplanation"),
    "status": ("mapping_status", "mappingStatus", "status"),
    "coverage": ("coverage",),
    "note": ("note",),
    "route": ("route",),
}
COLUMNS = ["gold_id", "field", "node_type", "pre", "post", "depth", "ordinal", "line_start", "line_end", "symbol", *_TEXTS]
SCHEMA = (
    "gold_id bigint, field string, node_type string, pre bigint, post bigint, depth bigint, ordinal bigint, "
    "line_start bigint, line_end bigint, symbol string, " + ", ".join(f"{c} string" for c in _TEXTS)
)
_NUMBERS = {"gold_id", "pre", "post", "depth", "ordinal", "line_start", "line_end"}
_ARROW = pa.schema([pa.field(c, pa.int64() if c in _NUMBERS else pa.string()) for c in COLUMNS])
_RANGE = re.compile(r"\s*[Ll]?(\d{1,9})\s*(?:[-–:]\s*[Ll]?(\d{1,9}))?\s*\Z")


def _not_json(name):
    raise ValueError(name)


def plain(x):
    """x, or what it says if it is JSON text (again and again)."""
    for _ in range(20):
        if not isinstance(x, str):
            return x
        try:
            x = json.loads(x, parse_constant=_not_json)
        except (ValueError, RecursionError):
            return x
    return x


def _get(d, keys):
    return next((d[k] for k in keys if k in d), None)


def _listed(x):
    """The elements with their numbers from 1; an element standing where a list belongs is number 1."""
    x = plain(x)
    if x is None:
        return []
    return [(i, plain(y)) for i, y in enumerate(x if isinstance(x, list) else [x], 1) if y is not None]


def _line(x):
    x = plain(x)
    if isinstance(x, bool):
        return None
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    return x if isinstance(x, int) and abs(x) < 1 << 62 else None


def line_range(x):
    """(first line, last line) of a range in any of its spellings, or None."""
    if isinstance(x, dict):
        a, b = _get(x, KEYS["start"]), _get(x, KEYS["end"])
    elif isinstance(x, list) and x:
        a, b = x[0], x[1] if len(x) > 1 else None
    elif isinstance(x, str) and (m := _RANGE.match(x)):
        a, b = int(m[1]), m[2] and int(m[2])
    else:
        a, b = x, None
    a, b = _line(a), _line(b)
    return None if a is None else (a, a if b is None else b)


class _Walk:
    def __init__(self, key, field):
        self.key, self.field, self.n, self.rows = key, field, 0, []

    def open(self, kind, depth, ordinal, source=None, lines=(None, None)):
        texts = {}
        if isinstance(source, dict):
            for c, keys in _TEXTS.items():
                v = _get(source, keys)
                texts[c] = v if v is None or isinstance(v, str) else json.dumps(v)
        symbol = source.get("symbol") if isinstance(source, dict) else None
        row = [self.key, self.field, kind, self.n, None, depth, ordinal, *lines, symbol if symbol is None or isinstance(symbol, str) else json.dumps(symbol), *(texts.get(c) for c in _TEXTS)]
        self.n += 1
        self.rows.append(row)
        return row

    def close(self, row):
        row[4] = self.n
        self.n += 1

    def ranges(self, listed):
        for k, z in listed:
            lines = line_range(z)
            if lines:
                self.close(self.open("range", 3, k, z, lines))


def walk_mapping(key, field, value):
    """Node rows of one JSON mapping; a value that is no JSON object gives none."""
    value = plain(value)
    if not isinstance(value, dict):
        return []
    w = _Walk(key, field)
    top = w.open("condition", 0, 1, value)
    for i, ev in _listed(_get(value, KEYS["evidence"])):
        if not isinstance(ev, dict):
            continue
        e = w.open("evidence", 1, i, ev)
        for j, loc in _listed(_get(ev, KEYS["locations"])):
            if isinstance(loc, dict):
                at = w.open("location", 2, j, loc)
                w.ranges(_listed(_get(loc, KEYS["ranges"])))
                w.close(at)
        w.close(e)
    w.close(top)
    return w.rows


def walk_targets(key, value):
    """Node rows of location_targets: each outer element is a target list with one location whose ranges are the inner ones."""
    if value is None:
        return []
    w = _Walk(key, "location_targets")
    top = w.open("condition", 0, 1)
    for i, inner in enumerate(value, 1):
        if inner is None:
            continue
        e = w.open("evidence", 1, i)
        at = w.open("location", 2, 1)
        w.ranges([(k, z) for k, z in enumerate(inner, 1) if z is not None])
        w.close(at)
        w.close(e)
    w.close(top)
    return w.rows


def _nodes(batches):
    for b in batches:
        rows = []
        for record in b.to_pylist():
            for field in MAPPINGS:
                if record[field] is not None:
                    rows += walk_mapping(record["gold_id"], field, record[field])
            rows += walk_targets(record["gold_id"], record["location_targets"])
        columns = list(zip(*rows)) or [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(columns, _ARROW)], schema=_ARROW)


def nodes(conditions: DataFrame) -> DataFrame:
    """One row per node with its interval label; types condition, evidence, location and range.

    Reads gold_id, the two JSON mappings and location_targets. Records without a
    gold_id give none; repeated deliveries count once; null elements keep their
    number but give no node; text that is no JSON gives none."""
    one = conditions.select("gold_id", *MAPPINGS, "location_targets").where("gold_id is not null").dropDuplicates(["gold_id"])
    return one.mapInArrow(_nodes, SCHEMA)


def contained(labelled: DataFrame) -> DataFrame:
    """Adds each node's condition, evidence and location by interval containment: the last
    such node before it in pre-order contains it. A window spans one record's nodes."""
    w = Window.partitionBy("gold_id", "field").orderBy("pre")
    last = lambda kind, what: F.last(F.when(F.col("node_type") == kind, F.col(what)), ignorenulls=True).over(w)
    out = labelled
    for kind in ("condition", "evidence", "location"):
        inside = last(kind, "post") >= F.col("post")
        out = out.withColumns({f"{kind}_pre": F.when(inside, last(kind, "pre")), f"{kind}_no": F.when(inside, last(kind, "ordinal"))})
    return out


def flat(conditions: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type, with the links to the parents that contain its rows."""
    parents = {"condition": [], "evidence": ["condition"], "location": ["condition", "evidence"], "range": ["condition", "evidence", "location"]}[kind]
    own = {
        "condition": ["status", "coverage", "explanation"],
        "evidence": ["evidence_id", "evidence_type", "relation", "strength", "confidence", "explanation"],
        "location": ["path", "symbol", "excerpt"],
        "range": ["line_start", "line_end", "path", "symbol", "status", "note", "route", "evidence_id"],
    }[kind]
    links = [c for p in parents for c in (f"{p}_pre", f"{p}_no")]
    return contained(nodes(conditions)).where(F.col("node_type") == kind).select("gold_id", "field", "pre", "post", "ordinal", *links, *own)


def line_ranges(conditions: DataFrame) -> DataFrame:
    """(gold_id, field, evidence_no, location_no, range_no, line_start, line_end), one row per line range."""
    r = contained(nodes(conditions)).where("node_type = 'range'")
    return r.select("gold_id", "field", "evidence_no", "location_no", F.col("ordinal").alias("range_no"), "line_start", "line_end")
