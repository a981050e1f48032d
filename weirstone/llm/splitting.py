"""Problem 3: oversized items cut at natural boundaries.

Recursive bisection: a text longer than ``max_chars - overlap_chars`` is cut at
the strongest boundary near its midpoint, the halves are cut again while they
are too long, and then each piece but the first gets the overlap_chars
characters before it.  Every piece is within max_chars; the pieces without
their overlaps join to the text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; a cut falls at a match's end.
LEVELS = [
    re.compile(r"\n[ \t]*\r?\n(?=(?:#{1,6} |```|(?:async |export |public |private |static )*(?:def|class|func|function|module|interface|struct)\b))"),
    re.compile(r"\n[ \t]*\r?\n(?:[ \t]*\r?\n)*"),
    re.compile(r"\n(?=[^\s)}\]])"),
    re.compile(r"\n"),
    re.compile(r"[.!?]['\")\]]*\s+|[。！？।؟][”』」）]*"),
    re.compile(r"[;,:、，；]\s*|\s+"),
]
_SCHEMA = "item_table string, item_id bigint, piece_no bigint, n_pieces bigint, core_start bigint, char_start bigint, char_end bigint, piece string"


def cuts(text, room):
    """Ends of the cores: positions that cut text into parts of at most room characters."""
    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            out.append(hi)
            continue
        at = _cut(text, lo, hi)
        todo += [(at, hi), (lo, at)]
    return out


def _cut(text, lo, hi):
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    a, b = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
    for level in LEVELS:
        best = None
        for m in level.finditer(text, max(lo, a - 2), b):
            e = m.end()
            if a <= e <= b and (best is None or abs(e - mid) < abs(best - mid)):
                best = e
        if best is not None:
            return best
    at = mid
    while at > a and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def pieces(text, max_chars, overlap_chars):
    """[(core start, start, end)] of the pieces; text[start:end] is a piece."""
    if len(text) <= max_chars:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap_chars, max_chars - 1))
    ends = cuts(text, max_chars - overlap)
    starts = [0, *ends[:-1]]
    return [(s, max(0, s - overlap) if i else 0, e) for i, (s, e) in enumerate(zip(starts, ends))]


def _split(batches):
    for b in batches:
        rows = []
        for table, key, text, most, overlap in zip(b.item_table, b.item_id, b.content, b.max_chars, b.overlap_chars):
            parts = pieces(text, int(most), int(overlap))
            rows += [(table, key, i + 1, len(parts), c, s, e, text[s:e]) for i, (c, s, e) in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["item_table", "item_id", "piece_no", "n_pieces", "core_start", "char_start", "char_end", "piece"])


def items(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Both tables' contents as (item_table, item_id, content), in the rows as delivered; null ids or contents give none."""
    a = artifacts.select(F.lit("repo_artifacts").alias("item_table"), F.col("artifact_id").alias("item_id"), "content")
    e = events.select(F.lit("trace_events").alias("item_table"), F.col("event_pk").alias("item_id"), "content")
    return a.unionByName(e).where(F.col("item_id").isNotNull() & F.col("content").isNotNull())


def split(some: DataFrame, limits: DataFrame, whole: bool = True) -> DataFrame:
    """Pieces of every item: piece_no from 1, n_pieces, core_start, char_start, char_end, piece.

    Items of a table without a limit give no row. An item within its limit is one
    piece, made without Python (left out if not whole). A limit of at most the
    overlap shrinks the overlap. One of several deliveries of an item is taken.
    limits is a table of a few rows; its size does not depend on the items."""
    lim = F.broadcast(limits.select("item_table", "max_chars", "overlap_chars").dropDuplicates(["item_table"]))
    known = some.join(lim, "item_table").where("max_chars > 0")
    long = known.where(F.length("content") > F.col("max_chars")).dropDuplicates(["item_table", "item_id"])
    out = long.mapInPandas(_split, _SCHEMA)
    if not whole:
        return out
    fits = known.where(F.length("content") <= F.col("max_chars"))
    again = fits.groupBy("item_table", "item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_table", "item_id")
    # only what was delivered more than once is shuffled with its content
    short = fits.join(again, ["item_table", "item_id"], "left_anti").unionByName(fits.join(again, ["item_table", "item_id"], "left_semi").dropDuplicates(["item_table", "item_id"]))
    one, n = F.lit(1).cast("bigint"), F.length("content").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return out.unionByName(
        short.select("item_table", "item_id", one.alias("piece_no"), one.alias("n_pieces"), zero.alias("core_start"), zero.alias("char_start"), n.alias("char_end"), F.col("content").alias("piece"))
    )


def limits(parts: DataFrame, some: DataFrame, lim: DataFrame) -> DataFrame:
    """By table: items with content, items above the limit, and how often a rule is broken: pieces above max_chars,
    pieces that do not share overlap_chars with the one before, items whose pieces do not join to their text."""
    small = F.broadcast(lim.select("item_table", F.col("max_chars").cast("bigint").alias("max_chars"), F.col("overlap_chars").cast("bigint").alias("overlap_chars")).dropDuplicates(["item_table"]))  # a few rows
    room = F.least(F.col("overlap_chars"), F.col("core_start"))
    core = F.expr("substring(piece, cast(core_start - char_start + 1 as int), cast(char_end - core_start as int))")
    seen = parts.join(small, "item_table").withColumns({"over": (F.length("piece") > F.col("max_chars")).cast("bigint"), "apart": ((F.col("piece_no") > 1) & (F.col("core_start") - F.col("char_start") != room)).cast("bigint"), "core": F.struct("piece_no", core.alias("core"))})
    per = seen.groupBy("item_table", "item_id").agg(F.max("n_pieces").alias("n"), F.sum("over").alias("over"), F.sum("apart").alias("apart"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("core")), lambda c: c["core"]), "").cast("binary")).alias("joined"))
    texts = some.join(small, "item_table").groupBy("item_table", "item_id").agg(F.min(F.md5(F.col("content").cast("binary"))).alias("text"), F.max(F.length("content")).alias("chars"), F.max("max_chars").alias("max_chars"))
    both = texts.join(per, ["item_table", "item_id"], "left")
    return both.groupBy("item_table").agg(
        F.count("*").alias("items"), F.count_if(F.col("chars") > F.col("max_chars")).alias("long_items"), F.count_if((F.col("chars") > F.col("max_chars")) & (F.col("n") > 1)).alias("cut_items"),
        F.sum("over").alias("pieces_over"), F.sum("apart").alias("overlaps_off"), F.count_if(~F.col("joined").eqNullSafe(F.col("text"))).alias("texts_changed"),
    )
