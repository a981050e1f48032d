"""Table-valued text operators: sections, demands, paragraphs, paths in patches and shell lines, spans."""

from __future__ import annotations

import difflib
import json
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings of code files; fixed values.
CODE = tuple(".py .js .mjs .jsx .ts .tsx .java .go .rs .rb .php .c .h .cc .cpp .hpp .cs .swift .kt .scala .lua .sh .sql".split())


def _table(df: DataFrame, key: str, text: str, columns: str, rows_of) -> DataFrame:
    """(key, *columns): the rows that rows_of gives for each non-null text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) for r in rows_of(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInPandas(run, f"{key} {kind}, {columns}")


def sections_of(text):
    """(order, level, title, first line, last line, heading path) of a Markdown text; fences hold no headings."""
    lines, out, fence = text.split("\n"), [], False
    for i, x in enumerate(lines, 1):
        if x.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (m := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", x)):
            if out:
                out[-1][3] = i - 1
            out.append([len(m[1]), m[2], i, len(lines)])
    path, rows = [], []
    for k, (level, title, a, b) in enumerate(out, 1):
        path = [*[p for p in path if p[0] < level], (level, title)]
        rows.append((k, level, title, a, b, " > ".join(t for _, t in path)))
    return rows


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    return _table(df, key, text, "section_no bigint, level bigint, title string, line_start bigint, line_end bigint, heading_path string", sections_of)


_BULLET = re.compile(r"(?m)^([ \t]*)(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+")
_QUESTION = re.compile(r"[^.!?。！？\n]+[?？]")


def demands_of(text):
    """Spans of separate demands: the outermost list items if there are two, else the questions if there are two, else none."""
    marks = [(m.start(), m.end(), len(m[1].expandtabs(4))) for m in _BULLET.finditer(text)]
    if marks:
        outer = min(n for *_, n in marks)
        marks = [m for m in marks if m[2] == outer]
    if len(marks) > 1:
        ends = [m[0] for m in marks[1:]] + [len(text)]
        found = [(b + len(text[b:e]) - len(text[b:e].lstrip()), b + len(text[b:e].rstrip())) for (_, b, _), e in zip(marks, ends)]
        found = [(a, b) for a, b in found if a < b]
        if len(found) > 1:
            return [(i, a, b) for i, (a, b) in enumerate(found, 1)]
    asked = [m.span() for m in _QUESTION.finditer(text)]
    return [(i, a, b) for i, (a, b) in enumerate(asked, 1)] if len(asked) > 1 else []


def demands(df: DataFrame, key: str, text: str) -> DataFrame:
    return _table(df, key, text, "demand_no bigint, char_start bigint, char_end bigint", demands_of)


def paragraphs_of(text):
    """(number, kind, start, end): fenced blocks whole, other text by blank lines."""
    out, at = [], 0
    for m in re.finditer(r"(?ms)^[ \t]*```.*?^[ \t]*```[^\n]*$|\Z", text):
        for p in re.finditer(r"\S(?:.*?\S)??(?=\s*?\n[ \t]*\n|\s*\Z)", text[at : m.start()], re.S):
            out.append(("text", at + p.start(), at + p.end()))
        if m.end() > m.start():
            out.append(("code", m.start(), m.end()))
        at = m.end()
    return [(i, *x) for i, x in enumerate(out, 1)]


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    return _table(df, key, text, "paragraph_no bigint, kind string, char_start bigint, char_end bigint", paragraphs_of)


def patch_paths_of(text):
    """(verb, path) of the file headers of unified and apply-style patches."""
    out = []
    for x in text.split("\n"):
        if m := re.match(r"\*\*\* (Add|Update|Delete) File: (.+)$", x):
            out.append((m[1].lower(), m[2].strip()))
        elif m := re.match(r"\+\+\+ (?:\"?b/)?([^\"\t]+)\"?", x):
            if m[1].strip() != "/dev/null":
                out.append(("update", m[1].strip()))
    return sorted(set(out))


def patch_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    return _table(df, key, text, "verb string, path string", patch_paths_of)


#: Commands whose operands are files, and shell syntax that makes a line unreadable without running it; fixed values.
READERS = frozenset("cat head tail less sed wc nl stat file diff python python3 node bash sh pytest ruff touch rm cp mv".split())
UNSAFE = re.compile(r"[`*?\[\]{}<>$]|\|\||&&|[;|&]")


def shell_paths_of(line):
    """(status, path) of the code files a plain command names; anything that needs a shell to be understood is refused."""
    if UNSAFE.search(line):
        return [("refused", None)]
    try:
        words = shlex.split(line)
    except ValueError:
        return [("refused", None)]
    if not words or words[0] not in READERS:
        return [("not_a_file_command", None)]
    found = sorted({w for w in words[1:] if not w.startswith("-") and w.endswith(CODE) and ".." not in w.split("/")})
    return [("ok", w) for w in found] or [("no_path", None)]


def shell_paths(df: DataFrame, key: str, line: str) -> DataFrame:
    return _table(df, key, line, "status string, path string", shell_paths_of)


def json_leaves_of(text):
    """(pointer, value as text) of every leaf of a JSON text; other text has none."""
    try:
        top = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out, todo = [], [("", top)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{at}/{i}", v) for i, v in enumerate(x)]
        else:
            out.append((at, x if isinstance(x, str) else json.dumps(x)))
    return sorted(out)


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    return _table(df, key, text, "pointer string, leaf string", json_leaves_of)


def delete_spans(text, quotes, most=0.3):
    """The text without the quotes, each of which must occur once and none overlap another; None if not so or if more than ``most`` would go."""
    spans = []
    for q in quotes:
        at = text.find(q)
        if not q or at < 0 or text.find(q, at + 1) >= 0:
            return None
        spans.append((at, at + len(q)))
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])) or sum(b - a for a, b in spans) > most * len(text):
        return None
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def map_lines(old, new):
    """{old line: new line} of the lines that two versions share, from their equal blocks."""
    m = difflib.SequenceMatcher(None, old.split("\n"), new.split("\n"), autojunk=False)
    return {a + i + 1: b + i + 1 for a, b, n in m.get_matching_blocks() for i in range(n)}


def leaks(target: Column, content: Column, least: int = 20) -> Column:
    """Whether a content shows the target: equal, or holding it if it is long enough; case and white space aside."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    t, c = norm(target), norm(content)
    return F.coalesce((t == c) | ((F.length(t) >= least) & F.contains(c, t)), F.lit(False))


def mentions(text: Column, name: Column) -> Column:
    """Whether a text names a symbol as a whole word; metacharacters of the name are taken literally."""
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\w.])"), quoted, F.lit(r"(?![\w])")))


def covered(df: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Per record the characters that its spans cover together, and whether that is all of it."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.lit(0))), F.lit(0))
    return df.withColumn("_new", new).groupBy(key).agg(F.sum("_new").alias("covered_chars"), (F.sum("_new") >= F.max(length)).alias("full"))


def drop_contained(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans without those inside an earlier or longer one of their group."""
    w = Window.partitionBy(*by).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.dropDuplicates([*by, start, end]).withColumn("_far", F.max(end).over(w)).where(F.col("_far").isNull() | (F.col(end) > F.col("_far"))).drop("_far")


def first_seen_lines(df: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Each line once a group, where it is first shown."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, line).orderBy(order))).where("_n = 1").drop("_n")
