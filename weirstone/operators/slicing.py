"""Result anchors of Python scopes and their backward slices by reaching definitions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .code import _parse, _source, python_definitions

SCHEMA = "artifact_id bigint, path string, symbol string, kind string, line bigint, depends_on array<bigint>, guards array<bigint>, external boolean"
#: Names of calls that put something out; fixed values.
OUTPUT = frozenset("print write writelines send emit log info warning error debug exception append put publish".split())


def _reads(node):
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}


def _writes(node):
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}


def _own(body):
    """Statements of a scope in order, with the branches (line, side) that guard them; inner scopes are left out."""
    todo = [(s, ()) for s in reversed(body)]
    while todo:
        s, guards = todo.pop()
        yield s, guards
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        branches = isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Match, ast.Try))
        for field in ("finalbody", "orelse", "body"):
            inner = guards + ((s.lineno, field),) if branches and field != "finalbody" else guards
            todo += [(x, inner) for x in reversed(getattr(s, field, []) or [])]
        for i, h in enumerate([*(getattr(s, "handlers", []) or []), *(getattr(s, "cases", []) or [])]):
            todo += [(x, guards + ((s.lineno, f"case {i}"),)) for x in reversed(h.body)]


def _heads(s):
    """The parts of a statement that are its own, without the statements it holds."""
    if isinstance(s, (ast.If, ast.While)):
        return [s.test]
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return [s.target, s.iter]
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return s.items
    if isinstance(s, ast.Match):
        return [s.subject]
    if isinstance(s, (ast.Try, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return []
    return [s]


def anchors_of(text):
    """(symbol, kind, line, lines it depends on, guarding lines, whether it calls out) of every result of a file's functions."""
    tree = _parse(text)
    if tree is None:
        return []
    names = {(a, b): n for n, _, a, b in python_definitions(tree)}
    out = []
    for fn in ast.walk(tree):
        if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        symbol = names.get((min([fn.lineno, *(d.lineno for d in fn.decorator_list)]), fn.end_lineno), fn.name)
        defs, uses, seen = {}, {}, []
        for s, guards in _own(fn.body):
            own = _heads(s)
            reads, writes = set().union(*map(_reads, own)) if own else set(), set().union(*map(_writes, own)) if own else set()
            uses[s.lineno] = (reads, guards, {n: list(defs.get(n, ())) for n in reads})
            for n in writes:
                # a write replaces the earlier ones that stand under its guards
                defs[n] = [d for d in defs.get(n, []) if d[1][: len(guards)] != guards] + [(s.lineno, guards)]
            calls = [c for o in own for c in ast.walk(o) if isinstance(c, ast.Call)]
            called = {c.func.attr if isinstance(c.func, ast.Attribute) else getattr(c.func, "id", "") for c in calls}
            attr = any(isinstance(t, (ast.Attribute, ast.Subscript)) and isinstance(t.ctx, ast.Store) for o in own for t in ast.walk(o))
            kind = "return" if isinstance(s, ast.Return) else "raise" if isinstance(s, ast.Raise) else "yield" if any(isinstance(x, (ast.Yield, ast.YieldFrom)) for o in own for x in ast.walk(o)) else "state_write" if attr else "output" if called & OUTPUT else "external_call" if calls and isinstance(s, ast.Expr) else None
            if kind:
                seen.append((kind, s.lineno, guards, bool(calls)))
        for kind, line, guards, external in seen:
            found, todo = set(), [line, *(g[0] for g in guards)]
            while todo:
                at = todo.pop()
                for n, ds in uses.get(at, (set(), (), {}))[2].items():
                    for d, g in ds:
                        if d not in found:
                            found.add(d)
                            todo += [d, *(x[0] for x in g)]
            out.append((symbol, kind, line, sorted(found - {line}), sorted({g[0] for g in guards}), external))
    return out


def anchors(artifacts: DataFrame) -> DataFrame:
    """Results (return, raise, yield, state_write, output, external_call) of Python functions with their backward slices.
    Files that do not parse and null contents give none."""

    def run(batches):
        for b in batches:
            rows = [(k, p, *r) for k, p, t in zip(b.artifact_id, b.path, b.content) for r in anchors_of(t)]
            yield pd.DataFrame(rows, columns=["artifact_id", "path", "symbol", "kind", "line", "depends_on", "guards", "external"])

    return _source(artifacts, r"\.py$").dropDuplicates(["artifact_id"]).mapInPandas(run, SCHEMA)


def behaviors(results: DataFrame) -> DataFrame:
    """Per result its trigger (guards), operation (the lines it depends on) and result line, with a number in its file."""
    from pyspark.sql import Window

    w = Window.partitionBy("artifact_id").orderBy("line", "symbol", "kind")
    return results.select("artifact_id", "path", "symbol", F.row_number().over(w).cast("bigint").alias("behavior_no"), F.col("guards").alias("trigger_lines"), F.array_except("depends_on", "guards").alias("operation_lines"), F.col("line").alias("result_line"), "kind")
