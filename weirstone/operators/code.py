"""Source-code analysis: definitions, statements, calls, config items and template blocks as table-valued operators."""

from __future__ import annotations

import ast
import builtins
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUILTIN = frozenset(dir(builtins))
_DECL = {
    "js": re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*([\w$]+)|class\s+([\w$]+))"),
    "java": re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:class|interface|enum|record)\s+(\w+)|^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+?\s(\w+)\s*\([^;{]*\)\s*(?:throws [\w., ]+)?\{"),
    "go": re.compile(r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)|^type\s+(\w+)"),
    "c": re.compile(r"(?m)^(?:static\s+|inline\s+|const\s+|struct\s+)*[A-Za-z_]\w*[\s*]+(\w+)\s*\([^;{]*\)\s*\{|^struct\s+(\w+)\s*\{"),
}
_LANG = {".js": "js", ".mjs": "js", ".jsx": "js", ".ts": "js", ".java": "java", ".go": "go", ".c": "c", ".cc": "c"}
DEFINITIONS = "artifact_id bigint, path string, symbol string, kind string, start_line bigint, end_line bigint"
CALLS = "artifact_id bigint, path string, scope string, callee string, line bigint, attribute boolean"
EVIDENCE = "artifact_id bigint, path string, symbol string, kind string, start_line bigint, end_line bigint, content string"


def python_definitions(tree):
    """(qualified name, kind, first line with decorators, last line) of all definitions, outer ones first."""
    out = []

    def walk(node, prefix):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append((name, kind, min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno))
                walk(child, name)
            else:
                walk(child, prefix)

    walk(tree, "")
    return out


def _block_end(lines, start):
    depth, opened = 0, False
    for i in range(start, len(lines)):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*", "", lines[i])
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0:
            return i + 1
    return len(lines)


def generic_definitions(text, lang):
    lines = text.split("\n")
    out = []
    for m in _DECL[lang].finditer(text):
        name = next((g for g in m.groups() if g), None)
        if name:
            first = text.count("\n", 0, m.start()) + (1 if text[m.start()] != "\n" else 2)
            kind = "class" if re.search(r"\b(?:class|interface|enum|record|struct|type)\b", m[0]) else "function"
            out.append((name, kind, first, _block_end(lines, first - 1)))
    return out


def _parse(text):
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _each(batches, columns, rows_of):
    for b in batches:
        rows = []
        for key, path, text in zip(b.artifact_id, b.path, b.content):
            rows += [(key, path, *r) for r in rows_of(path, text)]
        yield pd.DataFrame(rows, columns=["artifact_id", "path", *columns])


def _source(artifacts: DataFrame, suffix: str) -> DataFrame:
    return artifacts.select("artifact_id", "path", "content").where(F.col("content").isNotNull() & F.col("artifact_id").isNotNull() & F.col("path").rlike(suffix))


def definitions(artifacts: DataFrame) -> DataFrame:
    """Definition spans of Python (by its grammar) and, by declaration patterns and brace matching, of other languages.
    A Python file that does not parse gives none."""

    def rows(path, text):
        if path.endswith(".py"):
            tree = _parse(text)
            return python_definitions(tree) if tree else []
        return generic_definitions(text, _LANG[path[path.rfind(".") :]])

    def run(batches):
        yield from _each(batches, ["symbol", "kind", "start_line", "end_line"], rows)

    return _source(artifacts, r"\.(py|js|mjs|jsx|ts|java|go|c|cc)$").mapInPandas(run, DEFINITIONS).dropDuplicates()


def calls(artifacts: DataFrame) -> DataFrame:
    """Call sites of Python files: the enclosing scope ('' at module level), the called name, its line, and whether it is an attribute. Built-ins are left out."""

    def rows(path, text):
        tree = _parse(text)
        if tree is None:
            return []
        spans, out = python_definitions(tree), []
        for node in ast.walk(tree):
            if isinstance(node, ast.Call):
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and not (isinstance(f, ast.Name) and name in _BUILTIN):
                    inside = [s for s in spans if s[2] <= node.lineno <= s[3]]
                    scope = min(inside, key=lambda s: (s[3] - s[2], s[2]))[0] if inside else ""
                    out.append((scope, name, node.lineno, isinstance(f, ast.Attribute)))
        return out

    def run(batches):
        yield from _each(batches, ["scope", "callee", "line", "attribute"], rows)

    return _source(artifacts, r"\.py$").mapInPandas(run, CALLS).dropDuplicates()


_BLOCK = re.compile(r"\{%-?\s*(block|macro)\s+(\w+)|\{%-?\s*end(?:block|macro)|\{\{#(\w+)\s*([\w.]*)|\{\{/(\w+)")


def config_items(text, suffix):
    """(name, kind, first line, last line, text) of a configuration's items: INI keys under their section, or the top-level entries by indentation."""
    lines, out, section, at, indent = text.split("\n"), [], "", None, None
    if suffix in (".ini", ".cfg", ".conf", ".toml"):
        for i, x in enumerate(lines, 1):
            s = x.strip()
            if s.startswith("[") and s.endswith("]"):
                section = s.strip("[]")
            elif s and s[0] not in "#;" and "=" in s:
                key = s.split("=", 1)[0].strip()
                out.append((f"{section}.{key}" if section else key, "config", i, i, x))
        return out
    for i, x in enumerate(lines, 1):
        s = x.strip()
        if not s or s[0] == "#" or s in "{}[]":
            continue
        depth = len(x) - len(x.lstrip())
        indent = depth if indent is None else indent
        if depth <= indent and (m := re.match(r"\"?([\w.\-]+)\"?\s*:", s)):
            if at:
                out.append((at[0], "config", at[1], i - 1, "\n".join(lines[at[1] - 1 : i - 1])))
            at = (m[1], i)
    if at:
        out.append((at[0], "config", at[1], len(lines), "\n".join(lines[at[1] - 1 :])))
    return out


def template_blocks(text):
    out, stack = [], []
    lines = text.split("\n")
    for i, x in enumerate(lines, 1):
        for m in _BLOCK.finditer(x):
            if m[2] or m[3]:
                stack.append((m[2] or (m[4] or m[3]), i))
            elif stack:
                name, first = stack.pop()
                out.append((".".join([*(s[0] for s in stack), name]), "template", first, i, "\n".join(lines[first - 1 : i])))
    return out


def evidence(artifacts: DataFrame) -> DataFrame:
    """Evidence records: statements of Python files with their innermost symbol (the whole file where it does not
    parse), items of configurations, blocks of templates."""

    def rows(path, text):
        suffix = path[path.rfind(".") :]
        if suffix != ".py":
            return template_blocks(text) if suffix in (".j2", ".hbs") else config_items(text, suffix)
        tree, lines = _parse(text), text.split("\n")
        if tree is None:
            return [("", "file", 1, len(lines), text)]
        spans, out = python_definitions(tree), []
        for node in ast.walk(tree):
            if isinstance(node, ast.stmt):
                inside = [s for s in spans if s[2] <= node.lineno <= s[3]]
                symbol = min(inside, key=lambda s: (s[3] - s[2], s[2]))[0] if inside else ""
                # a compound statement's own evidence is its header
                last = node.body[0].lineno - 1 if getattr(node, "body", None) and isinstance(node.body, list) else node.end_lineno
                last = max(last, node.lineno)
                out.append((symbol, type(node).__name__, node.lineno, last, "\n".join(lines[node.lineno - 1 : last])))
        return out

    def run(batches):
        yield from _each(batches, ["symbol", "kind", "start_line", "end_line", "content"], rows)

    return _source(artifacts, r"\.(py|j2|hbs|ini|cfg|conf|toml|json|ya?ml)$").mapInPandas(run, EVIDENCE).dropDuplicates()


def call_edges(artifacts: DataFrame) -> DataFrame:
    """Calls resolved to the definition of that name in the same file, or else to the only one of its input; others give no edge."""
    d = definitions(artifacts).join(artifacts.select("artifact_id", "input_id").distinct(), "artifact_id").withColumn("name", F.element_at(F.split("symbol", r"\."), -1))
    c = calls(artifacts).where("not attribute").join(artifacts.select("artifact_id", "input_id").distinct(), "artifact_id")
    local = d.groupBy("artifact_id", "name").agg(F.count("*").alias("n"), F.min("symbol").alias("target")).where("n = 1")
    wide = d.groupBy("input_id", "name").agg(F.count("*").alias("n"), F.min("symbol").alias("wide_target"), F.min("path").alias("wide_path")).where("n = 1")
    out = c.join(local.select("artifact_id", F.col("name").alias("callee"), "target"), ["artifact_id", "callee"], "left").join(wide.select("input_id", F.col("name").alias("callee"), "wide_target", "wide_path"), ["input_id", "callee"], "left")
    hit = out.where("target is not null or wide_target is not null")
    return hit.select("input_id", "path", "scope", "line", F.when(F.col("target").isNotNull(), F.col("path")).otherwise(F.col("wide_path")).alias("target_path"), F.coalesce("target", "wide_target").alias("target_symbol"))


RESOLVED = "artifact_id bigint, path string, scope string, callee string, line bigint, local string, imported array<struct<module: string, symbol: string>>"


def _module(path):
    parts = path[: -len(".py")].split("/")
    return parts[:-1] if parts[-1] == "__init__" else parts


def _bindings(tree, path):
    """Name -> [(module, imported name or '')] of a file's imports; relative ones are made absolute by the path."""
    out, here = {}, _module(path)
    package = here if path.endswith("__init__.py") else here[:-1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                name = a.asname or a.name.split(".")[0]
                out.setdefault(name, []).append((a.name if a.asname else a.name.split(".")[0], ""))
        elif isinstance(node, ast.ImportFrom):
            base = package[: len(package) - node.level + 1] if node.level else []
            module = ".".join([*base, *(node.module.split(".") if node.module else [])])
            for a in node.names:
                out.setdefault(a.asname or a.name, []).append((module, a.name))
    return out


def _label(f):
    parts = []
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    return ".".join([f.id, *reversed(parts)]) if isinstance(f, ast.Name) else None


def python_calls(tree, path):
    """(scope, callee, line, local target or None, [(module, symbol)]) of the calls of names and dotted names.

    A plain name is looked up in the scopes around it, classes left out, innermost first; self and cls in the class of
    the method; other dotted names in the file as written. Imported names give modules and symbols to look up."""
    spans, names, out = python_definitions(tree), _bindings(tree, path), []
    kinds = {s: k for s, k, _, _ in spans}
    for node in ast.walk(tree):
        label = _label(node.func) if isinstance(node, ast.Call) else None
        if not label:
            continue
        inside = [s for s in spans if s[2] <= node.lineno <= s[3]]
        scope = min(inside, key=lambda s: (s[3] - s[2], s[2]))[0] if inside else ""
        first, _, rest = label.partition(".")
        local = None
        if not rest:
            around = scope.split(".") if scope else []
            for k in range(len(around), -1, -1):
                outer = ".".join(around[:k])
                symbol = f"{outer}.{label}" if outer else label
                if kinds.get(outer) != "class" and symbol in kinds:
                    local = symbol
                    break
        elif first in ("self", "cls"):
            owner = scope.rpartition(".")[0]
            local = f"{owner}.{rest}" if owner and f"{owner}.{rest}" in kinds else None
        elif first not in names and label in kinds:
            local = label
        there = []
        for module, imported in names.get(first, ()):
            symbol = ".".join(x for x in (imported, rest) if x)
            if symbol:
                there += [(module, symbol), (module, f"{symbol}.__init__")]
            if rest and not imported:  # a module's module
                head, _, last = rest.rpartition(".")
                if head:
                    there.append((f"{module}.{head}", last))
            elif rest:
                there.append((f"{module}.{imported}", rest))
        if local or there:
            out.append((scope, label, node.lineno, local, there))
    return out


def resolved_calls(artifacts: DataFrame) -> DataFrame:
    """Calls of Python files with the one definition they can mean: (artifact_id, scope, callee, line, target_path, target_symbol, way).

    way is local or import. A module is found in its input by any suffix of a file's path; a call that may mean several definitions, or none, gives no row."""

    def rows(path, text):
        tree = _parse(text)
        return python_calls(tree, path) if tree else []

    def run(batches):
        yield from _each(batches, ["scope", "callee", "line", "local", "imported"], rows)

    inputs = artifacts.select("artifact_id", "input_id").distinct()
    c = _source(artifacts, r"\.py$").mapInPandas(run, RESOLVED).dropDuplicates(["artifact_id", "scope", "callee", "line"]).join(inputs, "artifact_id")
    d = definitions(artifacts).where(F.col("path").endswith(".py")).join(inputs, "artifact_id").select("input_id", "path", "symbol").distinct()
    bare = F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), "/")
    suffixes = d.withColumn("_m", bare).withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size("_m")), lambda i: F.array_join(F.slice("_m", i, F.size("_m")), "."))))
    key = ["artifact_id", "scope", "callee", "line"]
    here = c.where("local is not null").select(*key, F.col("path").alias("target_path"), F.col("local").alias("target_symbol"), F.lit("local").alias("way"))
    asked = c.select("input_id", *key, F.explode("imported").alias("i")).select("input_id", *key, "i.*")
    there = asked.join(suffixes.select("input_id", "module", "symbol", F.col("path").alias("target_path")), ["input_id", "module", "symbol"]).select(*key, "target_path", F.col("symbol").alias("target_symbol"), F.lit("import").alias("way"))
    hits = here.unionByName(there).distinct()
    one = hits.groupBy(*key).agg(F.count_distinct("target_path", "target_symbol").alias("n"), F.min("target_path").alias("target_path"), F.min("target_symbol").alias("target_symbol"), F.min("way").alias("way"))
    return one.where("n = 1").drop("n")
