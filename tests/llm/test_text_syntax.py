import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirstone.llm import syntax
from weirstone.llm.derivatives import Grammar, run
from weirstone.llm.languages import language

VALID = {
    ".py": ["", "\n\n", "x = 1\n", "def f(a, *, b: int = 2, **k) -> int:\n    return [y for y in a if y]\n", "match x:\n  case [1, _]:\n    pass\n", "x = f'{a!r:>{w}} {b + 1}'\n", "if a:\n\tx\nelse:\n\ty", "async def f():\n    async with a as b, c: await d\n", "print(*a, **b)", "try:\n  x\nexcept* E as e:\n  pass\n", "a = (\n  1,\n\n # c\n 2)\n", "@d.e\nclass A(B, metaclass=C): x: int = 0\n", "lambda *a, b=1: (yield)\n", "x[1:2, ::3] = y[...]\n", "type = match = 1\n"],
    ".js": ["", "const f = async (a, {b}, ...c) => ({a, b})\nlet x\nx = 1\n", "for (const [k, v] of m) { if (/[/]x/.test(k)) continue; else break }", "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* q } }", "export default function () {}\nimport a, {b as c} from 'x';", "`a ${b + `${c}`}`", "a?.b?.[c] ?? d", "x = a ? b : c ? d : e; return_ = 1", "label: while (1) { do { } while (0) }"],
    ".ts": ["interface A<T> extends B { x?: T[]; (y: string): void }", "export async function f<T>(a: T[], b?: C): Promise<T> { return a as unknown as T; }", "type X = { [k in keyof Y]?: Y[k] } | 'a' | (() => void);", "class A { private readonly x: number = 1; constructor(private y: string) {} }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number; }", "const x = <T,>(a: T) => a; let y = z!.w satisfies Q;", "abstract class B { abstract f(): void; }"],
    ".java": ["package a.b;\nimport static x.Y.*;\npublic class A<T extends B> { @Override public <U> U f(final int[] a, String... b) throws E { return (U) (Object) a[0]; } }", "record P(int x) { P { } }", "enum E { A(1) { }, B; int x; }", "class A { void f() { for (int i = 0, j; i < 3; i++) { } try (var x = y()) { } catch (A | B e) { } finally { } switch (x) { case 1 -> a(); default -> { } } Runnable r = () -> { }; int[] z = {1, 2}; List<Map<String, int[]>> q = new ArrayList<>(); } }"],
    ".go": ["package a\nimport (\n\t\"x\"\n\ty \"z\"\n)\nfunc (r *T) f(a, b int, c ...string) (int, error) {\n\tif x := g(); x > 0 {\n\t\treturn 1, nil\n\t}\n\tfor i := range m {\n\t\tdefer h(i)\n\t}\n\tv := []T{{a: 1}, {b: 2}}\n\tswitch y := v.(type) {\n\tcase int, *T:\n\t}\n\treturn 0, nil\n}\n", "package a\ntype S struct {\n\tA int `json:\"a\"`\n\t*B\n}\ntype I interface {\n\tF(int) string\n}\n"],
    ".c": ["#include <x.h>\n#define A(b) (b)\nstatic int f(const char *a, struct b *c) { for (int i = 0; i < 3; i++) { a[i]->b = (struct d *)c; } return sizeof(int) * 2; }\ntypedef struct { int x : 3; } T;\nint (*g)(int, ...);\nconst int v[] = {1, [2] = 3};\n", "int x = 'a'; char *s = \"a\" \"b\"; enum E { A, B = 2 };"],
    ".rb": ["def f(a, b: 1, *c, &d)\n  return a unless b\n  x = y.map { |z| z + 1 }\n  puts \"#{a} b\", c\nend\n", "class A < B\n  attr_reader :x\n  def self.y = 1 unless false\nend\n".replace("  def self.y = 1 unless false\n", ""), "case x\nwhen 1, 2 then a\nelse b\nend\nbegin\n  f\nrescue E => e\n  raise G, 'h'\nensure\n  i\nend\n", "x = { a: 1, 'b' => 2 }\ny.each do |k, v|\n  z[k] ||= v\nend\n", "=begin\nanything\n=end\nx = a ? b : c\n", "while x do y end\nfoo.bar(1)\n  .baz\n"],
}
INVALID = {
    ".py": ["def f(:\n  pass", "x = (1,\n", "if a:\npass\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n", "x = 'abc\n", "for x in:\n  y\n", "  x = 1\n", "if a:\n  x\n y\n", "x = f'{a +}'\n", "a = 012\n", "import {a} from 'b'\n", "else:\n  x\n"],
    ".js": ["function f( {", "const x = [1, 2;", "{\"a\": 1, \"b\": 2}", "x = = 1;", "def f(): pass", "let s = 'abc", "if (a { b }", "a b", "class { }", "`a ${b`", "/* open"],
    ".ts": ["function f(a: ): void {}", "interface A { x: ; }", "const x: number = ;", "let y: Array<number = 1;"],
    ".java": ["class A { void f() { int x = ; } }", "class A { ", "public f() { }", "class A { void f() { x } }", "def f\nend"],
    ".go": ["package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f( {\n}\n", "x := 1\n", "package a\nfunc f() {\n\tif x {\n}\n"],
    ".c": ["int f() { return 1; ", "int f( { }", "#incl <x>\nint x;", "int x = ;", "#if A\nint x;\n", "import a from 'b';"],
    ".rb": ["def f\n  x\n", "x = [1, 2\n", "end\n", "def f(a:\nend end", "if x\n  y\n", "x = 'abc\n", "foo(1]\n"],
}


@pytest.mark.parametrize("suffix,text", [(s, t) for s, ts in VALID.items() for t in ts])
def test_valid(suffix, text):
    assert language(suffix).check(text) is None


@pytest.mark.parametrize("suffix,text", [(s, t) for s, ts in INVALID.items() for t in ts])
def test_invalid(suffix, text):
    assert language(suffix).check(text) is not None


def test_end_and_failing_token():
    assert syntax.judge_text("a.py", "x = (1,\n")[2] == "truncated"
    assert syntax.judge_text("a.py", "x = 1\ny = = 2\n")[1:] == (False, "error", 2, "=")
    assert syntax.judge_text("a.txt", "x") is None and syntax.judge_text("a.py", None) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["(", ")", "[", "]", "a", ","]), max_size=14))
def test_groups_against_a_stack(tokens):
    g = Grammar("s = e* ; e = 'a' | '(' (e % ',')? ')' | '[' e* ']' ;", {"(": ")", "[": "]"})

    def parse(i, rule):
        # positions reachable after e at i
        out = set()
        if i < len(tokens):
            if tokens[i] == "a":
                out.add(i + 1)
            elif tokens[i] in "([":
                close = ")" if tokens[i] == "(" else "]"
                ends, todo = {i + 1}, {i + 1}
                first = True
                while todo:
                    nxt = set()
                    for k in todo:
                        for s in ([k] if tokens[i] == "[" or first else [k + 1] if k < len(tokens) and tokens[k] == "," else []):
                            nxt |= parse(s, rule)
                    first = False
                    todo = nxt - ends
                    ends |= nxt
                out |= {k + 1 for k in ends if k < len(tokens) and tokens[k] == close}
        return out

    at, todo = {0}, {0}
    while todo:
        todo = {k for i in todo for k in parse(i, None)} - at
        at |= todo
    assert (run(g, [g.codes[t] for t in tokens]) is None) == (len(tokens) in at)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 3))
def test_mutated_python_agrees_with_the_interpreter(seed, kind):
    import random
    import warnings

    rng = random.Random(seed)
    text = rng.choice([t for t in VALID[".py"] if len(t) > 20])
    toks = [t for t in language(".py").tokens(text) if t]
    i = rng.randrange(len(toks))
    toks = [toks[:i] + toks[i + 1 :], toks[: i + 1], toks[:i] + [rng.choice(toks)] + toks[i:], toks][kind]
    text = " ".join(toks) if False else "".join(t if t[0] in "\n#" else t + " " for t in toks)
    text = "\n".join(x.rstrip() for x in text.split("\n"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            ok = True
        except SyntaxError as e:
            ok = False
            if not any(w in str(e) for w in ("invalid syntax", "expected", "unexpected", "EOF", "never closed", "unmatched", "unterminated", "unindent")):
                return  # contextual errors
    if ok:
        assert language(".py").check(text) is None


def test_operator(spark):
    rows = [(1, "r", "a.py", "x = 1", "k"), (1, "r", "a.py", "x = 1", "k"), (2, None, "b.go", "package a\nfunc f( {", "k"), (3, "r", "c.py", None, "k"), (4, "r", "d.md", "# x", "k"), (None, "r", "e.py", "x", "k"), (5, "r", None, "x", "k"), (6, "r", "f.js", "", "k")]
    df = spark.createDataFrame(rows, "artifact_id bigint, repo_id string, path string, content string, valid string")
    got = {r.artifact_id: (r.language, r.valid) for r in syntax.syntax(df).collect()}
    assert got == {1: ("Python", True), 2: ("Go", False), 6: ("JavaScript", True)}
    rates = {(r.repo_id, r.language): (r.files, r.invalid, r.invalid_rate) for r in syntax.rates(syntax.syntax(df)).collect()}
    assert rates == {("r", "Python"): (1, 0, 0.0), (None, "Go"): (1, 1, 1.0), ("r", "JavaScript"): (1, 0, 0.0)}
    assert syntax.syntax(df.limit(0)).count() == 0
