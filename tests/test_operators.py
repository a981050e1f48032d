import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstone.functions import text as T
from weirstone.operators import code, graph, relational, scoring, sequence, stats, trace
from weirstone.sources import files


def test_asof_windows_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice("uat")) for g in "xyz" for i in range(30)] + [("x", None, "u")]
    got = {(r.g, r.i): (r.start_at, r.n) for r in sequence.asof_windows(spark.createDataFrame(rows, "g string, i int, k string"), ["g"], "i", F.col("k") == "u", {"n": F.col("k") == "a"}).collect()}
    for g in "xyz":
        seq, last = [k for a, i, k in rows if a == g and i is not None], None
        for i, k in enumerate(seq):
            if k == "u":
                assert got[g, i] == (last, 0 if last is None else seq[last:i].count("a"))
                last = i


def test_islands_and_complement(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 9, 9), (1, 2, 2), (1, 7, None), (1, 8, 6)], "k int, a int, b int")
    merged = sequence.islands(df, ["k"], "a", "b")
    assert sorted((r.a, r.b, r.merged) for r in merged.collect()) == [(1, 5, 3), (9, 9, 1)]
    assert [(r.gap_start, r.gap_end) for r in sequence.complement(merged, ["k"], "a", "b").collect()] == [(6, 8)]


def test_budget_choices(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, 3, 4, 2])], "g string, i int, c int")
    assert [r.i for r in sequence.budget_skip(df, "g", "i", "c", 12).orderBy("i").collect()] == [0, 2, 3]
    assert [r.i for r in sequence.budget_prefix(df, ["g"], ["i"], "c", 14).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in sequence.head_tail(df, "g", "i", "c", 11).orderBy("i").collect()] == [0, 4]


def test_tertiles_put_the_rest_last(spark):
    df = sequence.tertiles(spark.range(100).withColumn("g", F.lit(1)), ["id"], ["g"])
    assert {r.bin: r["count"] for r in df.groupBy("bin").count().collect()} == {"small": 33, "medium": 33, "large": 34}


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randrange(9)) for i in rng.sample(range(500), 500)]
    got = {r.i: (r.row_no, r.running) for r in sequence.ranked(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], "v").collect()}
    place, total = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        place[g], total[g] = place.get(g, 0) + 1, total.get(g, 0) + v
        assert got[i] == (place[g], total[g])


def test_document_tables(spark):
    from weirstone.operators import documents as D

    assert D.sections_of("# A\nx\n```\n# no\n```\n## B #\n# C") == [(1, 1, "A", 1, 5, "A"), (2, 2, "B", 6, 6, "A > B"), (3, 1, "C", 7, 7, "C")]
    text = "Do:\n- one\n  - inner\n- two\n"
    assert [text[a:b] for _, a, b in D.demands_of(text)] == ["one\n  - inner", "two"]
    assert [x[0] for x in D.demands_of("Is it? Or not? Yes.")] == [1, 2] and D.demands_of("Only one?") == []
    text = "a b\n\n```\nx\n\ny\n```\nc"
    assert [(k, text[a:b]) for _, k, a, b in D.paragraphs_of(text)] == [("text", "a b"), ("code", "```\nx\n\ny\n```"), ("text", "c")]
    assert D.patch_paths_of("*** Update File: a/b.py\n+++ b/c.js\t1\n+++ /dev/null") == [("update", "a/b.py"), ("update", "c.js")]
    assert D.shell_paths_of("cat src/a.py -n") == [("ok", "src/a.py")] and D.shell_paths_of("cat $(x)") == [("refused", None)] and D.shell_paths_of("make x.py") == [("not_a_file_command", None)]
    assert D.json_leaves_of('{"a/b": [1, {"c": "x"}]}') == [("/a~1b/0", "1"), ("/a~1b/1/c", "x")] and D.json_leaves_of("{") == []
    assert D.delete_spans("abcdefghij", ["bc"]) == "adefghij" and D.delete_spans("abab", ["ab"]) is None and D.delete_spans("abc", ["ab"]) is None
    assert D.map_lines("a\nb\nc", "x\na\nc") == {1: 2, 3: 3}
    df = spark.createDataFrame([("see a.b( here", "a.b("), ("xa.b(", "a.b("), (None, "x")], "t string, n string")
    assert [r[0] for r in df.select(D.mentions(F.col("t"), F.col("n"))).collect()] == [True, False, None]


def test_reviews(spark):
    from weirstone.operators import review as V

    grid = spark.createDataFrame([("x",), ("y",)], "id string")
    seen = spark.createDataFrame([("x", "a")], "id string, who string")
    gaps = V.missing_cells([grid, spark.createDataFrame([("a",), ("b",)], "who string")], seen, ["id", "who"])
    assert {tuple(r) for r in gaps.collect()} == {("x", "b"), ("y", "a"), ("y", "b")}
    res = spark.createDataFrame([("x", "failed", 3), ("x", "complete", 4)], "id string, status string, tokens bigint")
    assert {tuple(r) for r in V.progress(grid, res, ["id"]).collect()} == {("x", "complete", 7, 2), ("y", "pending", 0, 0)}
    cf = spark.createDataFrame([(1, "alone", False), (1, "absent", True), (1, "original", True), (2, "alone", True)], "k int, setting string, passed boolean")
    assert {r.k: r.verified for r in V.counterfactual(cf, "k").collect()} == {1: True, 2: False}
    line = "k string, path string, line int"
    why = V.attribution(spark.createDataFrame([("j", "a", 1), ("p", "a", 2), ("s", "b", 1)], line), spark.createDataFrame([("a", 1)], "path string, line int"), spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("j", False), ("p", False), ("s", False), ("u", False), ("ok", True)], "k string, correct boolean"), "k", ["path", "line"])
    assert {r.k: r.cause for r in why.collect()} == {"j": "judgment", "p": "presentation", "s": "selection", "u": "unresolved", "ok": None}
    t = {"batch": spark.createDataFrame([(1, "j1"), (2, "j2")], "sample_id int, job_key string"), "jobs": spark.createDataFrame([("j1", "s1"), ("j2", "s1")], "job_key string, source_key string"), "catalog": spark.createDataFrame([("s1", "train")], "id string, part string")}
    route = V.inferred_route(t, "batch", "catalog")
    assert route == [("batch", "job_key", "jobs", "job_key"), ("jobs", "source_key", "catalog", "id")]
    assert {r.catalog_part for r in V.join_route(t, route).collect()} == {"train"}
    c = V.claim_status(spark.createDataFrame([("e1", 1.0), ("e2", 1.0), ("e3", 2.0)], "e string, v double"), spark.createDataFrame([("e1", 1.0), ("e2", 1.0), ("e2", 3.0)], "e string, v double"), "e", "v")
    assert {r.e: (r.status, r.agrees) for r in c.collect()} == {"e1": ("unique", True), "e2": ("ambiguous", None), "e3": ("unresolved", None)}
    g = V.assemble({"gold": spark.createDataFrame([("kc_001", "q")], "id string, q string"), "label": spark.createDataFrame([("kc_001", "q")], "id string, q string")}, ["id"], ["q"])
    assert g.count() == 1
    with pytest.raises(Exception, match="differs"):
        V.assemble({"gold": spark.createDataFrame([("kc_001", "q")], "id string, q string"), "label": spark.createDataFrame([("kc_001", "r")], "id string, q string")}, ["id"], ["q"]).collect()
    cov = V.greedy_coverage(spark.createDataFrame([("g", "a", 1, 1.0), ("g", "a", 2, 1.0), ("g", "b", 2, 1.0), ("g", "c", 3, 1.0)], "g string, i string, m int, w double"), "g", "i", "m", "w")
    assert [r.i for r in cov.orderBy("place").collect()] == ["a", "c", "b"]
    nf = V.next_fit(spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 4, 4, 20, 1])], "g string, i int, s int"), "g", "i", "s", 10)
    assert [r.shard_no for r in nf.orderBy("i").collect()] == [1, 1, 2, 3, 4]
    texts = spark.createDataFrame([("r/a.md",), ("r/b.md",), ("x/c.md",), ("y/c.md",)], "path string")
    links = spark.createDataFrame([("r/a.md", "b.md"), ("r/b.md", "c.md"), ("r/b.md", "x/c.md")], "path string, mention string")
    fc = {r.node: (r.depth, r.ambiguous_links) for r in V.file_closure(texts, links, spark.createDataFrame([("r/a.md",)], "path string")).collect()}
    assert fc == {"r/a.md": (0, 0), "r/b.md": (1, 1), "x/c.md": (2, 0)}


def test_backward_slices():
    from weirstone.operators import slicing

    text = "def f(a):\n    x = a + 1\n    y = 2\n    if x:\n        z = y\n    else:\n        z = x\n    w = 9\n    print(w)\n    return z\n"
    got = {(k, n): d for _, k, n, d, _, _ in slicing.anchors_of(text)}
    assert got["return", 10] == [2, 3, 5, 7] and got["output", 9] == [8]


def test_first_rule_treats_null_as_false(spark):
    r = relational.first_rule([("a", F.col("x") > 1), ("b", F.col("x").isNull())], "c")
    assert [x.r for x in spark.createDataFrame([(2,), (None,), (0,)], "x int").select(r.alias("r")).collect()] == ["a", "b", "c"]


def test_matching_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (4, 4)):
        for _ in range(20):
            w = rng.integers(0, 6, (n, m)).astype(float)
            got = sum(w[i, j] for i, j in scoring.best_matching(w))
            k = w if n <= m else w.T
            assert got == max(sum(k[i, p[i]] for i in range(len(k))) for p in permutations(range(k.shape[1]), len(k)))
    assert scoring.permute(np.array([[1.0, 1.0], [1.0, 1.0]])) == (0, 1)


def test_set_relation(spark):
    rows = [(["a"], ["b"], "disjoint"), (["a", "b"], ["b", "a", "a"], "exact"), (["a"], ["a", "b"], "superset"), (["a", "b"], ["a"], "proper_subset"), (["a", "b"], ["a", "c"], "partial_overlap"), ([], ["a"], None)]
    df = spark.createDataFrame(rows, "g array<string>, c array<string>, want string").withColumn("got", scoring.set_relation(F.col("g"), F.col("c")))
    assert all(r.got == r.want for r in df.collect())


def test_set_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [[str(rng.randrange(400)) for _ in range(30)] for _ in range(8)]
    sets = {f"k{i}": set(base[i % 8]) - set(rng.sample(base[i % 8], rng.randrange(4))) for i in range(60)}
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "k string, x string")
    got = {(r.left_id, r.right_id) for r in scoring.set_pairs(df, "k", "x", 0.8).collect()}
    reps = {}
    for k in sorted(sets):
        reps.setdefault(frozenset(sets[k]), k)
    names = sorted(reps.values())
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == want


def test_equal_sets_keep_their_members(spark):
    near = {f"x{i}" for i in range(60)}
    sets = {"c": {"p", "q"}, "a": {"p", "q"}, "b": {"p", "q"}, "d": {"p"}, "n1": near, "n2": near | {"y"}, "n3": near, "e1": {None}, "e2": {None}}
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v] + [("a", "p"), ("a", None), (None, "p")], "k string, x string")
    full = {k: v - {None} for k, v in sets.items()}
    alike = lambda a, b: not full[a] | full[b] or len(full[a] & full[b]) / len(full[a] | full[b]) >= 0.98
    rows = {r.k: r for r in scoring.set_members(df, "k", "x", 0.98).collect()}
    assert {k: r.links for k, r in rows.items()} == {a: sum(alike(a, b) for b in sets if b != a) for a in sets}
    assert {k: (r.representative, r.members) for k, r in rows.items()} == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "n1": ("n1", 2), "n2": ("n2", 1), "n3": ("n1", 2), "e1": ("e1", 2), "e2": ("e1", 2)}
    links = sorted((r.left_id, r.right_id, r.similarity) for r in scoring.set_links(df, "k", "x", 0.98).collect())
    assert links == [("a", "b", 1.0), ("a", "c", 1.0), ("e1", "e2", 1.0), ("n1", "n2", 0.983607), ("n1", "n3", 1.0)]


def test_components_and_bfs(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [("hub", f"h{i}") for i in range(40)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    links = graph.undirected(spark.createDataFrame(edges, "a string, b string"), "a", "b")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    assert {r.node: r.component for r in graph.components(links).collect()} == want
    near = {r.node: r.depth for r in graph.bounded_bfs(spark.createDataFrame([("p00",)], "node string"), links, 3).collect()}
    assert near == {"p00": 0, "p01": 1, "p02": 2, "p03": 3}


def test_statistics(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, -0.5)], "g string, d double")
    assert stats.signflip_exact(df, ["g"], "d").first().p_value == 0.25
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r.k: round(r.adjusted, 6) for r in stats.holm(p, ["f"], "k", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    b = spark.createDataFrame([("g", float(i), i % 5) for i in range(50)], "g string, v double, c int")
    r = stats.bootstrap(b, "g", "v", "c", draws=200).first()
    assert r.low <= r.mean_value <= r.high


@pytest.mark.parametrize("path,want", [("src/a.py", "source"), ("tests/a.py", None), ("a/test_x.py", None), ("x.j2", "runtime_template"), ("conf/x.yaml", "configuration"), ("requirements.txt", "configuration"), ("readme.md", None), ("views/a.html", "runtime_template"), ("a.html", None), ("run", "executable"), ("pic.png", None)])
def test_file_kind(spark, path, want):
    df = spark.createDataFrame([(path, "#!/bin/sh\n")], "p string, c string")
    assert df.select(T.file_kind(F.col("p"), F.col("c")).alias("k")).first().k == want


def test_clean_path(spark):
    rows = {"./src//a.py": "src/a.py", "../a": None, "/etc/x": None, "a/*.py": None, "https://x/y": None, "-r": None, "a\\b.c": "a/b.c", "": None}
    df = spark.createDataFrame([(k,) for k in rows], "p string").select("p", T.clean_path(F.col("p")).alias("c"))
    assert {r.p: r.c for r in df.collect()} == rows


def test_definitions_and_calls(spark):
    text = "import os\nclass A:\n    def f(self):\n        g(1)\n        return os.path.join('a')\n\ndef g(x):\n    return len(str(x))\n"
    js = "export function foo(a) {\n  if (a) { return '}'; }\n}\nclass B {\n}\n"
    df = spark.createDataFrame([(1, "i", "a.py", text), (2, "i", "b.js", js), (3, "i", "c.py", "def ("), (4, "i", "d.py", None)], "artifact_id bigint, input_id string, path string, content string")
    got = {(r.artifact_id, r.symbol, r.kind, r.start_line, r.end_line) for r in code.definitions(df).collect()}
    assert got == {(1, "A", "class", 2, 5), (1, "A.f", "method", 3, 5), (1, "g", "function", 7, 8), (2, "foo", "function", 1, 3), (2, "B", "class", 4, 5)}
    e = code.call_edges(df).collect()
    assert [(r.scope, r.target_symbol, r.line) for r in e] == [("A.f", "g", 4)]
    assert {r.kind for r in code.evidence(df).collect()} >= {"FunctionDef", "Return", "file"}


def test_task_assignment(spark):
    texts = [("assistant_response", "early"), ("user_prompt", "fix parse_line in src/a.py"), ("assistant_response", "ok"), ("user_prompt", "yes, go"), ("user_prompt", "write a poem about rivers"), ("user_prompt", "src/a.py again")]
    df = spark.createDataFrame([(i, "x", k, i, c) for i, (k, c) in enumerate(texts)], "event_pk bigint, input_id string, event_type string, input_order int, content string")
    got = {r.event_pk: (r.task_no, r.rule) for r in trace.assign_tasks(df).collect()}
    assert got == {1: (1, "new_task"), 2: (1, "follows_prompt"), 3: (1, "follow_up"), 4: (2, "new_task"), 5: (1, "shared_object")}


def test_reference_edges(spark):
    rows = [(1, 1, "tool_exchange", 'Tool invocation:\n{}\n\nTool result:\nstarted job id: ab12x'), (2, 2, "user_prompt", "look at job id ab12x"), (3, 3, "user_prompt", "job id zz9q")]
    df = spark.createDataFrame([("i", o, t, k, c) for o, t, k, c in rows], "input_id string, input_order int, turn_number int, event_type string, content string")
    assert [(r.key, r.task, r.owner) for r in trace.reference_edges(df).collect()] == [("ab12x", 2, 1)]


def test_strict_json():
    assert trace.strict_json('{"a": 1}') == {"a": 1}
    assert trace.strict_json('{"a": 1, "a": 2}') is None and trace.strict_json('{"a": NaN}') is None and trace.strict_json("[1]") is None


def test_files(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_text("héllo")
    (tmp_path / "t" / "sub" / "b.bin").write_bytes(b"\x00\x01")
    tree = files.read_tree(spark, str(tmp_path / "t"))
    assert {(r.path, r.reason) for r in tree.collect()} == {("a.txt", None), ("sub/b.bin", "binary")}
    listed = spark.createDataFrame([("a.txt",), ("gone",)], "path string")
    assert {(r.path, r.problem) for r in files.check_listing(tree, listed).collect()} == {("gone", "missing"), ("sub/b.bin", "unlisted")}
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    files.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    assert files.write_sorted(df, str(tmp_path / "p"), ["b"]).count() == 2
    with pytest.raises(ValueError):
        files.pinned(spark, str(tmp_path / "p"), ["a", "b"])
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n one\n-two\n+2\n three\n"
    assert files.patch_lines(patch) == [("x.py", 2, "-"), ("x.py", 2, "+")]
    d1 = files.tree_digest(spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "g string, path string, content string"), ["g"]).first().digest
    d2 = files.tree_digest(spark.createDataFrame([("r", "b", "2"), ("r", "a", "1")], "g string, path string, content string"), ["g"]).first().digest
    assert d1 == d2


def test_retrieval(spark):
    from weirstone.operators import retrieval as V

    files = spark.createDataFrame([("i", p) for p in ("docs2/docusaurus.config.js", "docs2/src/a.js", "src/b.py", "tests/c.py", "setup.py", "readme.md", "x/fixtures/d.json", "conf.yml", "pic.png")], "input_id string, path string")
    kept = V.without_sites(files, ["input_id"], "path")
    got = {r.path: r.k for r in kept.select("path", V.evidence_class(F.col("path")).alias("k")).collect()}
    assert got == {"src/b.py": "implementation", "tests/c.py": "test", "setup.py": "build_metadata", "readme.md": "documentation", "x/fixtures/d.json": "fixture", "conf.yml": "configuration", "pic.png": None}
    rows = [("i", 1, 1, "assistant_response", "we keep the old parser for now, yes"), ("i", 2, 2, "user_prompt", 'you said "we keep  the old parser for now" - why?'), ("i", 3, 3, "user_prompt", '"nowhere_to_be_found_single_token"')]
    q = V.quote_references(spark.createDataFrame(rows, "input_id string, o int, t int, k string, c string"), "input_id", "o", "t", "k", "c")
    assert [(r.task, r.owner) for r in q.collect()] == [(2, 1)]
    s = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 3), ("c", "x", 0)], "g string, n string, s int")
    assert {(r.g, r.n) for r in V.unique_best(s, ["g"], "s").collect()} == {("a", "y")}
    e = V.edge_behaviors(spark.createDataFrame([("e1", ["a", "b"])], "e string, ev array<string>"), spark.createDataFrame([("b2", ["b"]), ("b1", ["a", "b"]), ("b3", ["z"])], "b string, ev array<string>"), "e", "b", "ev")
    assert e.first().behaviors == ["b1", "b2"]
    w = V.state_edges(spark.createDataFrame([("s", "f"), ("s", "f"), ("s", "g")], "k string, sym string"), spark.createDataFrame([("s", "g")], "k string, sym string"), ["k"], "sym")
    assert {(r.source, r.target) for r in w.collect()} == {("f", "g")}
    t = V.sections_in_turn(spark.createDataFrame([("d", "s1", "a", 1), ("d", "s1", "b", 2), ("d", "s2", "a", 1), ("d", "s2", "c", 2)], "d string, s string, x string, o int"), "d", "s", "x", "o")
    assert [r.x for r in t.orderBy("place").collect()] == ["a", "c", "b"]
    c = V.cited_lines(spark.createDataFrame([("p", 2, 3), ("p", 3, 9), ("q", 1, 1)], "path string, line_start int, line_end int"), spark.createDataFrame([("p", "a\nb\nc")], "path string, content string"), ["path"])
    assert {(r.path, r.line_start): (r.state, r.excerpt) for r in c.collect()} == {("p", 2): ("resolved", "b\nc"), ("p", 3): ("missing", None), ("q", 1): ("missing", None)}
    r = V.resolve_quotes(spark.createDataFrame([("p", "b\nc"), ("p", "x"), ("p", "a")], "path string, q string"), spark.createDataFrame([("p", "a b\r\nc a")], "path string, t string"), ["path"], "q", "t")
    assert {x.q: (x.state, x.char_start) for x in r.collect()} == {"b\nc": ("unique", 2), "x": ("absent", None), "a": ("ambiguous", None)}
    assert V.is_subsequence([1, 3], [1, 2, 3]) and not V.is_subsequence([3, 1], [1, 2, 3])
    assert V.identity(["a", "b"]) != V.identity(["ab"]) and V.identity([]) == "00000000"
    ids = spark.createDataFrame([("--a b/c.d--",)], "t string").select(V.reference_id(F.col("t")).alias("r")).first().r
    assert ids == "a_b_c.d"
    p = V.packed_reads(spark.createDataFrame([("g", 1, 20), ("g", 2, 1), ("h", 1, 4), ("h", 2, 7), ("h", 3, 1)], "g string, o int, c int"), ["g"], ["o"], "c", 10)
    assert {(x.g, x.o): x.state for x in p.collect()} == {("g", 1): "oversize", ("g", 2): "deferred", ("h", 1): "shown", ("h", 2): "deferred", ("h", 3): "deferred"}
    u = V.reuse(spark.createDataFrame([("a", "1"), ("b", "2")], "p string, c string"), spark.createDataFrame([("z", "1")], "p string, c string"), "c")
    assert {x.p: x.reused for x in u.collect()} == {"a": True, "b": False}
    n = V.windows_of_lines(spark.createDataFrame([("k", 100), ("l", 5)], "k string, n int"), "k", "n", 50, 10)
    assert sorted((x.k, x.line_start, x.line_end) for x in n.collect()) == [("k", 1, 50), ("k", 41, 90), ("k", 81, 100), ("l", 1, 5)]


def test_more_retrieval_and_files(spark, tmp_path):
    from weirstone.operators import retrieval as V

    p = spark.createDataFrame([("<system-reminder> x",), ("Tool loaded.",), ("please look",), (None,)], "t string")
    assert [r[0] for r in p.select(V.is_system_prompt(F.col("t"))).collect()] == [True, True, False, False]
    g, j = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string"), spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.0), ("b", 0.2)], "k string, s double")
    assert {r.k: r.outcome for r in V.screen(g, j, ["k"], "s").collect()} == {"a": "full", "b": "partial", "c": "unmatched", "d": "unknown"}
    req = spark.createDataFrame([("g", "r", ["x.py", "f_g"], ["x.py"], ["verify"])], "g string, requirement_id string, objects array<string>, paths array<string>, operations array<string>")
    ev = [("g", "e1", "tool_call", ["x.py"], ["x.py"], ["verify"]), ("g", "e2", "tool_call", ["x.py"], ["x.py"], ["inspect"]), ("g", "e3", "assistant", ["f_g"], ["y.py"], []), ("g", "e4", "assistant", ["f_g"], [], []), ("h", "e5", "assistant", ["f_g"], [], [])]
    got = V.matched_events(req, spark.createDataFrame(ev, "g string, event_id string, kind string, objects array<string>, paths array<string>, operations array<string>"), "g")
    assert {r.event_id for r in got.collect()} == {"e1", "e4"}
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls")], "source string, target string, relation string")
    assert {(r.node, r.side) for r in V.relations_by_node(edges).collect()} == {("a", "out"), ("b", "in")}
    view = V.scope_view(spark.createDataFrame([("i", 1, 10), ("i", 2, 12), ("i", 1, 11)], "i string, t int, o int"), "i", "t", "o")
    assert {r.t: (r.events, r.scope) for r in view.collect()} == {1: ([10, 11], "history"), 2: ([12], "current")}
    assert files.delimited_rows('a,b\n1,"x\ny"\n\n2,z\n') == [(1, 2, 3, {"a": "1", "b": "x\ny"}), (2, 5, 5, {"a": "2", "b": "z"})]
    t = files.table_rows(spark.createDataFrame([("p", "a,a\n1,2"), ("q", "a,b\n1,2"), ("r", None)], "path string, content string")).collect()
    assert [(r.path, r.fields) for r in t] == [("q", {"a": "1", "b": "2"})]
    lines = spark.createDataFrame([('{"record_type": "claim"}',), ('{"record_type": "x"}',), ("{",)], "l string")
    assert files.typed_records(lines, "l", ["claim", "experiment"]).count() == 1
    (tmp_path / "r" / "1").mkdir(parents=True)
    (tmp_path / "r" / "1" / "result.json").write_text('{\n"score": 0.5}')
    r = files.read_results(spark, str(tmp_path / "r"), "score double").first()
    assert r.score == 0.5 and r.result_path.endswith("1/result.json")


def test_sign_flips_of_many_clusters_and_holm_with_nulls(spark):
    rng = random.Random(4)
    d = [rng.gauss(0.3, 1) for _ in range(17)]
    df = spark.createDataFrame([("many", x) for x in d] + [("few", 1.0), ("few", 2.0)], "g string, d double")
    got = {r.g: r for r in stats.signflip_exact(df, ["g"], "d").collect()}
    totals = [0.0]
    for x in d:
        totals = [t + y for t in totals for y in (x, -x)]
    exact = sum(t >= sum(d) - 1e-9 for t in totals) / len(totals)
    assert got["many"].clusters == 17 and abs(got["many"].p_value - exact) < 0.03 and got["few"].p_value == 0.25
    assert stats.signflip_exact(df, ["g"], "d").where("g = 'many'").first().p_value == got["many"].p_value
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", None), ("f", "c", 0.3)], "f string, k string, p double")
    assert {r.k: r.adjusted for r in stats.holm(p, ["f"], "k", "p").collect()} == {"a": 0.03, "b": None, "c": 0.6}


def test_paired_bootstrap_weighs_clusters(spark):
    rows = [("g", 0.0, 1.0, "a")] * 9 + [("g", 0.0, 0.0, "b")] + [("g", None, 5.0, "b"), ("h", 1.0, 3.0, "a")]
    got = {r.g: r for r in stats.paired_bootstrap(spark.createDataFrame(rows, "g string, b double, t double, c string"), "g", "b", "t", "c").collect()}
    assert (got["g"].pairs, got["g"].clusters, got["g"].difference, got["g"].low, got["g"].high) == (10, 2, 0.9, 0.0, 1.0)
    assert got["h"].difference == 2.0 and got["h"].low is None

# -- evidence units ---------------------------------------------------------------
def test_pair_calls(spark):
    from weirstone.operators import evidence

    rows = [("s", 1, "use", "a", 1), ("s", 2, "result", "a", 2), ("s", 3, "result", "a", 3), ("s", 4, "use", "b", 4), ("s", 5, "result", "c", 5), ("s", 6, "use", "a", 6), ("s", 7, "use", " ", 7), ("s", 8, "use", None, 8), ("t", 9, "result", "a", 1), ("t", 10, "use", "a", 2)]
    df = spark.createDataFrame(rows, "scope string, pk bigint, kind string, call_id string, at bigint")
    got = {r.pk: (r.outcome, r.other) for r in evidence.pair_calls(df, ["scope"], "call_id", "kind", "at", "pk").collect()}
    assert got == {1: ("paired", 2), 2: ("paired", 1), 3: ("duplicate", None), 4: ("open", None), 5: ("orphan", None), 6: ("duplicate", None), 7: ("without_id", None), 8: ("without_id", None), 9: ("orphan", None), 10: ("open", None)}
    assert evidence.pair_calls(df.limit(0), ["scope"], "call_id", "kind", "at", "pk").count() == 0


def test_line_hits_against_brute_force(spark):
    import random

    from weirstone.operators import evidence

    rng = random.Random(4)
    make = lambda: [(g, a, a + rng.randrange(4)) for g in "abcdef" for a in (rng.randrange(40) for _ in range(rng.randrange(4)))]
    p, g = make(), make()
    schema = "g string, a bigint, b bigint"
    got = {r.g: (r.distance, r.hit_at_0, r.hit_at_3) for r in evidence.line_hits(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema), ["g"], "a", "b").collect()}
    want = {}
    for k in {x[0] for x in g}:
        d = [abs(x - y) for _, a, b in (r for r in p if r[0] == k) for x in range(a, b + 1) for _, c, e in (r for r in g if r[0] == k) for y in range(c, e + 1)]
        want[k] = (min(d) if d else None, bool(d) and min(d) == 0, bool(d) and min(d) <= 3)
    assert got == want


def test_resolved_calls(spark):
    from weirstone.operators import code

    files = [
        ("src/pkg/a.py", "from .b import helper as h, Box\nimport pkg.c as c\nimport os\n\ndef one():\n    def inner():\n        pass\n    inner()\n    h()\n    c.run()\n    os.getcwd()\n    unknown()\n\nclass K:\n    def m(self):\n        self.n()\n        one()\n        Box()\n        m()\n    def n(self):\n        pass\n"),
        ("src/pkg/b.py", "def helper():\n    pass\n\nclass Box:\n    def __init__(self):\n        pass\n"),
        ("src/pkg/c.py", "def run():\n    pass\n"), ("src/pkg/broken.py", "def ("), ("src/pkg/none.py", None),
    ]
    df = spark.createDataFrame([(i, "i", p, t) for i, (p, t) in enumerate(files)], "artifact_id bigint, input_id string, path string, content string")
    got = {(r.scope, r.callee): (r.target_path, r.target_symbol, r.way) for r in code.resolved_calls(df).collect()}
    a, b = "src/pkg/a.py", "src/pkg/b.py"
    assert got == {("one", "inner"): (a, "one.inner", "local"), ("one", "h"): (b, "helper", "import"), ("one", "c.run"): ("src/pkg/c.py", "run", "import"), ("K.m", "self.n"): (a, "K.n", "local"), ("K.m", "one"): (a, "one", "local")}
    assert code.resolved_calls(df.limit(0)).count() == 0


def test_nearest_ties_and_lone_groups(spark):
    from weirstone.operators import retrieval

    p = spark.createDataFrame([("g", i, i) for i in (0, 3, 4, 5, 9)] + [("h", 7, 100)], "g string, at bigint, pk bigint")
    b = spark.createDataFrame([("g", 2, "y"), ("g", 2, "x"), ("g", 6, "z")], "g string, center bigint, name string")
    got = {r.pk: r.name for r in retrieval.nearest(p, b, ["g"], "at", "center", "pk", "name").collect()}
    assert got == {0: "x", 3: "x", 4: "x", 5: "z", 9: "z"}
