import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import catalog as C
from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import intervals as V
from graphloom.operators import search as S
from graphloom.operators import similarity as Y


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(8)
    pairs = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)})
    fn = spark.createDataFrame([(f"n{k}", f"name{k % 5}", "p" if k % 2 else "q") for k in range(14)], "uid string, name string, project string")
    return pairs, edges(spark, pairs), fn


def reach(pairs, start, most):
    """Hops of the shortest walk of at least one edge from each node to ``start`` nodes."""
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    hops, front = {}, set(start)
    for h in range(1, most + 1):
        front = {a for x in front for a in back[x]} - set(hops)
        for x in front:
            hops[x] = h
    return hops


def test_transitive_callers_equal_breadth_first_search(graph):
    pairs, e, fn = graph
    for name in ("name0", "name3"):
        want = reach(pairs, [f"n{k}" for k in range(14) if f"name{k % 5}" == name], 3)
        assert {r.uid: r.hops for r in G.transitive_callers(fn, e, name).collect()} == want
    with pytest.raises(ValueError):
        G.transitive_callers(fn, e, "x", 11)


def test_cycles_and_expansion(graph, spark):
    pairs, e, fn = graph
    assert {r.uid for r in G.in_cycle(e).collect()} == {n for n in {x for p in pairs for x in p} if n in reach(pairs, [n], 20)}
    both = pairs + [(b, a) for a, b in pairs]
    want = {n for n, h in reach(both, ["n0"], 2).items()} - {"n0"}
    assert {r.uid for r in G.expand(e, fn.where("uid = 'n0'")).collect()} == want
    assert G.in_cycle(edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_longest_chain_counts_the_closing_edge(spark):
    got = {r.uid: r.chain for r in G.longest_chain(edges(spark, [("A", "B"), ("A", "C"), ("B", "A"), ("C", "B")])).collect()}
    assert got["A"] == 3
    assert {r.uid: r.depth for r in G.longest_depth(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])).collect()} == {"a": 2, "b": 1, "c": 0}


def test_degrees_do_not_multiply(spark):
    fn = spark.createDataFrame([("x", "f", "p"), ("y", "f", "p"), ("z", "g", "p")], "uid string, name string, project string")
    e = edges(spark, [("x", "z"), ("y", "z"), ("z", "x"), ("z", "y")])
    assert {(r.uid, r.fan_in, r.fan_out) for r in G.degrees(fn, e).collect()} == {("x", 1, 1), ("y", 1, 1), ("z", 2, 2)}
    assert {(r.name, r.fan_in, r.fan_out) for r in G.metrics_by_name(fn, e).collect()} == {("f", 1, 1), ("g", 2, 2)}


def test_gate(spark):
    m = spark.createDataFrame([(f"u{k}", 50, 1, 1, 1, k < 30, "cyclic" if k < 30 else "") for k in range(100)], "uid string, complexity int, fan_in int, fan_out int, chain int, cyclic boolean, flags string")
    r = G.quality_gate(m).first()
    assert r.passed == 0 and r.violations == "complexity,risk,cycles"


def test_snapshots(spark):
    h = lambda rows: spark.createDataFrame(rows, "identity string, hash string")
    old, new = h([("a", "1"), ("b", "2"), ("c", "3")]), h([("b", "2"), ("c", "X"), ("d", "4")])
    assert {(r.identity, r.change) for r in I.diff(old, new).collect()} == {("a", "removed"), ("b", "unchanged"), ("c", "changed"), ("d", "added")}
    assert I.load_counters(old, new).first().asDict() == {"unique_events": 3, "loaded": 2, "skipped": 1, "stale": 1}
    assert I.load_counters(old, new, force=True).first().skipped == 0
    p = I.parse_identity(h([("node:Function:DemoA:a.py:add:1", ""), ("node:File:DemoB:b.py", "")]))
    assert {(r.type, r.project, r.file, r.function, r.line) for r in p.collect()} == {("Function", "DemoA", "a.py", "add", 1), ("File", "DemoB", "b.py", None, None)}
    assert {r.identity for r in I.stale(old, new).collect()} == {"a"}


def test_merge_keeps_old_values(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 3, None)], "uid string, p int, q int")
    b = spark.createDataFrame([("x", None, 9), ("z", 5, None)], "uid string, p int, q int")
    assert {tuple(r) for r in I.merge(a, b, ["uid"]).collect()} == {("x", 1, 9), ("y", 3, None), ("z", 5, None)}
    first = I.first_wins(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, n int, v string"), ["k"], [F.col("n")])
    assert [r.v for r in first.collect()] == ["a"]


def test_fingerprint_ignores_order(spark):
    n, e = spark.createDataFrame([("a",), ("b",)], "uid string"), edges(spark, [("a", "b"), ("b", "a")])
    one, two = I.fingerprint(n, e).first(), I.fingerprint(n.orderBy(F.desc("uid")), e.orderBy("dst")).first()
    assert one == two and one != I.fingerprint(n, e.limit(1)).first()


def test_search(spark):
    nodes = spark.createDataFrame([("P:a/m.py", "File", "P", "m.py", "a/m.py"), ("P:a/m.py:run_all:1", "Function", "P", "run_all", "a/m.py"), ("symbol:run", "Symbol", "", "run", "")], "uid string, label string, project string, name string, path string")
    ix = S.indexed(nodes)
    assert {r.uid for r in S.search(ix, "m.py").collect()} == {"P:a/m.py", "P:a/m.py:run_all:1"}
    assert {r.uid for r in S.search(ix, "run", "functions").collect()} == {"P:a/m.py:run_all:1"}
    assert {r.uid for r in S.search(ix, "run", "symbols").collect()} == {"symbol:run"}
    assert S.search(ix, "!!").count() == 0
    assert {r.uid for r in S.find(nodes, ix, "un_a").collect()} == {"P:a/m.py:run_all:1"}  # only the fallback finds parts


def test_collectors(spark):
    text = "import os\nfor x in os.walk('.'):\n    if x.suffix: print(x.read_text())\n"
    df = spark.createDataFrame([("a/scanner.py", text), ("b.py", "x = 1")], "path string, text string")
    got = {r.path: r for r in Y.collector_signals(df).collect()}
    assert got["a/scanner.py"].is_collector == 1 and got["a/scanner.py"].score == 6.0
    assert got["b.py"].score == 0 and got["b.py"].evidence == ""
    s = Y.collector_summary(Y.collector_signals(df)).first()
    assert (s.files, s.collectors, s.ratio, s.top) == (2, 1, 0.5, "a/scanner.py")
    assert [r.x for r in df.select(Y.excluded(F.lit("C:\\x\\NODE_MODULES\\y")).alias("x")).collect()] == [True, True]


def test_similarity(spark):
    rows = [(k, t.split()) for k, t in enumerate(["a b c d e f g h", "a b c d e f g h", "x y z", ""])]
    s = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert Y.signatures(s).where("id = 3").first().h7 == "0" * 16
    pairs = Y.candidates(Y.signatures(s.where(F.size("tokens") > 0)))
    assert [(r.l, r.r, r.similarity) for r in Y.jaccard(pairs, s, 0.65).collect()] == [(0, 1, 1.0)]


def test_churn_and_backlog(spark):
    stats = spark.createDataFrame([("p", "a.py", 3, 5), ("p", "b.py", 3, 5), ("p", "c.py", 0, 0)], "project string, rel_path string, functions long, edges long")
    churn = spark.createDataFrame([("p", "a.py", 20, 800, 400), ("p", "b.py", 1, 2, 1)], "project string, rel_path string, commits long, added long, removed long")
    got = C.churn_hotspots(stats, churn).collect()
    assert [r.rel_path for r in got] == ["a.py", "b.py", "c.py"] and got[2].weight == 1.0
    p = spark.createDataFrame([("A", "c:/dev/a", 10, 900, 1), ("B", "C:/DEV/b", 10, 900, 0), ("C", "c:/dev/c", 1, 10, 0)], "name string, path string, file_count int, line_count int, has_tests int")
    p = p.withColumns({c: F.lit(None).cast("int") for c in ("has_readme", "has_git", "has_ci_cd", "has_docs", "has_license")})
    done = spark.createDataFrame([("c:/dev/a",)], "source_path string")
    assert [r.name for r in C.backlog(p, done, 100, "c:/dev").collect()] == ["B"]
    assert [r.name for r in C.backlog(p, done, include_enriched=True).collect()] == ["A", "B", "C"]
    r = C.project_summary(spark.createDataFrame([(k,) for k in range(1, 11)], "v int"), "v", 9).first()
    assert (r.n, r.mean, r.largest, r.flagged, r.p95) == (10, 5.5, 10, 2, 9)


def test_relocation(spark):
    f = spark.createDataFrame([("a", "x", 1, "h", 1), ("b", "y", 1, "h", 1), ("c", "x", 1, "h", 0), ("d", "x", 1, "z", 1)], "path string, dest string, size int, hash string, inside int")
    t = spark.createDataFrame([("x", 1, "h")], "path string, size int, hash string")
    assert {(r.path, r.decision) for r in C.relocation(f, t).collect()} == {("a", "PURGE"), ("b", "RELOCATE"), ("c", "REJECTED"), ("d", "RELOCATE")}


def test_name_resolution(spark):
    calls = spark.createDataFrame([(1, "f"), (2, "g")], "id int, name string")
    defs = spark.createDataFrame([("f", "old", 1), ("f", "new", 2)], "name string, uid string, pos int")
    assert {(r.id, r.target) for r in V.resolve_last(calls, defs).collect()} == {(1, "new"), (2, "external:g")}
    imports = spark.createDataFrame([(1, "a.b"), (2, "pkg"), (3, "zzz"), (4, "Known")], "id int, module string")
    names = spark.createDataFrame([("Known", "n1")], "name string, uid string")
    files = spark.createDataFrame([("a/b.py", "f1"), ("pkg/__init__.py", "f2")], "path string, uid string")
    assert {(r.id, r.target) for r in V.resolve_imports(imports, names, files).collect()} == {(1, "f1"), (2, "f2"), (3, "external:zzz"), (4, "n1")}


def test_control_flow(spark):
    s = spark.createDataFrame([("f", "s1", 1, 1, "if x:"), ("f", "s2", 2, 2, "for y in x:"), ("f", "s3", 3, 3, "return y")], "fn string, statement string, lo int, pos int, code string")
    assert {tuple(r) for r in V.control_flow(s).collect()} == {("s1", "s2", "FLOWS_TO"), ("s2", "s3", "FLOWS_TO"), ("s3", "__exit__", "FLOWS_TO"), ("s1", "s2", "BRANCHES_TO"), ("s2", "s2", "FLOWS_TO"), ("s3", "__exit__", "RETURNS_TO")}
