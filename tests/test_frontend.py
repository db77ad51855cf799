import json
import sqlite3

from pyspark.sql import functions as F

from graphloom.functions import pyparse as P
from graphloom.functions import text as X
from graphloom.operators import extract as E
from graphloom.plans import guard
from graphloom.schema import HASHES
from graphloom.sources import files as S
from graphloom.streaming.incremental import load_stream, state

REPO_A = "def add(a, b):\n    return a + b\n\n\ndef add2(a, b):\n    return a\n\n\nclass BasePlugin:\n    def run(self):\n        pass\n"
REPO_B = "def add(a, b):\n    return a\n\n\ndef multiply(a, b):\n    return a\n\n\nclass One:\n    def run(self):\n        pass\n\n\nclass Two:\n    def run(self):\n        pass\n"


def scanned(spark, tmp_path, files):
    out = []
    for name, tree in files.items():
        for rel, text in tree.items():
            p = tmp_path / name / rel
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        out.append(S.Project(name, str(tmp_path / name), (".venv", "__pycache__")))
    return S.scan(spark, out, S.Settings(include_ext=(".py", ".js")))


def test_golden_repositories_give_twenty_events(spark, tmp_path):
    files = scanned(spark, tmp_path, {"DemoA": {"a.py": REPO_A, ".venv/x.py": "def no(): pass"}, "DemoB": {"b.py": REPO_B, "notes.txt": "x"}})
    assert sorted((r.project, r.rel_path) for r in files.collect()) == [("DemoA", "a.py"), ("DemoB", "b.py")]
    ast = P.parse_files(files)
    ev = E.events(ast)
    assert ev.count() == 20
    assert {r.type for r in ev.where("kind = 'edge'").collect()} == {"CONTAINS", "DEFINES"}
    names = [r.n for r in ev.where("label = 'Function'").select(F.col("props")["name"].alias("n")).collect()]
    assert sorted(names) == ["add", "add", "add2", "multiply", "run", "run", "run"]


def test_call_edges(spark, tmp_path):
    files = scanned(spark, tmp_path, {"D": {"mod.py": "def b():\n    return 1\ndef c():\n    return b()\n", "sub/other.py": "def d():\n    return b()\n"}})
    types = {(r.type, r.src_uid, r.dst_uid) for r in E.events(P.parse_files(files)).where("kind = 'edge'").collect()}
    assert ("CALLS_FUNCTION", "D:mod.py:c:3", "D:mod.py:b:1") in types
    assert ("CALLS", "D:mod.py:c:3", "symbol:b") in types
    assert not any(t == "CALLS_FUNCTION" and "other" in s for t, s, _ in types)  # another directory
    plain = {r.type for r in E.events(P.parse_files(files), relations=False).where("kind = 'edge'").collect()}
    assert plain == {"CONTAINS", "DEFINES", "CALLS_FUNCTION"}


def test_python_parser():
    got = P.parse_python("import os, sys as s\nfrom .x import y\nfrom a.b import c\nprint(1)\ndef f():\n    g(); o.h()\n    def inner():\n        k()\n")
    assert [f["name"] for f in got["functions"]] == ["f", "inner"]
    assert got["imports"] == ["os", "sys", "x", "a.b"]
    assert {c["name"]: c["calls"] for c in got["function_calls"]} == {"f": ["g", "h"], "inner": ["k"]}
    assert sorted(got["calls"]) == ["g", "h", "k", "print"]
    assert P.parse_python("def broken(:\n x")["functions"] == [] and P.parse_python("def broken(:\n x")["line_count"] == 2
    assert P.parse_any(".rb", "x\ny")["language"] == "unknown"


JS = "import fs from 'fs';\nconst p = require('path');\nfunction greet(name) {\n  if (name) { log(name); }\n}\nexport function add(a, b) { return a + b; }\nimport { Thing } from './thing'\n"


def test_js_rules_agree_in_sql_and_python(spark):
    got = P.parse_js(JS)
    df = spark.createDataFrame([(1, JS)], "id long, text string")
    assert [(f["line"], f["name"]) for f in got["functions"]] == [(r.line_no, r.name) for r in X.js_definitions(df, "id").orderBy("line_no").collect()] == [(3, "greet"), (6, "add")]
    assert sorted(got["imports"]) == sorted(r.module for r in X.js_imports(df, "id").collect()) == ["./thing", "fs", "path"]
    assert got["calls"] == df.select(X.calls(F.col("text")).alias("c")).first().c


def test_signal_facts(spark):
    py = "def bar():\n    return 1\n\ndef dup(x):\n    # note\n    return x + 1 if x and 2 or 3 else 'a'\n"
    js = "function alpha(x) { if (x && x.y) { beta('}'); } /* } */ }\nconst beta = (z) => { return z ?? helper(z) ? 1 : 2; }\n"
    df = spark.createDataFrame([("a.py", ".py", py), ("b.js", ".js", js), ("c.js", ".js", "x(1)")], "rel_path string, ext string, text string")
    got = {(r.rel_path, r.name): r for r in P.function_info(df).collect()}
    assert got["a.py", "bar"].complexity == 1 and got["a.py", "dup"].complexity == 4
    assert got["b.js", "alpha"].calls == ["alpha", "beta"] and got["b.js", "alpha"].end_line == 1
    assert "helper" in got["b.js", "beta"].calls and got["c.js", "file_scope"].calls == ["x"]
    assert P.match_brace("{ '}' /* } */ // }\n }x", 0) == 21 and P.match_brace("{ {", 0) == 3


def test_text_columns(spark):
    df = spark.createDataFrame([(1, 'x = 1\n# one\n"""Doc\nstring"""\n// two\npassword = "a"\neval(user)', "a/b/__init__.py", "import os as o, sys", "a.b.run(1)")], "id long, text string, path string, imp string, call string")
    r = df.select(X.docstring(F.col("text")).alias("d"), X.comments(F.col("text")).alias("c"), X.module_name(F.col("path")).alias("m"), X.import_modules(F.col("imp")).alias("i"), X.callee_name(F.col("call")).alias("n"), X.language(F.col("path")).alias("l"), E.parent_dir(F.lit("x.py")).alias("p")).first()
    assert (r.d, r.c, r.m, r.i, r.n, r.l, r.p) == ("Doc\nstring", "# one // two", "a.b", ["os", "sys"], "run", "python", ".")
    issues = X.lint(df, "id")
    assert sorted((x.severity, x.line_no) for x in issues.collect()) == [("HIGH", 7), ("LOW", 6)]
    assert X.severity_gate(issues).first().blocked == 1


def test_numstat(spark):
    text = "COMMIT\n10\t1\tsrc/a.py\n2\t3\tsrc\\b.py\nCOMMIT\n5\t1\tsrc/a.py\nCOMMIT\n-\t-\timg.png\n0\t2\tsrc/b.py\nbad line"
    got = {r.rel_path: (r.commits, r.added, r.removed) for r in X.numstat(spark.createDataFrame([("p", text)], "project string, text string"), "project").collect()}
    assert got == {"src/a.py": (2, 15, 2), "src/b.py": (2, 2, 5), "img.png": (1, 0, 0)}


def test_reports(spark):
    text = "EVALUATING: x.py\n Current Location: /a/x.py\n RECOMMENDED HOME: /b\nEVALUATING: y\nshort\n"
    got = X.report_blocks(spark.createDataFrame([(1, text)], "id long, text string"), "id").collect()
    assert [(r.subject, r.location, r.home) for r in got] == [("x.py", "/a/x.py", "/b")]


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "p.yaml").write_text("projects:\n- {name: a, root: '${ROOT_X:-/tmp}/q', exclude: [v]}\n- {name: b}\n- {name: c, root: /r, exclude: no}\n")
    assert S.load_projects(str(tmp_path / "p.yaml")) == [S.Project("a", "/tmp/q", ("v",)), S.Project("c", "/r")]
    (tmp_path / ".env").write_text("# c\nROOT_X='/env'\n")
    assert S.load_projects(str(tmp_path / "p.yaml"))[0].root == "/env/q"
    monkeypatch.setenv("ROOT_X", "/real")
    assert S.load_projects(str(tmp_path / "p.yaml"))[0].root == "/real/q"
    (tmp_path / "s.yaml").write_text("run: {out_dir: o, max_files: 3}\n")
    assert S.load_settings(str(tmp_path / "s.yaml")) == S.Settings("o", max_files=3)


def test_json_lines(spark, tmp_path):
    assert S.read_jsonl(spark, str(tmp_path / "none.jsonl"), HASHES).count() == 0
    (tmp_path / "x.jsonl").write_text('{"identity": "a", "hash": "1"}\n\n[1]\n{"identity": "é"}\n')
    assert sorted(r.identity for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), HASHES).collect()) == ["a", "é"]
    (tmp_path / "d.json").write_text(json.dumps({"a": 1}))
    assert S.read_document(str(tmp_path / "d.json")) == {"a": 1} and S.read_document(str(tmp_path / "no")) == {}


def test_sqlite_source(spark, tmp_path):
    db = str(tmp_path / "c.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE projects (name TEXT, path TEXT, line_count INTEGER, w REAL)")
        c.executemany("INSERT INTO projects VALUES (?, ?, ?, ?)", [(f"n{k}", f"/p/{k}", k, k / 2) for k in range(50)] + [(None, None, None, None)])
        c.execute("CREATE TABLE empty (a TEXT)")
    d = S.read_sqlite(spark, db, "projects")
    assert d.count() == 51 and d.agg(F.sum("line_count")).first()[0] == 1225
    assert S.read_sqlite(spark, db, "empty").count() == 0


def test_version_control(tmp_path):
    assert S.churn_text(str(tmp_path)) == ""
    assert S.churn_text("/x", "6.months", lambda c, d: " ".join(c)).split("--since=")[1].startswith("6 months")
    assert S.staged_files("/x", lambda c, d: "a.py\n\nb.py\n") == ["a.py", "b.py"]


def test_guard():
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM t", "/* x */ CREATE (n)", "CALL dbms.shutdown()", "FOREACH (x IN y | SET x.a = 1)", "MATCH (n) SET n.x = 1", ""):
        assert not guard.is_read_only(bad), bad
    for good in ("SELECT 'delete' FROM t", "// drop it\nMATCH (n) RETURN n", "WITH a AS (SELECT 1) SELECT * FROM a"):
        assert guard.is_read_only(good), good
    assert guard.with_limit("SELECT 1;") == "SELECT 1 LIMIT 1000" and guard.with_limit("SELECT 1 LIMIT 3") == "SELECT 1 LIMIT 3"


def test_stream(spark, tmp_path):
    src, st, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1")], HASHES).coalesce(1).write.parquet(src)
    load_stream(spark, src, st, ck).awaitTermination(60)
    spark.createDataFrame([("b", "2"), ("c", "1")], HASHES).coalesce(1).write.mode("append").parquet(src)
    load_stream(spark, src, st, ck).awaitTermination(60)
    assert {(r.identity, r.hash) for r in state(spark, st, 1).collect()} == {("a", "1"), ("b", "2"), ("c", "1")}


def test_scan_keeps_empty_and_hidden_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "__init__.py").write_text("")
    (tmp_path / "a b" / "x.py").write_text("x = 1")
    (tmp_path / "a b" / "_y.py").write_text("y = 1")
    (tmp_path / ".h" / "_i").mkdir(parents=True)
    (tmp_path / ".h" / "_i" / "z.py").write_text("z")
    (tmp_path / ".h" / "x").mkdir()
    (tmp_path / ".h" / "x" / "z.py").write_text("z")
    (tmp_path / "empty.txt").write_text("")
    got = {(r.rel_path, r.size, r.text) for r in S.scan(spark, [S.Project("p", str(tmp_path), ("_i",))]).collect()}
    assert got == {("a b/__init__.py", 0, ""), ("a b/x.py", 5, "x = 1"), ("a b/_y.py", 5, "y = 1"), (".h/x/z.py", 1, "z")}
    assert S.scan(spark, []).count() == 0


def test_parsers_from_sql(spark):
    from graphloom.functions.pyparse import import_rows, register

    register(spark)
    got = spark.sql("SELECT * FROM source_functions('.py', 'def f(x):\n  return g(x)\n')").collect()
    assert [(r.name, r.line, r.calls) for r in got] == [("f", 1, ["g"])]
    df = spark.createDataFrame([("a.py", ".py", "import os, re\nfrom ..x import y\nfrom . import z\nimport os"), ("b.js", ".js", "const q = require('k')"), ("c.py", ".py", None)], "path string, ext string, text string")
    assert sorted((r.file_path, r.import_name) for r in import_rows(df).collect()) == [("a.py", "."), ("a.py", "..x"), ("a.py", "os"), ("a.py", "os"), ("a.py", "re"), ("b.js", "k")]
