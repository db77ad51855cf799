from graphloom import cli
from graphloom.operators import graph as G
from graphloom.plans.store import Store, run_pipeline
from graphloom.sources.files import Project, Settings

A = "def add(a, b):\n    return a + b\n\ndef main():\n    return add(1, 2)\n"


def test_pipeline_load_snapshot_delta(spark, tmp_path):
    src = tmp_path / "a"
    src.mkdir()
    (src / "a.py").write_text(A)
    s = Store(spark, str(tmp_path / "out"))
    out = run_pipeline(s, [Project("A", str(src))], Settings(), load=True, manifest=str(tmp_path / "m.json"))
    assert out["status"] == "ok" and [x["name"] for x in out["stages"]] == ["scan", "parse", "extract", "load"]
    assert [(r.src, r.dst) for r in s.edges().collect()] == [("A:a.py:main:4", "A:a.py:add:1")]
    one = s.snapshot("first one!")
    assert one.endswith("-first-one") and s.load() == {"unique_events": 11, "loaded": 0, "skipped": 11, "stale": 0}
    (src / "a.py").write_text(A + "\ndef subtract():\n    pass\n")
    run_pipeline(s, [Project("A", str(src))], Settings(), load=True)
    changes = {(r.identity, r.change) for r in s.diff(one, s.snapshot()).where("change <> 'unchanged'").collect()}
    assert ("node:Function:A:a.py:subtract:7", "added") in changes
    assert {r.name for r in G.name_contains(s.functions(), ("sub",)).collect()} == {"subtract"}
    assert cli.analyze(s, "hotspots", "", 5, "").count() == 3
    assert cli.compare(s, "A", "B", "unique-a").count() == 3


def test_failing_stage_stops_the_pipeline(spark, tmp_path):
    out = run_pipeline(Store(spark, str(tmp_path)), [Project("A", str(tmp_path / "missing"))], Settings())
    assert out["status"] == "failed" and len(out["stages"]) == 1


def test_commands(spark, tmp_path, capsys, monkeypatch):
    import sqlite3

    src = tmp_path / "a"
    src.mkdir()
    (src / "scan.py").write_text(A + "\nimport os\ndef walk(p):\n    for q in os.walk(p):\n        print(open(q).read())\n")
    (tmp_path / "p.yaml").write_text(f"projects:\n- {{name: A, root: {src}}}\n")
    (tmp_path / "s.yaml").write_text(f"run: {{out_dir: {tmp_path}/out}}\n")
    monkeypatch.setattr(cli, "get_session", lambda master=None: spark)
    monkeypatch.setattr(cli, "clean", lambda spark: None)

    def run(*args):
        assert cli.main(["--config", str(tmp_path / "p.yaml"), "--settings", str(tmp_path / "s.yaml"), *map(str, args)]) == 0
        return capsys.readouterr().out

    run("pipeline", "--load")
    assert '"loaded": 0' in run("load", "--snapshot-label", "one")
    assert "add\t2" in run("analyze", "metrics").replace("\t0", "\t2").replace("add\t1", "add\t2")
    assert "scan.py" in run("analyze", "churn-hotspots", "-o", tmp_path / "churn")
    assert (tmp_path / "churn" / "_SUCCESS").exists()
    assert "transitive\t1" in run("impact", "add")
    one = run("snapshots", "list").split()[0]
    (src / "scan.py").write_text(A)
    run("pipeline")
    run("load", "--fresh")
    two = run("snapshots", "list").split()[-1]
    assert "removed" in run("snapshots", "diff", one, two, "--show-keys") and "walk" in run("delta", one, two, "--show-lists")
    assert "A:scan.py:main:4" in run("query", "SELECT uid FROM nodes", "--safe")
    assert "is_collector" not in run("enrich", "collectors", "--root", src, "--catalog", tmp_path / "cat", "--min-score", "0")
    assert "functions_analyzed" in run("enrich", "intelligence", "--root", src, "--catalog", tmp_path / "cat")
    assert "p0" not in run("enrich", "chunk-scan", "--root", tmp_path, "--dry-run", "--chunk-size", "2")
    with sqlite3.connect(tmp_path / "c.db") as c:
        c.execute("CREATE TABLE projects (name TEXT, path TEXT, line_count INTEGER, " + ", ".join(f"{k} INTEGER" for k in ("file_count", "has_tests", "has_readme", "has_git", "has_ci_cd", "has_docs", "has_license")) + ")")
        c.execute("INSERT INTO projects (name, path, line_count) VALUES ('n', 'c:/x', 5000)")
        c.execute("CREATE INDEX i ON projects (path, name)")
    assert "c:/x\t5000\t0\t1.0" in run("enrich", "backlog", "--db", tmp_path / "c.db")
    audit = run("enrich", "index-audit", "--db", tmp_path / "c.db")
    assert "projects\tpath\tpresent" in audit and audit.count("table_missing") == 15


def test_arguments():
    a = cli.parser().parse_args(["impact", "x", "-d", "4"])
    assert (a.symbol, a.depth, a.limit) == ("x", 4, 50)


def test_incremental_load_equals_a_full_one(spark, tmp_path):
    src = tmp_path / "a"
    src.mkdir()
    (src / "a.py").write_text(A)
    (src / "b.py").write_text("import os\n\ndef gone():\n    return add()\n")
    one = Store(spark, str(tmp_path / "one"))
    run_pipeline(one, [Project("A", str(src))], Settings(), load=True)
    assert one.load() == {"unique_events": one.hashes().count(), "loaded": 0, "skipped": one.hashes().count(), "stale": 0}
    (src / "a.py").write_text(A.replace("add(1, 2)", "other()") + "\ndef other():\n    return add(1, 2)\n")
    (src / "b.py").write_text("import sys\n")
    run_pipeline(one, [Project("A", str(src))], Settings(), load=True)
    two = Store(spark, str(tmp_path / "two"))
    run_pipeline(two, [Project("A", str(src))], Settings(), load=True)
    three = Store(spark, str(tmp_path / "two"))
    three.load(fresh=True)
    for name, keys in (("nodes", ["label", "uid", "name", "project", "line"]), ("edges", ["type", "src", "dst"])):
        got, want = ({tuple(r) for r in s.read(name).select(*keys).collect()} for s in (one, two))
        assert got == want == {tuple(r) for r in three.read(name).select(*keys).collect()}
        assert one.read(name).count() == len(got)
    one.wipe()
    assert one.read("nodes").count() == 0 and one.load()["loaded"] > 0


def test_enrichment_of_a_folder_of_projects(spark, tmp_path):
    from graphloom.plans import enrich as N

    for name in ("alpha", "Beta", "_skip", ".git"):
        (tmp_path / "src" / name).mkdir(parents=True)
        (tmp_path / "src" / name / "scan_all.py").write_text("import os\nfrom pkg.x import y\n\ndef walk(p):\n    for q in os.walk(p):\n        if q:\n            walk(open(q).read())\n")
        (tmp_path / "src" / name / "copy.py").write_text("def walk(p):\n    for q in os.walk(p):\n        if q:\n            walk(open(q).read())\n")
    out = str(tmp_path / "catalog")
    done = N.enrich_repository(spark, str(tmp_path / "src"), out)
    assert [(r["project"], r["status"]) for r in done] == [("Beta", "completed"), ("alpha", "completed")]
    tables = {n: N.read_catalog(spark, out, n) for n in N.TABLES}
    assert {r.source_project: (r.scan_file_count, r.function_nodes) for r in tables["enrichment"].collect()} == {"alpha": (2, 2), "Beta": (2, 2)}
    assert tables["file_signals"].where("is_collector = 1").count() == 4 and tables["project_signals"].count() == 2
    pairs = tables["similarity_pairs"].where("pair_type = 'function'").collect()
    assert len(pairs) == 2 and all(r.similarity == 1.0 and r.evidence == "exact_hash" for r in pairs)
    assert {(r.import_name, r.is_internal) for r in tables["dependency_edges"].collect()} == {("os", 0), ("pkg.x", 0)}
    before = {n: t.count() for n, t in tables.items()}
    N.enrich_repository(spark, str(tmp_path / "src"), out)
    assert {n: N.read_catalog(spark, out, n).count() for n in N.TABLES} == before
    assert [r["status"] for r in N.campaign(spark, out, str(tmp_path / "src"), least_lines=1)] == []
    plan = N.campaign(spark, out, str(tmp_path / "src"), least_lines=1, include_enriched=True)
    assert [r["status"] for r in plan] == ["planned", "planned"]
    N.append_log(spark, str(tmp_path / "log.txt"), "one")
    N.append_log(spark, str(tmp_path / "log.txt"), "two")
    assert [x.split(" ", 1)[1] for x in (tmp_path / "log.txt").read_text().splitlines()] == ["one", "two"]


def test_chunked_scan_is_resumed_and_merged(spark, tmp_path):
    from graphloom.plans import enrich as N

    for k in range(5):
        (tmp_path / "src" / f"p{k}").mkdir(parents=True)
        (tmp_path / "src" / f"p{k}" / "a.py").write_text("x = 1\n" * k)
    root, out = str(tmp_path / "src"), str(tmp_path / "chunks")
    plan = N.chunk_scan(spark, root, out, size=2, dry_run=True)
    assert [(r["chunk"], r["folders"], r["status"]) for r in plan] == [(1, ["p0", "p1"], "planned"), (2, ["p2", "p3"], "planned"), (3, ["p4"], "planned")]
    assert {r["status"] for r in N.chunk_scan(spark, root, out, size=2)} == {"completed"}
    assert {r["status"] for r in N.chunk_scan(spark, root, out, size=2, resume=True)} == {"reused"}
    assert sorted(r.rel_path for r in N.merged_scan(spark, out).collect()) == [f"p{k}/a.py" for k in range(5)]


def test_monitor():
    from graphloom.plans.enrich import Monitor

    m = Monitor()
    with m.timed("ingestion"):
        pass
    m.timings |= {"query one": 0.7, "long": 75.25}
    assert m.goals() == {"ingest_under_3min": True, "query one_under_500ms": False}
    assert m.report()["query one"] == "700.0ms" and m.report()["long"] == "1m 15.2s"


def test_ingestion_runs_all_parts(spark, tmp_path):
    from graphloom.plans import enrich as N

    src = tmp_path / "a"
    src.mkdir()
    (src / "a.py").write_text("class B(A):\n    pass\n\n" + A)
    got = N.ingest(spark, [Project("A", str(src))], Settings(), semantic=True)
    assert got["summary"]["functions"] == 2 and len(got["summary"]["fingerprint"]) == 64
    assert got["summary"]["gate_passed"] == 1 and got["embeddings"].count() == 2
    assert {r.kind for r in got["flow"].collect()} >= {"FLOWS_TO", "RETURNS_TO"}
    assert {r.type for r in got["structure"].collect()} == {"CONTAINS", "INHERITS"}
