from graphloom.operators import trees as Tr

SRC = "class A(Base):\n    def run(self):\n        x = 1\n        if x:\n            return x\n        for y in z:\n            f(y)\n\ndef g():\n    return 'lit'\n"


def test_tree_graph(spark):
    files = spark.createDataFrame([("p/a.py", SRC), ("b.py", "def broken("), ("c.py", None)], "file string, text string")
    n = Tr.flatten(files)
    assert {(r.file, r.functions, r.classes) for r in Tr.counts(n).collect()} == {("p/a.py", 2, 1), ("c.py", 0, 0)}
    rows = {(r.file, r.id): r for r in Tr.classify(n).collect()}
    assert {r.label for r in rows.values()} == {"Function", "Statement", "ControlStructure", "Call", "Variable", "Literal"}
    for e in Tr.parent_edges(n).collect():
        assert (e.file, e.src) in rows and (e.file, e.dst) in rows and e.src < e.dst
    kinds = [r.kind for r in Tr.flow(n).collect()]
    assert kinds.count("RETURNS_TO") == 2 and kinds.count("BRANCHES_TO") == 1 and kinds.count("FLOWS_TO") == 7
    s = {tuple(r) for r in Tr.structure(files, n).collect()}
    assert ("p/a.py:A:1", "Base", "INHERITS") in s and ("repository", "package:p", "CONTAINS") in s and ("package:.", "file:b.py", "CONTAINS") in s


def test_vectors_are_stable(spark):
    got = [r.embedding for r in Tr.embed(spark.createDataFrame([("a",), ("a",), (None,)], "text string"), dims=8).collect()]
    assert got[0] == got[1] != got[2] and abs(sum(x * x for x in got[0]) - 1) < 1e-5


def test_audit_and_campaign():
    cols = {"projects": {"path"}, "enrichment": {"source_path"}}
    a = {(t, k): s for t, k, s in Tr.key_audit([("projects", ("path", "name"))], cols)}
    assert a["projects", "path"] == "present" and a["enrichment", "source_path"] == "missing" and a["enrichment", "updated_at"] == "column_missing" and a["call_edges", "caller_uid"] == "table_missing" and len(a) == 18
    plan = Tr.campaign([{"path": "a"}, {"path": "b"}], lambda p: p == "a")
    assert [p["status"] for p in plan] == ["planned", "skipped_missing_path"]
    assert [p["status"] for p in Tr.campaign([{"path": "a"}, {"path": "b"}], lambda p: True, lambda p: p["path"] == "b", True)] == ["failed"]
