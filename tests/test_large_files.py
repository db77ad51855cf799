"""Trees of files with odd texts, and of files whose cost grew with the square of their size."""

import ast
import time

from pyspark.sql import functions as F

from graphloom.operators import trees as R

ODD = 'x = "é" + f(\n  "ü", g(1))\r\nclass A(B):\n    def a(self):\n        def b(): return 1\n        if b():\n            return b\n        return lambda: 2\n\x0cdef c(): pass; y = [i for i in "ö"]\nz = 1'


def test_segments_equal_ast():
    for text in (ODD, "x=1", "def f():\n    pass\n", "a = '''\n\n'''\rb = 2"):
        s = R.segments(text)
        for n in ast.walk(ast.parse(text)):
            if hasattr(n, "lineno"):
                assert s(n) == ast.get_source_segment(text, n)


def test_nearest_ancestors_and_innermost_functions(spark):
    d = spark.createDataFrame([("odd", ODD), ("two", "def f():\n    for i in x:\n        g(i)\n\ndef h(): return 1\n")], "file string, text string")
    n = R.flatten(d).cache()
    rows = {(r.file, r.id): r for r in n.collect()}
    known = {t: k for k, ts in R.LABELS.items() for t in ts}
    want, inner = set(), {}
    for (f, i), r in rows.items():
        if r.type in known:
            p = r.parent
            while p is not None and rows[f, p].type not in known:
                p = rows[f, p].parent
            if p is not None:
                want.add((f, p, i))
            if known[r.type] in ("Statement", "ControlStructure"):
                held = [(q.hi - q.lo, -q.id) for q in rows.values() if q.file == f and known.get(q.type) == "Function" and q.lo <= r.lo <= q.hi and q.id < i]
                if held:
                    inner[f"{f}:{i}"] = f"{f}:{-min(held)[1]}"
    assert {tuple(r) for r in R.parent_edges(n).collect()} == want
    got = R.flow(n).where("kind = 'FLOWS_TO'").collect()
    assert {r.src for r in got} == set(inner)
    assert sum(r.dst == "__exit__" for r in got) == len(set(inner.values()))
    for r in got:
        assert r.dst == "__exit__" or r.src == r.dst or inner[r.src] == inner[r.dst]


def test_a_file_of_many_functions():
    text = "".join(f"def f{k}(x):\n    return g(x)\n" for k in range(6000))
    t = time.perf_counter()
    assert sum(1 for _ in R.walk("f", text)) == 6000 * 7 + 1 + 6000 * 2
    assert time.perf_counter() - t < 20  # it took minutes when each node split the text


def test_embeddings_of_equal_texts(spark):
    d = spark.createDataFrame([(k, [None, "", "ab", "c"][k % 4]) for k in range(40)], "id long, text string")
    for r in R.embed(d, dims=8).collect():
        assert r.embedding == R.seeded_vector(r.text or "", 8)
    assert R.embed(d.limit(0)).select(F.size("embedding")).count() == 0
