"""Commits of version-control text by its sentinels; a text's lines are neither sorted nor numbered."""

from pyspark.sql import functions as F

from graphloom.functions import pyparse as P
from graphloom.functions import text as X


def test_sentinels_of_any_place(spark):
    odd = "1\t1\ta\n COMMIT \n2\t-\ta\nCOMMIT\nCOMMIT\n3\t1\ta\n4\t1\tb\nxCOMMIT\nCOMMIT x\n5\t0\ta\nCOMMIT"
    d = spark.createDataFrame([("p", odd), ("q", "COMMIT\n1\t2\ta\\b\nCOMMIT\n1\t2\ta/b\n"), ("r", "COMMIT"), ("s", "")], "k string, text string")
    got = X.numstat(d, "k")
    assert {tuple(r) for r in got.collect()} == {("p", "a", 3, 11, 2), ("p", "b", 1, 4, 1), ("q", "a/b", 2, 2, 4)}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_functions_are_handed_over_in_parts(spark, monkeypatch):
    text = "".join(f"def f{k}(x):\n    return g{k}(x)\n" for k in range(7))
    d = spark.createDataFrame([("a", ".py", text), ("b", ".py", "?"), ("c", ".py", text)], "rel_path string, ext string, text string").coalesce(1)
    want = sorted(map(str, P.function_info(d).collect()))
    monkeypatch.setattr(P, "ROWS_AT_ONCE", 3)
    assert len(want) == 14 and sorted(map(str, P.function_info(d).collect())) == want
    assert P.function_info(d.where(F.lit(False))).count() == 0
