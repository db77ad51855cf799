"""Flattened syntax trees: rows (file, id, parent, depth, pos, type, name, code, lo, hi), and
the property graph and package structure built from them."""

from __future__ import annotations

import ast
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.intervals import control_flow
from graphloom.schema import record

NODE = record(
    ("file", "string"), ("id", "long"), ("parent", "long"), ("depth", "int"), ("pos", "long"), ("type", "string"), ("name", "string"), ("code", "string"), ("lo", "int"), ("hi", "int")
)
MOST_CODE = 2000
#: Labels of the property graph by tree node type.
LABELS = {
    "Function": ("FunctionDef", "AsyncFunctionDef"),
    "Statement": ("Assign", "AugAssign", "AnnAssign", "Expr", "Return", "Delete", "Raise", "Assert", "Pass", "Import", "ImportFrom"),
    "ControlStructure": ("If", "For", "AsyncFor", "While", "Try", "With", "AsyncWith", "Match"),
    "Call": ("Call",), "Variable": ("Name", "arg"), "Literal": ("Constant",),
}


def segments(text: str):
    """``ast.get_source_segment`` of one text, whose lines are split once and not for each node."""
    lines = re.findall(r"(?s).*?(?:\r\n|\n|\r|\Z)", text)
    raw: dict[int, bytes] = {}

    def line(k: int) -> bytes:
        if k not in raw:
            raw[k] = lines[k].encode()
        return raw[k]

    def segment(node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None or getattr(node, "end_col_offset", None) is None:
            return ""
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return line(a)[node.col_offset : node.end_col_offset].decode()
        return "".join([line(a)[node.col_offset :].decode(), *lines[a + 1 : b], line(b)[: node.end_col_offset].decode()])

    return segment


def walk(file: str, text: str) -> Iterator[tuple]:
    """Preorder rows of a Python file's tree; nothing for text that isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    todo, n = [(tree, None, 0, 1)], 0
    n_lines, segment = text.count("\n") + 1, segments(text)
    while todo:
        node, parent, depth, line = todo.pop()
        me, n = n, n + 1
        lo = getattr(node, "lineno", line)
        hi = getattr(node, "end_lineno", None) or (n_lines if parent is None else lo)
        code = text if parent is None else segment(node) if hasattr(node, "lineno") else ""
        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "arg", None) or getattr(node, "attr", None)
        yield file, me, parent, depth, me, type(node).__name__, name if isinstance(name, str) else None, code if len(code) <= MOST_CODE else code[:MOST_CODE] + "...", lo, hi
        todo += [(c, me, depth + 1, lo) for c in reversed(list(ast.iter_child_nodes(node)))]


def flatten(files: DataFrame) -> DataFrame:
    """Tree rows of (file, text) rows."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=NODE.fieldNames())
        d["parent"] = d["parent"].astype("Int64")
        return d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for b in batches:
            for r in b.itertuples(index=False):
                rows += walk(r.file, r.text or "")
                if len(rows) >= 10_000:
                    yield frame(rows)
                    rows = []
        yield frame(rows)

    return files.select("file", "text").mapInPandas(run, NODE)


def counts(nodes: DataFrame) -> DataFrame:
    """Functions and classes of each file."""
    return nodes.groupBy("file").agg(F.count_if(F.col("type").isin(*LABELS["Function"])).alias("functions"), F.count_if(F.col("type") == "ClassDef").alias("classes"))


def classify(nodes: DataFrame) -> DataFrame:
    """Nodes with a label of the property graph; code is cut at 500 characters."""
    label = F.create_map(*(F.lit(x) for k, ts in LABELS.items() for t in ts for x in (t, k)))
    return nodes.withColumn("label", label[F.col("type")]).where("label is not null").withColumn("code", F.substring("code", 1, 500))


def _nearest(t: pa.Table) -> pa.Table:
    """Of one file's nodes (file, id, parent, ok): the nearest ``ok`` ancestor of each ``ok`` node."""
    ids, parent, ok = (t.column(c).to_pylist() for c in ("id", "parent", "ok"))
    above, good = dict(zip(ids, parent, strict=True)), {i for i, k in zip(ids, ok, strict=True) if k}
    found: dict = {None: None}
    for i in ids:
        path, p = [], i
        while p not in found:
            path.append(p)
            q = above.get(p)
            if q in good or q not in above:
                found[p] = q if q in good else None
                path.pop()
                break
            p = q
        for x in path:
            found[x] = found[p]
    rows = [(i, found[i]) for i in ids if i in good and found[i] is not None]
    return pa.table({"file": pa.array(t.column("file").to_pylist()[:1] * len(rows), pa.string()), "src": pa.array([r[1] for r in rows], pa.int64()), "dst": pa.array([r[0] for r in rows], pa.int64())})


def parent_edges(nodes: DataFrame) -> DataFrame:
    """(file, src, dst): each classified node under its nearest classified ancestor; a file's
    tree is walked in one task, as it was parsed."""
    known = F.col("type").isin(*(t for ts in LABELS.values() for t in ts))
    return nodes.select("file", "id", "parent", known.alias("ok")).groupBy("file").applyInArrow(_nearest, "file string, src long, dst long")


def _innermost(t: pa.Table) -> pa.Table:
    """Of one file's functions and statements (file, id, fn, lo, hi, pos, code): statements with
    their smallest function that holds their line and stands before them; of equals the
    last. Functions come and go by line, so a statement meets those that hold it."""
    c = {k: t.column(k).to_pylist() for k in ("id", "fn", "lo", "hi")}
    fns = sorted((lo, hi - lo, -i, hi) for i, f, lo, hi in zip(c["id"], c["fn"], c["lo"], c["hi"], strict=True) if f)
    todo = sorted((lo, i, k) for k, (i, f, lo) in enumerate(zip(c["id"], c["fn"], c["lo"], strict=True)) if not f)
    heap, n, at, own = [], 0, [], []
    for lo, i, k in todo:
        while n < len(fns) and fns[n][0] <= lo:
            heapq.heappush(heap, fns[n][1:])
            n += 1
        later = []
        while heap and (heap[0][2] < lo or -heap[0][1] >= i):
            x = heapq.heappop(heap)
            if x[2] >= lo:
                later.append(x)
        if heap:
            at.append(k)
            own.append(-heap[0][1])
        for x in later:
            heapq.heappush(heap, x)
    return t.select(["file", "id", "lo", "pos", "code"]).take(pa.array(at, pa.int64())).append_column("fn", pa.array(own, pa.int64()))


def flow(nodes: DataFrame) -> DataFrame:
    """Control flow between the statements of each innermost function."""
    c = classify(nodes).where(F.col("label").isin("Function", "Statement", "ControlStructure"))
    # control_flow reads the first 20 characters
    c = c.select("file", "id", (F.col("label") == "Function").alias("fn"), "lo", "hi", "pos", F.substring("code", 1, 20).alias("code"))
    s = c.groupBy("file").applyInArrow(_innermost, "file string, id long, lo int, pos long, code string, fn long")
    key = lambda x: F.concat_ws(":", "file", F.col(x).cast("string"))
    return control_flow(s.select(key("fn").alias("fn"), key("id").alias("statement"), "lo", "pos", "code"))


def structure(files: DataFrame, nodes: DataFrame, repository: str = "repository") -> DataFrame:
    """(src, dst, type): repository, packages (folders), files, their definitions, and
    INHERITS edges from classes to the names of their bases."""
    d = files.select("file").distinct().withColumn("package", F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise("."))
    edge = lambda s, t, k: [s.alias("src"), t.alias("dst"), F.lit(k).alias("type")]
    package, file = F.concat(F.lit("package:"), F.col("package")), F.concat(F.lit("file:"), F.col("file"))
    out = d.select(*edge(F.lit(repository), package, "CONTAINS")).distinct().union(d.select(*edge(package, file, "CONTAINS")))
    named = nodes.where(F.col("type").isin("ClassDef", *LABELS["Function"]))
    out = out.union(named.select(*edge(file, F.concat_ws(":", "file", "name", "lo"), "CONTAINS")))
    cls = named.where("type = 'ClassDef'").select("file", F.col("id").alias("parent"), "lo", F.col("name").alias("cls"))
    base = nodes.where(F.col("type").isin("Name", "Attribute")).select("file", "parent", F.col("name").alias("base"), F.col("lo").alias("blo"))
    inherits = cls.join(base, ["file", "parent"]).where("blo = lo")
    return out.union(inherits.select(*edge(F.concat_ws(":", "file", "cls", "lo"), F.col("base"), "INHERITS")))


def seeded_vector(text: str, dims: int = 384) -> list[float]:
    """A unit Gaussian vector from a stable hash of the text."""
    import hashlib

    v = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")).normal(size=dims)
    return (v / np.linalg.norm(v)).astype("float32").tolist()


def embed(rows: DataFrame, text: str = "text", dims: int = 384) -> DataFrame:
    """Rows with an ``embedding``; equal texts have equal vectors, made once for a batch."""

    @F.arrow_udf("array<float>")
    def vec(t: pa.Array) -> pa.Array:
        coded = t.fill_null("").dictionary_encode()
        table = np.array([seeded_vector(x, dims) for x in coded.dictionary.to_pylist()], np.float32).reshape(-1, dims)
        flat = table[coded.indices.to_numpy()].reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * dims), pa.array(flat))

    return rows.withColumn("embedding", vec(text))


#: The recommended keys of the catalog's tables, in their order.
RECOMMENDED = (
    ("projects", ("path",)),
    ("projects", ("line_count",)),
    ("projects", ("line_count", "path")),
    ("enrichment", ("source_path",)),
    ("enrichment", ("source_project",)),
    ("enrichment", ("updated_at",)),
    ("file_signals", ("source_path",)),
    ("file_signals", ("is_file_collector",)),
    ("file_signals", ("source_path", "is_file_collector")),
    ("file_signals", ("collector_score",)),
    ("project_signals", ("collector_ratio",)),
    ("project_intelligence", ("source_project",)),
    ("dependency_edges", ("source_path", "is_internal")),
    ("call_edges", ("source_path", "is_internal")),
    ("call_edges", ("caller_uid",)),
    ("complexity_nodes", ("source_path", "cyclomatic")),
    ("similarity_pairs", ("source_path", "pair_type")),
    ("similarity_pairs", ("similarity",)),
)


def key_audit(existing: list[tuple[str, tuple[str, ...]]], columns: dict[str, set[str]], recommended=RECOMMENDED) -> list[tuple[str, str, str]]:
    """(table, key, status): present if an existing key begins with the recommended one,
    else missing, or skipped for a missing table or column."""
    out = []
    for table, key in recommended:
        if table not in columns:
            status = "table_missing"
        elif not set(key) <= columns[table]:
            status = "column_missing"
        else:
            status = "present" if any(t == table and k[: len(key)] == key for t, k in existing) else "missing"
        out.append((table, ",".join(key), status))
    return out


def campaign(ranked: list[dict], exists, execute=None, stop_on_error: bool = False) -> list[dict]:
    """Plan or run one step for each ranked project: planned, skipped_missing_path,
    completed or failed."""
    out = []
    for p in ranked:
        if not exists(p["path"]):
            status = "skipped_missing_path"
        elif execute is None:
            status = "planned"
        else:
            status = "completed" if execute(p) else "failed"
        out.append({**p, "status": status})
        if status == "failed" and stop_on_error:
            break
    return out
