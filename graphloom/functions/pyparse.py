"""Parsers that need Python workers: source text to structured facts, in Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import CALL, CALL_KEYWORDS, CALL_LIMIT, JS_FUNCTION, JS_IMPORT, JS_REQUIRE, SIGNAL_CALL_KEYWORDS
from graphloom.schema import PARSED, STRINGS, record

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Node types that each add one to a function's cyclomatic complexity.
BRANCHES = (
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.BoolOp, ast.comprehension, ast.Assert, ast.Match, ast.match_case,
)


def line_count(text: str) -> int:
    return len(text.splitlines())


def call_name(node: ast.Call) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def own_calls(fn: ast.AST) -> set[str]:
    """Names called in a function, without those of functions inside it."""
    out, todo = set(), deque(ast.iter_child_nodes(fn))
    while todo:
        n = todo.popleft()
        if isinstance(n, FUNCTIONS):
            continue
        if isinstance(n, ast.Call) and (name := call_name(n)):
            out.add(name)
        todo.extend(ast.iter_child_nodes(n))
    return out


def parse_python(text: str) -> dict:
    """Functions, imports, calls (repeats kept), and each function's own calls, in
    breadth-first order; text that isn't Python has only its lines."""
    out: dict = {"language": "python", "line_count": line_count(text), "functions": [], "imports": [], "calls": [], "function_calls": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    for n in ast.walk(tree):
        if isinstance(n, FUNCTIONS):
            out["functions"].append({"name": n.name, "line": n.lineno})
            out["function_calls"].append({"name": n.name, "line": n.lineno, "calls": sorted(own_calls(n))})
        elif isinstance(n, ast.Import):
            out["imports"] += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            out["imports"].append(n.module)
        elif isinstance(n, ast.Call) and (name := call_name(n)):
            out["calls"].append(name)
    return out


_JS = [re.compile(p) for p in (JS_FUNCTION, JS_IMPORT, JS_REQUIRE, CALL)]


def parse_js(text: str, language: str = "javascript") -> dict:
    """Line rules for JavaScript and TypeScript; no per-function calls."""
    out: dict = {"language": language, "line_count": line_count(text), "functions": [], "imports": [], "calls": [], "function_calls": []}
    define, imp, req, call = _JS
    for k, line in enumerate(text.splitlines(), 1):
        if m := define.search(line):
            out["functions"].append({"name": m[1], "line": k})
        if m := imp.search(line):
            out["imports"].append(m[1])
        out["imports"] += req.findall(line)
        out["calls"] += [c for c in call.findall(line) if c not in CALL_KEYWORDS]
    return out


def parse_any(ext: str, text: str) -> dict:
    """Dispatch by extension; unknown ones have only their lines."""
    if ext == ".py":
        return parse_python(text)
    if ext in (".js", ".jsx", ".ts", ".tsx"):
        return parse_js(text, "typescript" if ext.startswith(".ts") else "javascript")
    return {"language": "unknown", "line_count": line_count(text), "functions": [], "imports": [], "calls": [], "function_calls": []}


def parse_files(files: DataFrame) -> DataFrame:
    """AST rows of (project, path, rel_path, ext, text); imports are distinct and sorted."""
    keep = ["project", "path", "rel_path"]

    @F.pandas_udf(PARSED)
    def parsed(ext: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_any(e or "", t or "") for e, t in zip(ext, text, strict=True)], columns=PARSED.fieldNames())

    d = files.select(*keep, parsed("ext", "text").alias("p")).select(*keep, "p.*")
    return d.withColumn("imports", F.array_sort(F.array_distinct("imports")))


def cyclomatic(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node))


def tokens_of(node: ast.AST) -> set[str]:
    out = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            out.add(n.id.lower())
        elif isinstance(n, ast.Attribute):
            out.add(n.attr.lower())
    return out


def normalise(text: str) -> str:
    text = re.sub(r"#.*", "", text)
    text = re.sub(r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*')", "STR", text)
    return re.sub(r"\s+", "", re.sub(r"\b\d+(?:\.\d+)?\b", "NUM", text))


def match_brace(text: str, at: int) -> int:
    """Index behind the brace that closes the one at ``at``; the end if none does. Strings
    and comments are skipped."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//":
            i = text.find("\n", i)
            if i < 0:
                return n
        elif two == "/*":
            e = text.find("*/", i + 2)
            if e < 0:
                return n
            i = e + 1
        elif c in "\"'`":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return n


FUNCTION_INFO = record(("rel_path", "string"), ("name", "string"), ("start_line", "int"), ("end_line", "int"), ("language", "string"), ("complexity", "int"), ("calls", STRINGS), ("tokens", STRINGS), ("body_hash", "string"))

_BLOCK = re.compile(r"\bfunction\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*\{|\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{")


def functions_of(rel_path: str, ext: str, text: str) -> Iterator[dict]:
    """Signal facts of each function: span, complexity, calls with inner functions', tokens, body hash."""
    sha = lambda s: hashlib.sha1(s.encode("utf-8", "replace")).hexdigest()
    if ext == ".py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return
        lines = text.splitlines()
        for n in ast.walk(tree):
            if isinstance(n, FUNCTIONS):
                names = [c for x in ast.walk(n) if isinstance(x, ast.Call) and (c := call_name(x))]
                body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                yield {"rel_path": rel_path, "name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "language": "python", "complexity": cyclomatic(n), "calls": names, "tokens": sorted(tokens_of(n) | {c.lower() for c in names}), "body_hash": sha(normalise(body))}
        return
    found = [(m.start(), match_brace(text, m.end() - 1), m[1] or m[2]) for m in _BLOCK.finditer(text)] or [(0, len(text), "file_scope")]
    for s, e, name in found:
        body = text[s:e]
        names = [c for c in _JS[3].findall(body) if c not in SIGNAL_CALL_KEYWORDS][:CALL_LIMIT]
        score = 1 + len(re.findall(r"\bif\b|\bfor\b|\bwhile\b|\bcase\b|\bcatch\b", body)) + body.count("&&") + body.count("||") + len(re.findall(r"(?<!\?)\?(?!\.)", body))
        plain = re.sub(r"(?m)//.*?$|/\*[\s\S]*?\*/", "", body)
        plain = re.sub(r"`[\s\S]*?`|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "STR", plain)
        plain = re.sub(r"\s+", "", re.sub(r"\b\d+(?:\.\d+)?\b", "NUM", plain))
        yield {"rel_path": rel_path, "name": name, "start_line": text.count("\n", 0, s) + 1, "end_line": text.count("\n", 0, e) + 1, "language": "typescript" if ext.startswith(".ts") else "javascript", "complexity": score, "calls": names, "tokens": sorted({t.lower() for t in re.findall(r"[A-Za-z_]\w*", body)}), "body_hash": sha(plain)}


def signal_imports(ext: str, text: str) -> list[str]:
    """Imports of a file with repeats; relative ones of Python keep their dots."""
    if ext != ".py":
        return parse_any(ext, text)["imports"]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and (name := "." * n.level + (n.module or "")):
            out.append(name)
    return out


def import_rows(files: DataFrame) -> DataFrame:
    """(file_path, import_name) with repeats of (path, ext, text) files."""

    @F.pandas_udf("array<string>")
    def found(ext: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([signal_imports(e or "", t or "") for e, t in zip(ext, text, strict=True)])

    return files.select(F.col("path").alias("file_path"), F.explode(found("ext", "text")).alias("import_name"))


@F.udtf(returnType="name: string, line: int, calls: array<string>")
class SourceFunctions:
    """``SELECT * FROM source_functions(ext, text)``: functions of a source text."""

    def eval(self, ext: str, text: str):
        p = parse_any(ext or "", text or "")
        own = {(f["name"], f["line"]): f["calls"] for f in p["function_calls"]}
        for f in p["functions"]:
            yield f["name"], f["line"], own.get((f["name"], f["line"]), [])


def register(spark) -> None:
    """Make the parsers callable from SQL."""
    spark.udtf.register("source_functions", SourceFunctions)


#: Functions that a worker gathers before it hands them over.
ROWS_AT_ONCE = 5_000


def function_info(files: DataFrame) -> DataFrame:
    """Rows of ``FUNCTION_INFO`` for (rel_path, ext, text) files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for b in batches:
            for r in b.itertuples(index=False):
                for f in functions_of(r.rel_path, r.ext, r.text or ""):
                    rows.append(f)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pd.DataFrame(rows, columns=FUNCTION_INFO.fieldNames())
                        rows = []
        yield pd.DataFrame(rows, columns=FUNCTION_INFO.fieldNames())

    return files.select("rel_path", "ext", "text").mapInPandas(run, FUNCTION_INFO)
