"""Queries of parsers, trees and text operators, over source files written from the parts.

A file is the parts of one brand, type and size; its text is made column by column, so
that SQL over the same table tells what the parsers have to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import pyparse as P
from graphloom.functions import text as X
from graphloom.operators import catalog as C
from graphloom.operators import graph as G
from graphloom.operators import intervals as V
from graphloom.operators import signals as N
from graphloom.operators import trees as R
from graphloom.plans.base import query


def _files(t, head, function, foot, ext: str):
    """(project, path, rel_path, ext, text): head, two or three lines for each part, foot."""
    d = t["part"].withColumn("rel_path", F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit(ext)))
    d = d.groupBy(F.col("p_brand").alias("project"), "rel_path", "p_type", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", function.alias("body")))).alias("fs"))
    return d.select("project", F.concat_ws(":", "project", "rel_path").alias("path"), "rel_path", F.lit(ext).alias("ext"), F.concat(head, F.array_join("fs.body", ""), foot).alias("text"))


def python_files(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    head = F.concat(F.lit("import os.path, m"), text(s % 3), F.lit(", "), "p_type", F.lit(".x"), text(s % 2), F.lit("\nfrom pkg.mod"), text(s % 2), F.lit(" import y\nfrom . import z\n"))
    body = F.when(k % 3 == 0, F.concat(F.lit("g"), text(k % 5), F.lit("(x)"))).when(k % 3 == 1, F.concat(F.lit("x.h"), text(k % 4), F.lit("(1) if x else 0"))).otherwise("1")
    function = F.concat(F.lit("def f"), text(k), F.lit("(x):\n    return "), body, F.lit("\n"))
    return _files(t, head, function, F.concat(F.lit("class C"), text(s), F.lit("(B"), text(s % 3), F.lit("):\n    pass\n")), ".py")


def js_files(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    head = F.concat(F.lit("import {a} from 'lib"), text(s % 4), F.lit("';\nconst q = require('req"), text(s % 3), F.lit("');\n"))
    function = F.concat(F.lit("function f"), text(k), F.lit("(a) {\n  return g"), text(k % 5), F.lit("(a) && a;\n}\n"))
    return _files(t, head, function, F.lit(""), ".js")


PY = """sf AS (SELECT p_brand AS project, p_brand || ':' || p_type || '/' || p_size || '.py' AS path, p_type || '/' || p_size || '.py' AS rel_path, p_type, p_size, p_partkey AS k,
  row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) - 1 AS i FROM part),
ff AS (SELECT path, any_value(project) AS project, any_value(rel_path) AS rel_path, any_value(p_type) AS p_type, any_value(p_size) AS p_size, count(*) AS n FROM sf GROUP BY path)"""


def _py(t):
    return G.settle(P.parse_files(python_files(t)))


@query("SELECT path, 'f' || k AS name, (4 + 2 * i)::INT AS line FROM sf", PY)
def python_functions(t):
    return _py(t).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.line")


@query("SELECT path, unnest(['os.path', 'm' || p_size % 3, p_type || '.x' || p_size % 2, 'pkg.mod' || p_size % 2]) AS module FROM ff", PY)
def python_imports(t):
    return _py(t).select("path", F.explode("imports").alias("module"))


@query("SELECT path, 'f' || k AS name, CASE k % 3 WHEN 0 THEN 'g' || k % 5 ELSE 'h' || k % 4 END AS callee FROM sf WHERE k % 3 < 2", PY)
def python_calls(t):
    return _py(t).select("path", F.explode("function_calls").alias("f")).select("path", "f.name", F.explode("f.calls").alias("callee"))


@query("SELECT path, 'python' AS language, (5 + 2 * n)::INT AS line_count, (SELECT count(*) FROM sf WHERE sf.path = ff.path AND k % 3 < 2)::INT AS calls FROM ff", PY)
def python_lines(t):
    return _py(t).select("path", "language", "line_count", F.size("calls").alias("calls"))


@query("SELECT count(*) AS files, sum(n)::BIGINT AS functions, sum(5 + 2 * n)::BIGINT AS lines FROM ff", PY)
def parse_totals(t):
    return C.summary_by_language(_py(t))["totals"]


@query("SELECT 'python' AS language, count(*) AS files FROM ff", PY)
def files_by_language(t):
    return C.summary_by_language(_py(t))["languages"]


@query("SELECT path, n AS n_functions FROM ff ORDER BY n DESC, path LIMIT 10", PY)
def files_with_most_functions(t):
    return C.summary_by_language(_py(t))["most_functions"]


@query("SELECT path, 5 + 2 * n AS line_count FROM ff ORDER BY n DESC, path LIMIT 10", PY)
def longest_files(t):
    return C.summary_by_language(_py(t))["longest"]


def _info(t, files):
    return G.settle(P.function_info(files(t).select(F.col("path").alias("rel_path"), "ext", "text")))


@query("SELECT path AS rel_path, 'f' || k AS name, (4 + 2 * i)::INT AS start_line, (5 + 2 * i)::INT AS end_line, CASE k % 3 WHEN 1 THEN 2 ELSE 1 END AS complexity, CASE k % 3 WHEN 0 THEN 'g' || k % 5 WHEN 1 THEN 'h' || k % 4 ELSE '' END AS calls, CASE k % 3 WHEN 0 THEN 'g' || k % 5 || ',x' WHEN 1 THEN 'h' || k % 4 || ',x' ELSE '' END AS tokens, sha1('deff' || k || '(x):return' || CASE k % 3 WHEN 0 THEN 'g' || k % 5 || '(x)' WHEN 1 THEN 'x.h' || k % 4 || '(NUM)ifxelseNUM' ELSE 'NUM' END) AS body_hash FROM sf", PY)
def python_signals(t):
    return _info(t, python_files).select("rel_path", "name", "start_line", "end_line", "complexity", F.array_join("calls", ",").alias("calls"), F.array_join("tokens", ",").alias("tokens"), "body_hash")


JS = PY.replace(".py'", ".js'")


@query("SELECT path, 'f' || k AS name, (3 + 3 * i)::INT AS line FROM sf", JS)
def js_functions(t):
    return P.parse_files(js_files(t)).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.line")


@query("SELECT path, 'f' || k AS name, (3 + 3 * i)::INT AS line_no FROM sf", JS)
def js_definitions(t):
    return X.js_definitions(js_files(t), "path")


@query("SELECT path, unnest(['lib' || p_size % 4, 'req' || p_size % 3]) AS module FROM ff", JS)
def js_imports(t):
    return X.js_imports(js_files(t), "path")


@query("SELECT path, unnest(['lib' || p_size % 4, 'req' || p_size % 3]) AS module FROM ff", JS)
def js_parsed_imports(t):
    return P.parse_files(js_files(t)).select("path", F.explode("imports").alias("module"))


@query("SELECT path AS rel_path, 'f' || k AS name, (3 + 3 * i)::INT AS start_line, (5 + 3 * i)::INT AS end_line, 2 AS complexity, 'f' || k || ',g' || k % 5 AS calls, sha1('functionf' || k || '(a){returng' || k % 5 || '(a)&&a;}') AS body_hash FROM sf", JS)
def js_signals(t):
    return _info(t, js_files).select("rel_path", "name", "start_line", "end_line", "complexity", F.array_join("calls", ",").alias("calls"), "body_hash")


# --- trees ---------------------------------------------------------------------


def _tree(t):
    return G.settle(R.flatten(python_files(t).select(F.col("path").alias("file"), "text")))


@query("SELECT path AS file, n AS functions, 1::BIGINT AS classes FROM ff", PY)
def tree_counts(t):
    return R.counts(_tree(t))


_LABELS = """lb AS (SELECT path AS file, label, sum(c)::BIGINT AS n FROM (
  SELECT path, unnest(['Function', 'Statement', 'Call', 'Variable', 'Literal']) AS label,
         unnest([1, 1, CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END, CASE WHEN k % 3 < 2 THEN 3 ELSE 1 END, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END]) AS c FROM sf
  UNION ALL SELECT path, 'Statement', 4 FROM ff UNION ALL SELECT path, 'Variable', 1 FROM ff) GROUP BY 1, 2 HAVING sum(c) > 0)"""


@query("SELECT file, label, n FROM lb", PY + ", " + _LABELS)
def tree_labels(t):
    return R.classify(_tree(t)).groupBy("file", "label").agg(F.count("*").alias("n"))


@query("SELECT path AS file, sum(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 3 END)::BIGINT AS n FROM sf GROUP BY 1", PY)
def tree_parents(t):
    return R.parent_edges(_tree(t)).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT kind, sum(c)::BIGINT AS n FROM (SELECT unnest(['FLOWS_TO', 'RETURNS_TO', 'BRANCHES_TO']) AS kind, unnest([1, 1, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END]) AS c FROM sf) GROUP BY 1", PY)
def control_flow(t):
    return R.flow(_tree(t)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM (SELECT DISTINCT 'CONTAINS' AS type, 'repository' AS a, project || ':' || p_type AS b FROM ff UNION ALL SELECT 'CONTAINS', p_type, path FROM ff UNION ALL SELECT 'CONTAINS', path, 'f' || k FROM sf UNION ALL SELECT 'CONTAINS', path, 'C' || p_size FROM ff UNION ALL SELECT 'INHERITS', path, 'B' || p_size % 3 FROM ff) GROUP BY 1", PY)
def package_structure(t):
    files = python_files(t).select(F.col("path").alias("file"), "text")
    return R.structure(files, _tree(t)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'B' || p_size % 3 AS base, project, string_agg('C' || p_size, ',' ORDER BY 'C' || p_size) AS impls, count(*) AS n FROM ff GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, base, project", PY)
def plugin_clusters(t):
    n = _tree(t).withColumn("project", F.substring_index("file", ":", 1))
    cls = n.where("type = 'ClassDef'").select("file", "project", F.col("id").alias("parent"), "name", "lo")
    base = n.where("type = 'Name'").select("file", "parent", F.col("name").alias("base"), F.col("lo").alias("at"))
    return G.plugin_clusters(cls.join(base, ["file", "parent"]).where("at = lo").select("name", "base", "project"))


#: Variables (two a line) and statements of orders: v1 = v2, or return v2.
_FLOW = """st AS (SELECT l_orderkey AS file, l_linenumber AS line, l_orderkey * 100 + l_linenumber * 10 AS id, min(l_suppkey) % 5 = 0 AS ret, 'v' || min(l_suppkey) % 3 AS a, 'v' || min(l_partkey) % 3 AS b FROM lineitem GROUP BY 1, 2),
vr AS (SELECT file, line, id + 1 AS id, id AS statement, 1 AS pos, a AS name, TRUE AS is_def FROM st WHERE NOT ret UNION ALL SELECT file, line, id + 2, id, 2, b, NOT ret AND a = b FROM st),
fl AS (SELECT *, last_value(CASE WHEN is_def THEN id END IGNORE NULLS) OVER (PARTITION BY file, name ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM vr)"""


@query("SELECT statement AS src, id AS dst, 'DEFINES' AS kind FROM fl WHERE is_def UNION ALL SELECT id, def_id, 'DATA_DEPENDS_ON' FROM fl WHERE NOT is_def AND def_id IS NOT NULL", _FLOW)
def data_flow(t):
    d = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    d = d.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("lo"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).alias("id"), (F.col("l_suppkey") % 5 == 0).alias("ret"), F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("a"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("b"))
    code = F.when(F.col("ret"), F.concat(F.lit("return "), "b")).otherwise(F.concat("a", F.lit(" = "), "b"))
    statements = d.select("file", "id", "lo", F.col("lo").alias("hi"), F.col("id").alias("pos"), code.alias("code"))
    left = d.where("not ret").select("file", (F.col("id") + 1).alias("id"), F.col("a").alias("name"), F.col("lo").alias("line"), F.lit(1).alias("pos"))
    right = d.select("file", (F.col("id") + 2).alias("id"), F.col("b").alias("name"), F.col("lo").alias("line"), F.lit(2).alias("pos"))
    return V.data_flow(left.union(right), statements)


# --- intelligence rows ----------------------------------------------------------


def _imports(t):
    return _py(t).select(F.col("path").alias("file_path"), F.explode("imports").alias("import_name"))


_DEP = PY + """, dp AS (SELECT path AS file_path, unnest(['os.path', 'm' || p_size % 3, p_type || '.x' || p_size % 2, 'pkg.mod' || p_size % 2]) AS import_name FROM ff),
dr AS (SELECT file_path, import_name, (split_part(import_name, '.', 1) IN (SELECT p_type FROM ff))::INT AS is_internal, count(*) AS import_count FROM dp GROUP BY 1, 2)"""


@query("SELECT * FROM dr ORDER BY import_count DESC, file_path, import_name", _DEP)
def dependency_rows(t):
    return N.dependency_rows(_imports(t), N.top_modules(python_files(t)))


@query("SELECT path || ':f' || k || ':' || (4 + 2 * i) AS function_uid, 'f' || k AS function_name, (4 + 2 * i)::INT AS start_line, (5 + 2 * i)::INT AS end_line, 'python' AS language, CASE k % 3 WHEN 1 THEN 2 ELSE 1 END AS cyclomatic, (k % 3 < 2)::INT AS call_count FROM sf ORDER BY cyclomatic DESC, function_uid", PY)
def complexity_rows(t):
    return N.complexity_rows(_info(t, python_files))


@query("SELECT project, rel_path AS file FROM ff WHERE p_size % 3 = 1 ORDER BY 1, 2", PY)
def importing_files(t):
    d = _py(t)
    return G.importing_files(d.select(F.col("path").alias("uid"), "project", "rel_path"), d.select(F.col("path").alias("uid"), F.explode("imports").alias("module")), "m1")


@query("SELECT path || '>' || module AS id, CASE WHEN module IN (SELECT replace(p_type || '.x' || p_size % 2, '.', '/') FROM ff) THEN module ELSE coalesce((SELECT min(x.path) FROM ff x WHERE x.rel_path = replace(module, '.', '/') || '.py'), 'external:' || module) END AS target FROM (SELECT path, unnest(['os.path', p_type || '.' || p_size]) AS module FROM ff)", PY)
def resolve_imports(t):
    f = python_files(t)
    ask = f.select("path", F.explode(F.array(F.lit("os.path"), F.regexp_replace(F.regexp_replace("rel_path", r"\.py$", ""), "/", "."))).alias("module"))
    first = f.groupBy(F.col("rel_path").alias("path")).agg(F.min("path").alias("uid"))
    names = f.select(F.lit("no such name").alias("name"), F.lit("x").alias("uid")).limit(0)
    return V.resolve_imports(ask.select(F.concat_ws(">", "path", "module").alias("id"), "module"), names, first)


# --- text ------------------------------------------------------------------------


def _notes(t):
    """A customer's note: a docstring, comment lines, and lines beyond the twentieth."""
    c = F.col("c_custkey")
    doc = F.when(c % 3 == 0, F.lit("")).otherwise(F.concat(F.when(c % 3 == 1, '"""\n ').otherwise("'''\n "), "c_name", F.when(c % 3 == 1, '\n"""\n').otherwise("\n'''\n")))
    text = F.concat(F.lit("head\n"), doc, F.lit("# in "), "c_mktsegment", F.lit("\n  // seen\n"), F.repeat(F.lit("line\n"), 18))
    return t["customer"].select("c_custkey", "c_name", text.alias("text"))


_NOTES = "nt AS (SELECT c_custkey, c_name, c_mktsegment, 'head' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '\"\"\"' || chr(10) || ' ' || c_name || chr(10) || '\"\"\"' || chr(10) ELSE '''''''' || chr(10) || ' ' || c_name || chr(10) || '''''''' || chr(10) END || '# in ' || c_mktsegment || chr(10) || '  // seen' || chr(10) || repeat('line' || chr(10), 18) AS text FROM customer)"


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS doc FROM customer")
def docstrings(t):
    return _notes(t).select("c_custkey", X.docstring(F.col("text")).alias("doc"))


@query("SELECT c_custkey, '# in ' || c_mktsegment || ' // seen' AS notes FROM customer")
def comments(t):
    return _notes(t).select("c_custkey", X.comments(F.col("text")).alias("notes"))


@query("SELECT c_custkey, concat_ws(chr(10), c_name, CASE WHEN c_custkey % 3 > 0 THEN c_name END, array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10))) AS summary FROM nt", _NOTES)
def summaries_with_names(t):
    return _notes(t).select("c_custkey", X.summary(F.col("c_name"), X.docstring(F.col("text")), F.col("text")).alias("summary"))


@query("SELECT c_custkey, repeat('line' || chr(10), 4) || 'line' AS last_lines FROM customer")
def last_lines(t):
    return _notes(t).select("c_custkey", X.tail(F.col("text"), 5).alias("last_lines"))


@query("SELECT DISTINCT p_name AS label, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN replace(p_name, ' ', '') || '_1' WHEN 2 THEN 'Entity' ELSE 'é' END AS safe, p_partkey % 4 AS kind FROM part")
def safe_labels(t):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("!_1"))).when(k == 2, "- -").otherwise("é:")
    return t["part"].select(F.col("p_name").alias("label"), X.safe_label(raw).alias("safe"), k.alias("kind")).distinct()


@query("SELECT DISTINCT p_name AS label, replace(p_name, ' ', '-') AS slug FROM part")
def slugs(t):
    return t["part"].select(F.col("p_name").alias("label"), X.slug(F.concat(F.lit("  -"), "p_name", F.lit("!! "))).alias("slug")).distinct()


@query("SELECT o_orderkey, CASE WHEN s < 1 THEN printf('%.1fms', s * 1000) WHEN s < 60 THEN printf('%.2fs', s) ELSE printf('%dm %.1fs', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) END AS took FROM (SELECT o_orderkey, (o_orderkey % 1000) * 0.25::DOUBLE AS s FROM orders)")
def durations(t):
    return t["orders"].select("o_orderkey", X.duration((F.col("o_orderkey") % 1000) * F.lit(0.25)).alias("took"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'cUSTOMER#0000_01%'")
def like_prefix(t):
    return t["customer"].where(X.like_prefix(F.col("c_name"), "cUSTOMER#0000_01")).select("c_custkey", "c_name")


@query("SELECT p_partkey, 'pkg.' || p_type || '.' || p_size AS modules, 'f' || p_partkey AS callee FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'a.b,c' || p_size, 'run' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, './lib' || p_size, 'deep' FROM part WHERE p_partkey % 3 = 2")
def import_texts(t):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    imp = F.when(k % 3 == 0, F.concat(F.lit("from pkg."), "p_type", F.lit("."), s, F.lit(" import x"))).when(k % 3 == 1, F.concat(F.lit("import a.b as q, c"), s)).otherwise(F.concat(F.lit("const x = require('./lib"), s, F.lit("')")))
    call = F.when(k % 3 == 0, F.concat(F.lit("f"), k.cast("string"), F.lit("(1, 2)"))).when(k % 3 == 1, "self.x.run (y)").otherwise("a.b.deep(c.d())")
    return t["part"].select("p_partkey", F.array_join(X.import_modules(imp), ",").alias("modules"), X.callee_name(call).alias("callee"))


@query("SELECT p_brand AS report, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS pos, p_name AS subject, 'C:/old/' || p_partkey AS location, CASE WHEN p_size % 2 = 0 THEN 'C:/new/' || p_type ELSE '' END AS home FROM part")
def report_blocks(t):
    k = F.col("p_partkey").cast("string")
    block = F.concat(F.lit("EVALUATING: "), "p_name", F.lit("\n  Current Location: C:/old/"), k, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n  RECOMMENDED HOME: C:/new/"), "p_type")).otherwise(""), F.lit("\n"))
    d = t["part"].groupBy(F.col("p_brand").alias("report")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))).alias("bs"))
    return X.report_blocks(d.select("report", F.concat(F.lit("preface\n"), F.array_join("bs.b", "")).alias("text")), "report")


@query("SELECT page_id, len(string_split(html, chr(10)))::INT AS lines, (length(html) - length(replace(html, chr(10), '')))::INT AS newlines FROM pages")
def page_lines(t):
    d = X.lines(t["pages"], "page_id", text="html").groupBy("page_id").agg(F.max("line_no").alias("lines"))
    return d.select("page_id", "lines", (F.col("lines") - 1).alias("newlines"))
