"""Queries of graph reports, of call rows, and of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import extract as E
from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import links as L
from graphloom.operators import search as S
from graphloom.operators import semantic as M
from graphloom.operators import signals as N
from graphloom.operators import similarity as Y
from graphloom.operators import trees as R
from graphloom.plans.base import A, B, query
from graphloom.plans.workload import W1

SITES = """, sites AS (SELECT c.uid AS src, d.name AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN fn c ON c.line = a.l_partkey JOIN fn d ON d.line = b.l_partkey),
cr AS (SELECT src AS caller_uid, f.file_uid AS caller_file, callee AS callee_name, (k.n IS NOT NULL)::INT AS is_internal, CASE WHEN k.n = 1 THEN k.one ELSE '' END AS callee_uid, s.call_count
  FROM (SELECT src, callee, count(*) AS call_count FROM sites GROUP BY 1, 2) s JOIN fn f ON f.uid = s.src LEFT JOIN (SELECT name, count(*) AS n, min(uid) AS one FROM fn GROUP BY 1) k ON k.name = s.callee)"""


@query("SELECT * FROM cr ORDER BY call_count DESC, caller_uid, callee_name", W1 + SITES)
def call_rows(t):
    return N.call_rows(t.call_sites(), t.functions())


@query("SELECT (SELECT count(*) FROM fn) AS functions_analyzed, (SELECT round(avg(p_size), 4) FROM part) AS avg_cyclomatic, (SELECT max(p_size) FROM part)::BIGINT AS max_cyclomatic, (SELECT count(*) FROM part WHERE p_size >= 10) AS high_complexity_functions, (SELECT p_size FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) AS r FROM part) WHERE r = floor(0.95 * ((SELECT count(*) FROM part) - 1)) + 1)::DOUBLE AS p95_cyclomatic, (SELECT count(DISTINCT (file_uid, name)) FROM fn) AS dependency_edges, (SELECT count(*) FROM cr) AS call_edges, (SELECT sum(is_internal)::BIGINT FROM cr) AS internal_call_edges", W1 + SITES)
def intelligence_summary(t):
    f = t.functions()
    complexity = t["part"].select(F.col("p_size").alias("cyclomatic"))
    return N.summary(f.select("file_uid", "name").distinct(), N.call_rows(t.call_sites(), f), complexity)


@query("SELECT project, name, count(*) AS fan_in FROM edges JOIN fn ON fn.uid = edges.dst GROUP BY 1, 2 ORDER BY fan_in DESC, project, name LIMIT 20", W1)
def most_called(t):
    return L.most_called(t.links())


@query("SELECT callee AS shared_symbol FROM calls JOIN fn ON fn.uid = calls.src WHERE project IN ('{A}', '{B}') GROUP BY 1 HAVING count(DISTINCT project) = 2 ORDER BY 1 LIMIT 50", W1)
def shared_symbols(t):
    return G.shared_symbols(t.functions(), t.calls(), A, B)


@query("SELECT signature_hash, string_agg(uid, ',' ORDER BY uid) AS ids, count(*) AS n FROM fn GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, signature_hash LIMIT 50", W1)
def signature_groups(t):
    return G.signature_groups(t.functions())


@query("SELECT project, name, uid FROM fn ORDER BY 1, 2, 3 LIMIT 25", W1)
def function_listing(t):
    f = t.functions()
    return G.listing(f, [r[0] for r in f.select("project").distinct().collect()], 25)


@query("SELECT (SELECT count(*) FROM fn) AS total_nodes, 'Function' AS node_types, (SELECT count(*) FROM edges) AS total_relationships, 'CALLS_FUNCTION' AS relationship_types", W1)
def result_stats(t):
    return G.result_stats(t.functions().withColumn("label", F.lit("Function")), t.links().links.select(F.lit("CALLS_FUNCTION").alias("type"), "n"))


@query("SELECT uid, max(h)::BIGINT AS depth FROM walk GROUP BY 1", "inh AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 2 UNION ALL SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 4), walk(uid, h) AS (SELECT dst, 0 FROM inh UNION SELECT src, 1 FROM inh UNION SELECT i.src, w.h + 1 FROM walk w JOIN inh i ON i.dst = w.uid WHERE w.h > 0)")
def inheritance_depth(t):
    k = F.col("p_partkey")
    base = lambda n: t["part"].where(k >= n).select(k.alias("src"), F.floor(k / n).cast("long").alias("dst"))
    return G.inheritance_depth(base(3).union(base(5)))


@query("SELECT e.src, e.dst FROM edges e JOIN fn a ON a.uid = e.src AND a.line % 2 = 0 JOIN fn b ON b.uid = e.dst AND b.line % 2 = 0 UNION ALL SELECT e.src, e.dst FROM edges e JOIN fn a ON a.uid = e.src AND a.line % 2 = 0 JOIN fn b ON b.uid = e.dst AND b.line % 2 = 0", W1)
def create_edges(t):
    e = t.links().pairs(t.functions().where("line % 2 = 0"))
    return e.union(e)


@query("SELECT uid FROM (SELECT src AS uid FROM edges UNION SELECT dst FROM edges) WHERE uid NOT IN (SELECT uid FROM fn WHERE line % 3 > 0)", W1)
def ghost_nodes(t):
    return t.links().ends().join(t.functions().where("line % 3 > 0").select("uid"), "uid", "left_anti")


@query("SELECT 'node:Function:' || uid AS identity, sha256('{\"name\":\"' || name || '\",\"uid\":\"' || uid || '\"}') AS hash FROM fn", W1)
def event_hashes(t):
    return I.hashed(t.functions(), F.concat(F.lit("node:Function:"), "uid"), ["uid", "name"])


@query("SELECT kind, type, project, file, \"function\", line::INT AS line FROM (SELECT 'node' AS kind, 'Function' AS type, project, rel_path AS file, name AS \"function\", line FROM fn UNION ALL SELECT DISTINCT 'node', 'File', project, rel_path, NULL, NULL FROM fn)", W1)
def parsed_identities(t):
    f = t.functions()
    ids = f.select(F.concat(F.lit("node:Function:"), "uid").alias("identity")).union(f.select(F.concat(F.lit("node:File:"), "file_uid").alias("identity")).distinct())
    return I.parse_identity(ids).drop("identity")


@query("SELECT uid, 'Function' AS label, project, name, rel_path AS path FROM fn WHERE project = '{A}' AND contains(' ' || lower(name) || ' ', ' bolt ') ORDER BY uid LIMIT 20", W1)
def search_functions(t):
    return S.search(S.indexed(_nodes(t)), "bolt", "functions", A)


@query("SELECT 'symbol:' || callee AS uid, 'Symbol' AS label, '' AS project, callee AS name, '' AS path FROM (SELECT DISTINCT callee FROM calls) WHERE contains(' ' || lower(callee) || ' ', ' red ') ORDER BY uid LIMIT 20", W1)
def search_symbols(t):
    return S.search(S.indexed(_nodes(t)), "red", "symbols")


@query("SELECT uid, 'Function' AS label, project, name, rel_path AS path FROM fn WHERE contains(lower(name || ' ' || rel_path), 'olt econ') ORDER BY uid LIMIT 20", W1)
def search_strategy(t):
    # no token phrase holds it, so the index finds nothing and the scan answers
    n = _nodes(t)
    return S.find(n, S.indexed(n), "olt econ")


def _nodes(t):
    f = t.functions().select("uid", F.lit("Function").alias("label"), "project", "name", F.col("rel_path").alias("path"))
    s = t.calls().select("callee").distinct().select(F.concat(F.lit("symbol:"), "callee").alias("uid"), F.lit("Symbol").alias("label"), F.lit("").alias("project"), F.col("callee").alias("name"), F.lit("").alias("path"))
    return f.union(s)


_V = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0), n AS (SELECT count(*) AS n FROM v),
top AS (SELECT vec_id AS uid, round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)), 6) AS similarity FROM v, q ORDER BY list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)) DESC, 1 LIMIT 10),
ed AS (SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst FROM v, n), bw AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
h1 AS (SELECT DISTINCT bw.dst AS uid FROM top JOIN bw ON bw.src = top.uid), h2 AS (SELECT DISTINCT bw.dst AS uid FROM h1 JOIN bw ON bw.src = h1.uid)"""


@query("SELECT uid, similarity FROM top UNION ALL SELECT uid, 0.0 FROM (SELECT uid FROM h1 UNION SELECT uid FROM h2) WHERE uid NOT IN (SELECT uid FROM top)", _V)
def hybrid_retrieval(t):
    v = t["embeddings"]
    n = v.count()
    edges = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 1) % n).alias("dst"))
    got = M.hybrid(v, G.settle(edges), v.where("vec_id = 0").select("embedding").first()[0])
    return got.select("uid", F.round("similarity", 6).alias("similarity"))


@query()
def seeded_embeddings(t):
    return R.embed(t.functions().select("uid", F.col("name").alias("text"))).select("uid", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("SELECT url AS path, (contains(lower(url), '/en/') OR contains(lower(url), 'example.net'))::INT AS out FROM pages")
def excluded_paths(t):
    return t["pages"].select(F.col("url").alias("path"), Y.excluded(F.regexp_replace(F.upper("url"), "/", "\\\\"), ("/en/", "example.net")).cast("int").alias("out"))


@query("SELECT url, (list_has_any(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), ['en', 'de']))::INT AS out FROM pages")
def excluded_components(t):
    p = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return t["pages"].select("url", F.arrays_overlap(p, F.array(F.lit("en"), F.lit("de"))).cast("int").alias("out"))


@query("SELECT uid, CASE WHEN line % 4 = 0 THEN '.' ELSE dir END AS dir, CASE WHEN line % 4 = 0 THEN 'python' ELSE 'typescript' END AS language FROM fn", W1)
def path_parts(t):
    p = F.when(F.col("line") % 4 == 0, F.concat(F.col("line").cast("string"), F.lit(".PY"))).otherwise(F.concat("dir", F.lit("/"), F.col("line").cast("string"), F.lit(".tsx")))
    return t.functions().select("uid", E.parent_dir(p).alias("dir"), X.language(p).alias("language"))
