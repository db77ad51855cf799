"""Queries of catalogs, of record formats, and of the read-only guard."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import catalog as C
from graphloom.operators import incremental as I
from graphloom.operators import trees as R
from graphloom.plans import guard
from graphloom.plans.base import query
from graphloom.sources import files as S
from graphloom.storage import own_dir

_ROWS = "old AS (SELECT c_nationkey AS source_path, c_custkey AS file, 'old' AS v FROM customer WHERE c_custkey % 2 = 0), nw AS (SELECT c_nationkey AS source_path, c_custkey AS file, 'new' AS v FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12)"


def _rows(t):
    c = t["customer"].select(F.col("c_nationkey").alias("source_path"), F.col("c_custkey").alias("file"))
    return c.where("file % 2 = 0").withColumn("v", F.lit("old")), c.where("file % 3 = 0 and source_path < 12").withColumn("v", F.lit("new"))


@query("SELECT * FROM nw UNION ALL SELECT * FROM old WHERE source_path NOT IN (SELECT source_path FROM nw)", _ROWS)
def catalog_replace(t):
    return I.catalog_write(*_rows(t), ["source_path", "file"])


@query("SELECT * FROM nw UNION ALL SELECT * FROM old WHERE file NOT IN (SELECT file FROM nw)", _ROWS)
def catalog_append(t):
    return I.catalog_write(*_rows(t), ["source_path", "file"], append=True)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS summary_artifact, '' AS fingerprint, '{}' AS performance_json FROM supplier")
def catalog_evolved(t):
    return I.evolved(t["supplier"].select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("summary_artifact")))


@query("SELECT c_name AS name, 'c:/dev/' || c_custkey AS path, (c_acctbal::BIGINT + 1000)::BIGINT AS line_count, 0 AS already_enriched, round((c_acctbal::BIGINT + 1000) / 5000.0::DOUBLE, 3) AS score FROM customer WHERE c_acctbal::BIGINT + 1000 >= 500 ORDER BY (c_acctbal::BIGINT + 1000) / 5000.0::DOUBLE DESC, line_count DESC, path LIMIT 20")
def backlog_without_enrichment(t):
    k = F.col("c_custkey")
    p = t["customer"].select(F.col("c_name").alias("name"), F.concat(F.lit("c:/dev/"), k.cast("string")).alias("path"), (F.bround("c_acctbal", 0).cast("long") + 1000).alias("line_count"), *(F.lit(None).cast("long").alias(c) for c in ("file_count", "has_tests", "has_readme", "has_git", "has_ci_cd", "has_docs", "has_license")))
    return C.backlog(p, None, 500)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS planned, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus NOT IN ('P', 'F', 'O')) AS skipped_missing_path FROM orders")
def status_tallies(t):
    names = F.create_map(*(F.lit(x) for x in ("P", "planned", "F", "completed", "O", "failed")))
    return I.tallies(t["orders"].select(F.coalesce(names[F.col("o_orderstatus")], F.lit("skipped_missing_path")).alias("status")))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def newest_records(t):
    return I.newest_first(t["orders"].select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT count(*) AS rows_total, count(*) FILTER (p_partkey % 4 < 2) AS cache_hits, count(*) FILTER (p_partkey % 4 >= 2) AS cache_misses, sum(p_size)::BIGINT AS events_total FROM part")
def extract_counters(t):
    rows = t["part"].select(F.col("p_partkey").cast("string").alias("path"), F.sha1("p_name").alias("hash"), F.col("p_size").alias("events"), "p_partkey")
    # of the cached rows some are of the other mode, some of another text
    mode = F.when(F.col("p_partkey") % 4 == 2, "relations-off").otherwise("relations-on")
    cache = rows.select(F.concat_ws("|", "path", mode).alias("cache_key"), F.when(F.col("p_partkey") % 4 == 3, "other").otherwise(F.col("hash")).alias("hash"))
    return I.extract_counters(rows.drop("p_partkey"), cache)


_DIRS = "dr AS (SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || p_type || ' ' || p_size AS name FROM part WHERE p_type <> 'SMALL')"


@query("SELECT name, ((row_number() OVER (ORDER BY lower(name), name) - 1) // 6 + 1)::INT AS chunk FROM dr WHERE NOT starts_with(name, '.')", _DIRS)
def chunk_plan(t):
    d = t["part"].where("p_type <> 'SMALL'")
    return C.chunk_plan(d.select(F.concat(F.when(F.col("p_partkey") % 7 == 0, ".").otherwise(""), "p_type", F.lit(" "), F.col("p_size").cast("string")).alias("name")))


@query("SELECT p_partkey AS path, CASE WHEN n = 0 THEN dest ELSE replace(dest, '.py', '_recovered_' || n || '.py') END AS target FROM (SELECT p_partkey, dest, row_number() OVER (PARTITION BY dest ORDER BY p_partkey) - 1 + (p_size % 2 = 0)::INT AS n FROM (SELECT p_partkey, p_size, p_type || '/' || p_size || '.py' AS dest FROM part))")
def numbered_targets(t):
    p = t["part"].select(F.col("p_partkey").alias("path"), F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit(".py")).alias("dest"), "p_size")
    return C.numbered_targets(p.select("path", "dest"), p.where("p_size % 2 = 0").select(F.col("dest").alias("path")))


_ORPHANS = "oi AS (SELECT p_partkey, 'C:/' || CASE WHEN p_partkey % 3 = 0 THEN 'Other' ELSE 'Dev' END || '/' || p_name || p_partkey AS path, CASE WHEN p_partkey % 5 > 0 THEN (p_size % 2)::INT END AS safe FROM part)"


@query("SELECT path, CASE WHEN NOT contains(lower(path), 'c:/dev') THEN 'EXTERNAL' WHEN safe IS NULL THEN 'UNKNOWN' WHEN safe = 1 THEN 'PURGE' ELSE 'KEEP' END AS decision FROM oi", _ORPHANS)
def purge_decisions(t):
    k = F.col("p_partkey")
    o = t["part"].select(F.concat(F.lit("C:/"), F.when(k % 3 == 0, "Other").otherwise("Dev"), F.lit("/"), "p_name", k.cast("string")).alias("path"), (F.col("p_size") % 2).cast("int").alias("safe"), k)
    return C.purge_decision(o.select("path"), o.where("p_partkey % 5 > 0").select(F.upper("path").alias("path"), "safe"), "c:/DEV")


# --- record formats ---------------------------------------------------------------


def _folder(t, name: str) -> str:
    return f"{own_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_lines(t):
    path, d = _folder(t, "jsonl"), t["customer"].select("c_custkey", F.col("c_name"), "c_mktsegment")
    S.write_jsonl(d, path)
    return S.read_jsonl(t.spark, path, d.schema)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_report(t):
    path, d = _folder(t, "csv"), t["nation"].select("n_nationkey", "n_name")
    S.write_csv(d, path)
    return t.spark.read.option("header", True).csv(path)


@query("SELECT s_suppkey, 'S' || s_suppkey AS name, '1' AS a, 'new' AS b FROM supplier")
def merged_properties(t):
    """Property maps merged key by key, through JSON and back."""
    kind = "map<string,string>"
    d = t["supplier"].select("s_suppkey", F.create_map(F.lit("name"), F.lit("?"), F.lit("a"), F.lit("1"), F.lit("b"), F.lit("old")).alias("x"), F.create_map(F.lit("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.lit("b"), F.lit("new")).alias("y"))
    d = d.select("s_suppkey", F.from_json(F.to_json(I.merged_maps(F.col("x"), F.col("y"))), kind).alias("m"))
    return d.select("s_suppkey", *(F.col("m")[k].alias(k) for k in ("name", "a", "b")))


# --- statements that are given, and what has to come out ----------------------------

_STATEMENTS = (
    ("SELECT 1", 1), ("MATCH (n) RETURN n", 1), ("// note\nSELECT 2", 1), ("SELECT 'drop table x'", 1), ("MATCH (n) SET n.x = 1", 0), ("SELECT 1; DROP TABLE x", 0), ("/* c */ DELETE FROM x", 0),
    ("CALL dbms.shutdown()", 0), ("MATCH (n) FOREACH (x IN [1] | SET n.y = x)", 0), ("", 0), ("UPDATE x SET y = 1", 0),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', {ok})" for s, ok in _STATEMENTS) + ") v(statement, allowed)")
def guard_verdicts(t):
    return t.spark.createDataFrame([(s, int(guard.is_read_only(s))) for s, _ in _STATEMENTS], "statement string, allowed int")


@query("SELECT * FROM (VALUES ('SELECT 1', 'SELECT 1 LIMIT 1000'), ('SELECT 1 LIMIT 5', 'SELECT 1 LIMIT 5'), ('SELECT 1;', 'SELECT 1 LIMIT 1000')) v(statement, limited)")
def guard_limits(t):
    return t.spark.createDataFrame([(s, guard.with_limit(s)) for s in ("SELECT 1", "SELECT 1 LIMIT 5", "SELECT 1;")], "statement string, limited string")


@query("SELECT 7 AS n, (SELECT count(*) > 7 FROM nation)::INT AS truncated")
def guarded_rows(t):
    t["nation"].createOrReplaceTempView("nation_rows")
    rows, cut = guard.rows(t.spark, "SELECT n_name FROM nation_rows", 7)
    return t.spark.createDataFrame([(len(rows), int(cut))], "n int, truncated int")


_KEYS = [("projects", ("path", "name")), ("enrichment", ("source_path",)), ("call_edges", ("caller_uid", "x"))]
_COLUMNS = {"projects": {"path", "name", "line_count"}, "enrichment": {"source_path", "updated_at"}, "call_edges": {"caller_uid", "x", "source_path"}}


@query("SELECT count(*) AS recommended, 3 AS present, 3 AS missing, 2 AS column_missing, 10 AS table_missing FROM (SELECT unnest(range(18)))")
def key_audit(t):
    got = [r[2] for r in R.key_audit(_KEYS, _COLUMNS)]
    names = ("present", "missing", "column_missing", "table_missing")
    return t.spark.createDataFrame([(len(got), *(got.count(n) for n in names))], "recommended long, " + ", ".join(f"{n} int" for n in names))
