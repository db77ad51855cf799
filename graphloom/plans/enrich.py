"""Enrichment of catalogs: folders of projects, chunked scans, campaigns, the whole ingestion."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pyparse import function_info, import_rows, parse_files
from graphloom.operators import catalog as C
from graphloom.operators import extract as E
from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import signals as N
from graphloom.operators import similarity as Y
from graphloom.operators import trees as R
from graphloom.operators.intervals import first_by_path
from graphloom.sources.files import Project, Settings, scan
from graphloom.storage import exists, list_names, read_text, write_table, write_text

#: Keys of the catalog's tables.
TABLES = {
    "enrichment": ["source_path"], "file_signals": ["source_path", "path"], "project_signals": ["source_path"], "project_intelligence": ["source_path"],
    "dependency_edges": ["source_path", "file_path", "import_name"], "call_edges": ["source_path", "caller_uid", "callee_name"], "complexity_nodes": ["source_path", "function_uid"],
    "similarity_pairs": ["source_path", "pair_type", "l", "r"],
}
#: Folders that a chunked scan leaves out.
LEFT_OUT = (".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", "site-packages")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


# --- catalog tables in versioned folders ----------------------------------------


def read_catalog(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A table of the catalog, with the columns that older versions lack."""
    v = read_text(spark, f"{out}/{name}/LATEST")
    if not v:
        return None
    df = spark.read.parquet(f"{out}/{name}/{v.strip()}")
    return I.evolved(df) if name == "enrichment" else df


def write_catalog(spark: SparkSession, out: str, name: str, rows: DataFrame, append: bool = False) -> None:
    """Write the rows of some projects: in place of the old rows of these, or beside them."""
    old = read_catalog(spark, out, name)
    all_rows = rows if old is None else I.catalog_write(old, rows.select(*old.columns), TABLES[name], append)
    v = f"v{time.time_ns()}"
    all_rows.write.parquet(f"{out}/{name}/{v}")
    write_text(spark, f"{out}/{name}/LATEST", v)


def subfolders(spark: SparkSession, root: str, include: set[str] | None = None, exclude: set[str] | None = None) -> list[Project]:
    """Child folders of any file system as projects, without those that begin with '_' or '.'."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())
    return [Project(n, f"{root.rstrip('/')}/{n}") for n in found if n[0] not in "_." and (not include or n in include) and n not in (exclude or ())]


# --- reports of projects -----------------------------------------------------------


def collectors(files: DataFrame, least: float = 4.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Signals of the files (path, text) of a project, without excluded paths."""
    return Y.collector_signals(files.where(~Y.excluded(F.col("path"), (*Y.EXCLUDED, *exclude))), least)


def intelligence(files: DataFrame, file_similarity: float = 0.65, function_similarity: float = 0.8, most_files: int = 1000, most_functions: int = 2000, threshold: int = 10) -> dict[str, DataFrame]:
    """Dependencies, calls, complexity, similar files and functions, and their summary, of
    the files (path, rel_path, ext, text) of a project."""
    files = files.where(~Y.excluded(F.col("path")))
    info = write_table(function_info(files), "functions")
    info = info.withColumn("uid", F.concat_ws(":", "rel_path", "name", F.col("start_line").cast("string")))
    dependencies = N.dependency_rows(import_rows(files), N.top_modules(files))
    sites = info.select(F.col("uid").alias("src"), F.explode("calls").alias("callee"))
    calls = N.call_rows(sites, info.select("uid", "name", F.col("rel_path").alias("file_uid")))
    complexity = N.complexity_rows(info)
    items = write_table(info.select(F.col("uid").alias("id"), "body_hash", "tokens").dropDuplicates(["id"]), "items")
    functions = Y.function_pairs(items, function_similarity, most_functions)
    sets = write_table(info.groupBy(F.col("rel_path").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")), "tokens")
    near = Y.similar_pairs(sets, file_similarity)
    pairs = Y.ranked(near.withColumn("evidence", F.lit("token_jaccard")), most_files)
    depth = G.longest_depth(calls.where("callee_uid <> ''").select(F.col("caller_uid").alias("src"), F.col("callee_uid").alias("dst")))
    summary = N.summary(dependencies, calls, complexity, threshold).crossJoin(depth.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_call_chain_depth")))  # one row each
    return {
        "dependency_edges": dependencies, "call_edges": calls, "complexity_nodes": complexity, "project_intelligence": summary,
        "similarity_pairs": functions.withColumn("pair_type", F.lit("function")).unionByName(pairs.withColumn("pair_type", F.lit("file"))),
    }


def enrich_repository(spark: SparkSession, root: str, out: str, include: set[str] | None = None, exclude: set[str] | None = None, append: bool = False) -> list[dict]:
    """Scan every project of a folder, and write its enrichment, collectors and intelligence
    to the catalog. A project that fails is reported, and the next one goes on."""
    done = []
    for p in subfolders(spark, root, include, exclude):
        row = {"project": p.name, "path": p.root, "status": "completed"}
        try:
            files = write_table(scan(spark, [p]), "scan")
            events = E.events(parse_files(files))
            nodes = events.where("kind = 'node'").select("label", "uid").distinct()
            edges = events.where("kind = 'edge'").select("type", "src_uid", "dst_uid").distinct()
            one = lambda s, c, x, name: F.coalesce(F.sum(F.when(F.col(c) == x, F.col("n"))), F.lit(0)).cast("long").alias(name)  # noqa: E731, ARG005
            n = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("node_count"), *(one(None, "label", x, f"{x.lower()}_nodes") for x in ("Project", "File", "Function", "Symbol", "Module")))
            e = edges.groupBy("type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("edge_count"), *(one(None, "type", x, f"{x.lower()}_edges") for x in ("CONTAINS", "DEFINES", "CALLS", "IMPORTS", "CALLS_FUNCTION")))
            size = files.agg(F.count("*").alias("scan_file_count"), F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).cast("long").alias("line_count"))
            owner = [F.lit(p.root).alias("source_path"), F.lit(p.name).alias("source_project")]
            write_catalog(spark, out, "enrichment", I.evolved(size.crossJoin(n).crossJoin(e).select(*owner, "*", F.lit(now()).alias("updated_at"))), append)  # one row each
            signals = write_table(collectors(files.select("path", "text")), "collectors")
            write_catalog(spark, out, "file_signals", signals.select(owner[0], "*"), append)
            write_catalog(spark, out, "project_signals", Y.collector_summary(signals).select(owner[0], "*"), append)
            for name, rows in intelligence(files).items():
                write_catalog(spark, out, name, rows.select(owner[0], "*"), append)
        except Exception as x:  # the report says what failed
            row |= {"status": "failed", "error": str(x)[:500]}
        done.append(row)
    return done


def campaign(spark: SparkSession, out: str, root: str, limit: int = 5, least_lines: int = 500, execute: bool = False, include_enriched: bool = False, stop_on_error: bool = False) -> list[dict]:
    """The largest projects of a folder that the catalog lacks, planned or enriched."""
    known = read_catalog(spark, out, "enrichment")
    rows = []
    for p in subfolders(spark, root):
        n = scan(spark, [p]).agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).cast("long"), F.count("*")).first()
        rows.append((p.name, p.root, n[0], n[1]))
    projects = spark.createDataFrame(rows, "name string, path string, line_count long, file_count long")
    projects = projects.withColumns({c: F.lit(None).cast("long") for c in ("has_tests", "has_readme", "has_git", "has_ci_cd", "has_docs", "has_license")})
    ranked = C.backlog(projects, known, least_lines, include_enriched=include_enriched, limit=limit)
    step = (lambda p: enrich_repository(spark, root, out, {p["name"]})[0]["status"] == "completed") if execute else None
    return R.campaign([r.asDict() for r in ranked.collect()], lambda p: exists(spark, p), step, stop_on_error)


# --- chunked scans ------------------------------------------------------------------


def chunk_scan(spark: SparkSession, root: str, out: str, size: int = 6, exclude: tuple[str, ...] = (), most: int = 0, resume: bool = False, dry_run: bool = False) -> list[dict]:
    """Scan the folders of a root in chunks, a table for each; a resumed scan keeps the
    chunks that are there, a dry run only plans."""
    names = [n.name for n in subfolders(spark, root)]
    plan = C.chunk_plan(spark.createDataFrame([(n,) for n in names], "name string"), size, (*LEFT_OUT, *exclude), most).collect()
    done = []
    for k in sorted({r.chunk for r in plan}):
        folders = sorted((r.name for r in plan if r.chunk == k), key=lambda n: (n.lower(), n))
        path, row = f"{out}/chunk_{k:02d}", {"chunk": k, "folders": folders, "status": "planned"}
        if not dry_run:
            row["status"] = "reused" if resume and exists(spark, f"{path}/_SUCCESS") else "completed"
            if row["status"] == "completed":
                rows = scan(spark, [Project(n, f"{root.rstrip('/')}/{n}", (*LEFT_OUT, *exclude)) for n in folders])
                rows = rows.withColumn("rel_path", F.concat_ws("/", "project", "rel_path"))
                rows.withColumns({"chunk": F.lit(k), "pos": F.xxhash64("path")}).write.mode("overwrite").parquet(path)
        done.append(row)
    return done


def merged_scan(spark: SparkSession, out: str) -> DataFrame:
    """The chunks' rows, the first of each path."""
    return C.merge_chunks(spark.read.parquet(*(f"{out}/{n}" for n in list_names(spark, out) if n.startswith("chunk_"))))


# --- the whole ingestion ----------------------------------------------------------------


def ingest(spark: SparkSession, projects: list[Project], settings: Settings, semantic: bool = False) -> dict:
    """Parse, structure, property graph, metrics, gate and fingerprint in one go; with
    ``semantic`` also a vector for each function."""
    files = write_table(scan(spark, projects, settings), "scan")
    source = files.select(F.concat_ws(":", "project", "rel_path").alias("file"), "text")
    tree = write_table(R.flatten(source), "tree")
    events = write_table(E.events(parse_files(files)), "events")
    edges = events.where("type = 'CALLS_FUNCTION'").select(F.col("src_uid").alias("src"), F.col("dst_uid").alias("dst"))
    functions = first_by_path(events.where("label = 'Function'").withColumnRenamed("uid", "path").withColumn("pos", F.col("file_pos"))).select(F.col("path").alias("uid"))
    info = function_info(files.select(F.concat_ws(":", "project", "rel_path").alias("rel_path"), "ext", "text"))
    complexity = info.select(F.concat_ws(":", "rel_path", "name", F.col("start_line").cast("string")).alias("uid"), "complexity").dropDuplicates(["uid"])
    zero = F.lit(0).cast("long")
    m = G.fan_metrics(functions, edges).join(complexity, "uid", "left").join(G.longest_chain(edges), "uid", "left").join(G.in_cycle(edges).withColumn("cyclic", F.lit(True)), "uid", "left")
    m = m.select("uid", F.coalesce("complexity", F.lit(1)).alias("complexity"), "fan_in", "fan_out", "instability", F.coalesce("chain", zero).alias("chain"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    metrics = write_table(m.join(G.risk_flags(m), "uid"), "metrics")
    gate = G.quality_gate(metrics).first()
    mark = I.fingerprint(functions, edges).first()
    out = {
        "structure": R.structure(source, tree), "parents": R.parent_edges(tree), "flow": R.flow(tree), "metrics": metrics,
        "summary": {"files": files.count(), "functions": mark.n_nodes, "edges": mark.n_edges, "fingerprint": mark.fingerprint, "gate_passed": gate.passed, "violations": gate.violations},
    }
    if semantic:
        out["embeddings"] = R.embed(functions.withColumn("text", F.col("uid")))
    return out


class Monitor:
    """Times of phases, and whether they meet the goals."""

    def __init__(self) -> None:
        self.timings: dict[str, float] = {}

    @contextmanager
    def timed(self, label: str) -> Iterator[None]:
        t = time.perf_counter()
        try:
            yield
        finally:
            self.timings[label] = time.perf_counter() - t

    def report(self) -> dict[str, str]:
        """Times as text: milliseconds below a second, seconds below a minute."""
        plain = lambda s: f"{s * 1000:.1f}ms" if s < 1 else f"{s:.2f}s" if s < 60 else f"{int(s // 60)}m {s % 60:.1f}s"
        return {k: plain(s) for k, s in self.timings.items()}

    def goals(self) -> dict[str, bool]:
        """Ingestion within three minutes, queries within half a second."""
        out = {"ingest_under_3min": self.timings["ingestion"] < 180.0} if "ingestion" in self.timings else {}
        return out | {f"{k}_under_500ms": s < 0.5 for k, s in self.timings.items() if "query" in k.lower()}


def append_log(spark: SparkSession, path: str, line: str) -> None:
    """Add a line with its time to an audit log."""
    write_text(spark, path, f"{now()} {line}\n", append=True)
