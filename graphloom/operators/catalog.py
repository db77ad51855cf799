"""Churn ranking, catalog backlog, scans of catalogs, relocation decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.incremental import first_wins


def churn_weight(lines: Column, commits: Column) -> Column:
    return 1 + F.log1p(lines) + 0.5 * F.log1p(commits)


def churn_hotspots(stats: DataFrame, churn: DataFrame, top: int = 25) -> DataFrame:
    """Files by coupling and churn: (1 + functions + edges) times the churn weight, which
    is 1 for files without churn; by rounded score, project, path."""
    c = churn.select("project", "rel_path", "commits", (F.col("added") + F.col("removed")).alias("lines"))
    zero = F.lit(0).cast("long")
    d = stats.join(c, ["project", "rel_path"], "left")
    weight = F.when(F.col("commits").isNull(), F.lit(1.0)).otherwise(churn_weight(F.col("lines"), F.col("commits")))
    d = d.withColumns({"weight": weight, "base": 1 + F.col("functions") + F.col("edges")})
    d = d.select("project", "rel_path", "functions", "edges", F.coalesce("commits", zero).alias("commits"), F.coalesce("lines", zero).alias("lines"), F.round("weight", 4).alias("weight"), F.round(F.col("base") * F.col("weight"), 4).alias("score"))
    return d.orderBy(F.desc("score"), "project", "rel_path").limit(top)


def file_stats(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, rel_path, functions, edges) for each file: edges leave its functions; a row
    of edges may stand for ``n`` of them."""
    edges = edges.select("src", (F.col("n") if "n" in edges.columns else F.lit(1)).cast("long").alias("w"))
    f = functions.groupBy("project", "rel_path").agg(F.count("*").alias("functions"))
    e = edges.join(functions.select(F.col("uid").alias("src"), "project", "rel_path"), "src").groupBy("project", "rel_path").agg(F.sum("w").alias("edges"))
    return f.join(e, ["project", "rel_path"], "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def backlog(projects: DataFrame, enrichment: DataFrame | None, least_lines: int = 1, prefix: str = "", include_enriched: bool = False, limit: int = 20) -> DataFrame:
    """Catalog projects by enrichment score; the prefix is compared without case. Without an
    enrichment table no project counts as enriched."""
    n = lambda c: F.coalesce(c, F.lit(0))
    score = n("line_count") / 5000.0 + n("file_count") / 40.0 + n("has_tests") * 3.0 + n("has_readme") + n("has_ci_cd") * 1.5 + n("has_docs") + n("has_license") * 0.5 + n("has_git")
    d = projects.where(n("line_count") >= least_lines)
    d = d.where(F.startswith(F.lower("path"), F.lit(prefix.lower()))) if prefix else d
    if enrichment is None:
        d = d.withColumn("already_enriched", F.lit(0))
    else:
        done = enrichment.select(F.col("source_path").alias("path"), F.lit(1).alias("already_enriched")).distinct()
        d = d.join(done, "path", "left").withColumn("already_enriched", F.coalesce("already_enriched", F.lit(0)))
    d = d if include_enriched else d.where("already_enriched = 0")
    d = d.withColumn("score", score).orderBy(F.desc("score"), F.desc("line_count"), "path").limit(limit)
    return d.select("name", "path", n("line_count").alias("line_count"), "already_enriched", F.round("score", 3).alias("score"))


def latest_artifact(enrichment: DataFrame, by: str, artifact: str, updated: str) -> DataFrame:
    """(path, artifact): the latest artifact of each path, compared without case."""
    return enrichment.where(F.col(artifact).isNotNull()).groupBy(F.lower(by).alias("path")).agg(F.max_by(artifact, F.struct(updated, artifact)).alias("artifact"))


def scan_artifact(enrichment: DataFrame | None, path: str, explicit: str = "") -> str | None:
    """The scan artifact of a project: the given one, else its latest in the catalog."""
    if explicit or enrichment is None:
        return explicit or None
    row = latest_artifact(enrichment, "source_path", "scan_artifact", "updated_at").where(F.col("path") == path.lower()).first()
    return row.artifact if row else None


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Rows (chunk, pos, path, ...) of chunked scans: the first of each path."""
    return first_wins(chunks, ["path"], [F.col("chunk"), F.col("pos")])


def relocation(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, decision): REJECTED outside of the boundary, PURGE if the target has the same
    size and hash, RELOCATE otherwise."""
    t = targets.select(F.col("path").alias("dest"), F.col("size").alias("_s"), F.col("hash").alias("_h"))
    same = (F.col("_s") == F.col("size")) & (F.col("_h") == F.col("hash"))
    decision = F.when(F.col("inside") == 0, "REJECTED").when(same, "PURGE").otherwise("RELOCATE")
    return files.join(t, "dest", "left").select("path", decision.alias("decision"))


def numbered_targets(moves: DataFrame, taken: DataFrame, mark: str = "recovered") -> DataFrame:
    """(path, target): moves (path, dest) in order of path; a target that is taken, by an
    existing file (path) or an earlier move, gets the next number before its suffix."""
    w = Window.partitionBy("dest").orderBy("path")
    d = moves.join(taken.select(F.col("path").alias("dest"), F.lit(1).alias("_t")).distinct(), "dest", "left")
    n = F.row_number().over(w) - 1 + F.coalesce("_t", F.lit(0))
    ext = F.regexp_extract("dest", r"[^/.](\.[^./]*)$", 1)
    base = F.col("dest").substr(F.lit(1), F.length("dest") - F.length(ext))
    return d.withColumn("_n", n).select("path", F.when(F.col("_n") == 0, F.col("dest")).otherwise(F.concat(base, F.lit(f"_{mark}_"), F.col("_n").cast("string"), ext)).alias("target"))


def purge_decision(orphans: DataFrame, impact: DataFrame, boundary: str) -> DataFrame:
    """(path, decision) of orphans: EXTERNAL outside of the boundary (without case), PURGE if
    no other file uses the file, KEEP if one does, UNKNOWN if the graph doesn't know it."""
    inside = F.contains(F.lower("path"), F.lit(boundary.lower()))
    known = impact.select(F.lower("path").alias("_p"), "safe").groupBy("_p").agg(F.min("safe").alias("safe"))
    d = orphans.withColumn("_p", F.lower("path")).join(known, "_p", "left")
    return d.select("path", F.when(~inside, "EXTERNAL").when(F.col("safe").isNull(), "UNKNOWN").when(F.col("safe") == 1, "PURGE").otherwise("KEEP").alias("decision"))


def chunk_plan(dirs: DataFrame, size: int = 6, exclude: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """(name, chunk) of top-level folders (name), sorted without case and dealt out in chunks
    of ``size``, without excluded names and those that begin with a dot."""
    if size < 1:
        raise ValueError("chunk size is at least 1")
    d = dirs.select("name").distinct().where(~F.startswith("name", F.lit(".")))
    d = d.where(~F.col("name").isin(*exclude)) if exclude else d
    n = d.withColumn("n", F.row_number().over(Window.orderBy(F.lower("name"), "name")))  # folders of one root are few
    n = n.where(F.col("n") <= most) if most else n
    return n.select("name", (F.floor((F.col("n") - 1) / size) + 1).cast("int").alias("chunk"))


def summary_by_language(files: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Of parsed files (path, language, line_count, functions): files by language, the first
    by number of functions and by lines, totals."""
    f = files.withColumn("n_functions", F.size("functions"))
    pick = lambda c: f.select("path", F.col(c).cast("long").alias(c)).orderBy(F.desc(c), "path").limit(top)
    return {
        "languages": f.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language"),
        "most_functions": pick("n_functions"), "longest": pick("line_count"),
        "totals": f.agg(F.count("*").alias("files"), F.sum("n_functions").alias("functions"), F.sum("line_count").cast("long").alias("lines")),
    }


def project_summary(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    """One row: count, mean (4 places), maximum, values of at least the threshold, and the
    value at the floor index of the 95th percentile."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))  # distinct values are few
    total = counts.agg(F.sum("n").alias("t")).first()[0] or 0
    run = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    p95 = run.where(F.col("upto") > int(0.95 * (total - 1))).agg(F.min("v").alias("p95"))
    a = rows.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("largest"), F.count_if(F.col(value) >= threshold).alias("flagged"))
    return a.crossJoin(p95)  # one row each
