"""Rows of a project's intelligence report: dependencies, calls, complexity, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_modules(files: DataFrame) -> DataFrame:
    """(top): first parts of the modules of Python files (rel_path)."""
    module = F.regexp_replace(F.regexp_replace("rel_path", r"(?i)\.py$", ""), "(^|/)__init__$", "")
    return files.where(F.lower("rel_path").endswith(".py")).select(F.element_at(F.split(module, "/"), 1).alias("top")).where("top <> ''").distinct()


def internal(module: Column, known: Column) -> Column:
    """Relative, or its first part is known; empty names are not."""
    return ((module != "") & (module.startswith(".") | known)).cast("int")


def dependency_rows(imports: DataFrame, tops: DataFrame) -> DataFrame:
    """(file_path, import_name, is_internal, import_count) of imports (file_path,
    import_name), repeats counted, the commonest first."""
    n = imports.groupBy("file_path", "import_name").agg(F.count("*").alias("import_count"))
    d = n.withColumn("top", F.split("import_name", "[.]")[0]).join(tops.withColumn("known", F.lit(True)), "top", "left")
    d = d.select("file_path", "import_name", internal(F.col("import_name"), F.coalesce("known", F.lit(False))).alias("is_internal"), "import_count")
    return d.orderBy(F.desc("import_count"), "file_path", "import_name")


def call_rows(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_uid, caller_file, callee_name, is_internal, callee_uid, call_count) of call
    sites (src, callee): internal if any function has the name, the uid if just one has."""
    n = sites.groupBy("src", "callee").agg(F.count("*").alias("call_count"))
    known = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("uid").alias("one"))
    d = n.join(functions.select(F.col("uid").alias("src"), "file_uid"), "src").join(known, "callee", "left")
    d = d.select(
        F.col("src").alias("caller_uid"), F.col("file_uid").alias("caller_file"), F.col("callee").alias("callee_name"), F.col("n").isNotNull().cast("int").alias("is_internal"),
        F.when(F.col("n") == 1, F.col("one")).otherwise("").alias("callee_uid"), "call_count",
    )
    return d.orderBy(F.desc("call_count"), "caller_uid", "callee_name")


def complexity_rows(info: DataFrame) -> DataFrame:
    """(function_uid, function_name, start_line, end_line, language, cyclomatic, call_count),
    the most complex first, of parsed functions."""
    d = info.select(
        F.concat_ws(":", "rel_path", "name", F.col("start_line").cast("string")).alias("function_uid"), F.col("name").alias("function_name"), "start_line", "end_line", "language",
        F.col("complexity").alias("cyclomatic"), F.size("calls").alias("call_count"),
    )
    return d.orderBy(F.desc("cyclomatic"), "function_uid")


def summary(dependencies: DataFrame, calls: DataFrame, complexity: DataFrame, threshold: int = 10) -> DataFrame:
    """One row: sizes of the parts, and mean (4 places), largest, 95th percentile (at the
    floor index) and number of high complexities."""
    by = complexity.groupBy("cyclomatic").agg(F.count("*").alias("n"))  # distinct values are few
    total = complexity.count()
    rows = sorted((r[0], r[1]) for r in by.collect())
    upto, p95 = 0, 0
    for value, n in rows:
        upto += n
        p95 = value
        if upto > int(0.95 * (total - 1)):
            break
    c = complexity.agg(
        F.count("*").alias("functions_analyzed"), F.coalesce(F.round(F.avg("cyclomatic"), 4), F.lit(0.0)).alias("avg_cyclomatic"), F.coalesce(F.max("cyclomatic"), F.lit(0)).cast("long").alias("max_cyclomatic"),
        F.count_if(F.col("cyclomatic") >= threshold).alias("high_complexity_functions"),
    ).withColumn("p95_cyclomatic", F.lit(float(p95)))
    d = dependencies.agg(F.count("*").alias("dependency_edges"))
    k = calls.agg(F.count("*").alias("call_edges"), F.coalesce(F.sum("is_internal"), F.lit(0)).cast("long").alias("internal_call_edges"))
    return c.crossJoin(d).crossJoin(k)  # one row each
