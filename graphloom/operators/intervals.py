"""Line-interval and name-resolution joins of parsed trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.incremental import first_wins


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, span): for each point (id, file, line) the smallest span (span, file, lo, hi)
    that holds its line; of equals the first span."""
    d = points.join(spans, "file").where("line between lo and hi")
    return d.groupBy("id").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "span")).alias("m")).select("id", "m.span")


def containing(points: DataFrame, statements: DataFrame) -> DataFrame:
    """(id, statement): the first statement in preorder (pos) that holds the point's line."""
    d = points.join(statements, "file").where("line between lo and hi")
    return d.groupBy("id").agg(F.min_by("statement", "pos").alias("statement"))


def following(ends: DataFrame, statements: DataFrame) -> DataFrame:
    """(id, statement): the first statement that begins after the line of each end."""
    d = ends.join(statements, "file").where("lo > line")
    return d.groupBy("id").agg(F.min(F.struct("lo", "pos", "statement")).alias("m")).select("id", "m.statement")


def last_definitions(uses: DataFrame) -> DataFrame:
    """(id, def_id): for rows (id, scope, name, line, pos, is_def) the last definition of
    the name before each use."""
    w = Window.partitionBy("scope", "name").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return uses.withColumn("def_id", F.last(F.when(F.col("is_def") == 1, F.col("id")), ignorenulls=True).over(w)).where("is_def = 0").select("id", "def_id")


def inside(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(span, n): nodes (node, file, line) inside each span's lines."""
    d = spans.join(nodes, "file").where("line between lo and hi").groupBy("span").agg(F.count("*").alias("n"))
    return spans.select("span").join(d, "span", "left").select("span", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def cfg_complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(span, complexity): max(1, E - N + 2) over nodes (node, span) and edges (src), where a
    row may stand for ``n`` edges; 1 without nodes."""
    rows = F.sum("w")
    edges = edges.select("src", (F.col("n") if "n" in edges.columns else F.lit(1)).cast("long").alias("w"))
    n = nodes.groupBy("span").agg(F.count("*").alias("n"))
    e = edges.join(nodes.select(F.col("node").alias("src"), "span"), "src").groupBy("span").agg(rows.alias("e"))
    return n.join(e, "span", "left").select("span", F.greatest(F.lit(1).cast("long"), F.coalesce("e", F.lit(0)) - F.col("n") + 2).alias("complexity"))


def resolve_last(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, target): calls (id, name) to the last definition (name, uid, pos), else External."""
    d = definitions.groupBy("name").agg(F.max_by("uid", "pos").alias("target"))
    return calls.join(d, "name", "left").select("id", F.coalesce("target", F.concat(F.lit("external:"), F.col("name"))).alias("target"))


def resolve_unique(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, callee, is_internal, callee_uid): internal if any function has the name in
    the caller's project; the uid only if exactly one has."""
    known = functions.groupBy("project", F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    src = functions.select(F.col("uid").alias("src"), "project")
    d = calls.join(src.hint("merge"), "src").join(known, ["project", "callee"], "left")
    return d.select("src", "callee", F.col("n").isNotNull().cast("int").alias("is_internal"), F.when(F.col("n") == 1, F.col("uid")).alias("callee_uid"))


def resolve_imports(imports: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target) of imports (id, module): by node name, then by file path candidates,
    else an external symbol."""
    path = F.replace("module", F.lit("."), F.lit("/"))
    d = imports.join(names.select(F.col("name").alias("module"), F.col("uid").alias("by_name")), "module", "left")
    for k, end in enumerate((".py", "/__init__.py", ".js")):
        d = d.withColumn(f"_p{k}", F.concat(path, F.lit(end))).join(files.select(F.col("path").alias(f"_p{k}"), F.col("uid").alias(f"_f{k}")), f"_p{k}", "left")
    return d.select("id", F.coalesce("by_name", "_f0", "_f1", "_f2", F.concat(F.lit("external:"), F.col("module"))).alias("target"))


def control_flow(statements: DataFrame) -> DataFrame:
    """(src, dst, kind) inside each function (fn): statements in line order flow on, the
    last to __exit__; branches and loops by their first 20 characters, returns by 10."""
    w = Window.partitionBy("fn").orderBy("lo", "pos")
    s = statements.withColumn("next", F.coalesce(F.lead("statement").over(w), F.lit("__exit__")))
    head = F.substring("code", 1, 20)
    flows = s.select(F.col("statement").alias("src"), F.col("next").alias("dst"), F.lit("FLOWS_TO").alias("kind"))
    branch = s.where(head.rlike("if|switch")).select(F.col("statement").alias("src"), F.col("next").alias("dst"), F.lit("BRANCHES_TO").alias("kind"))
    loops = s.where(head.rlike("for|while")).select(F.col("statement").alias("src"), F.col("statement").alias("dst"), F.lit("FLOWS_TO").alias("kind"))
    ret = s.where(F.contains(F.substring("code", 1, 10), F.lit("return"))).select(F.col("statement").alias("src"), F.lit("__exit__").alias("dst"), F.lit("RETURNS_TO").alias("kind"))
    return flows.union(branch).union(loops).union(ret)


def data_flow(variables: DataFrame, statements: DataFrame) -> DataFrame:
    """(src, dst, kind) of variables (id, file, name, line, pos) and statements (id, file, lo,
    hi, pos, code): DEFINES from the first statement that holds a definition's line,
    DATA_DEPENDS_ON from a use to the last definition of the name before it.

    A variable is defined where its name stands before the first '=' of a statement that
    begins on its line and is no return.
    """
    eq, at = F.instr("code", "="), F.instr("code", F.col("name"))
    assigns = statements.where((eq > 0) & ~F.startswith(F.ltrim("code"), F.lit("return"))).select("file", F.col("lo").alias("line"), "code")
    defined = variables.join(assigns, ["file", "line"]).where((at > 0) & (at < eq)).select("id").distinct()
    v = variables.join(defined.withColumn("is_def", F.lit(1)), "id", "left").withColumn("is_def", F.coalesce("is_def", F.lit(0)))
    holds = containing(v.where("is_def = 1").select("id", "file", "line"), statements.select("file", "lo", "hi", "pos", F.col("id").alias("statement")))
    uses = last_definitions(v.withColumn("scope", F.col("file"))).where("def_id is not null")
    return holds.select(F.col("statement").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("kind")).union(uses.select(F.col("id").alias("src"), F.col("def_id").alias("dst"), F.lit("DATA_DEPENDS_ON").alias("kind")))


def first_by_path(rows: DataFrame) -> DataFrame:
    return first_wins(rows, ["path"], [F.col("pos")])
