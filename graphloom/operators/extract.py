"""Event extraction: parsed files to an ordered stream of node and edge events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import EVENT


def file_uid() -> Column:
    return F.concat_ws(":", "project", "rel_path")


def function_uid(file: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", file, name, line.cast("string"))


def signature(project: Column, rel_path: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws("|", project, rel_path, name), 256)


def parent_dir(path: Column) -> Column:
    """The directory of a path; '.' for a file at the root."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def _event(branch: int, i: Column | int, kind: str, label: str | None = None, uid: Column | None = None, type_: str | None = None, ends: tuple | None = None, props: Column | None = None) -> Column:
    """One event as a struct; all have the same fields."""
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x
    src_label, src, dst_label, dst = ends or (None, None, None, None)
    return F.struct(
        F.lit(branch).alias("branch"), (F.lit(i) if isinstance(i, int) else i).cast("long").alias("i"), F.lit(kind).alias("kind"), text(label).alias("label"), text(uid).alias("uid"), text(type_).alias("type"),
        text(src_label).alias("src_label"), text(src).alias("src_uid"), text(dst_label).alias("dst_label"), text(dst).alias("dst_uid"),
        (F.lit(None).cast("map<string,string>") if props is None else props).alias("props"),
    )


def _map(**kv: Column) -> Column:
    return F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))))


def events(ast: DataFrame, relations: bool = True, resolve: bool = True) -> DataFrame:
    """Node and edge events of parsed files, ordered by (file_pos, branch, i).

    Duplicates stay. Without ``relations`` no symbols, modules, CALLS or IMPORTS are made;
    CALLS_FUNCTION edges are, in either case, as they are resolved over all files, unless
    ``resolve`` is off: ``resolved_count`` counts them. They are a product of callers and
    namesakes, made row by row from distinct sides, so they aren't shuffled.
    """
    a = ast.withColumn("file_pos", F.xxhash64("project", "rel_path")) if "file_pos" not in ast.columns else ast
    a = a.withColumn("fu", file_uid())
    project, fu, rel = F.col("project"), F.col("fu"), F.col("rel_path")
    edge = lambda branch, i, kind, *ends: _event(branch, i, "edge", type_=kind, ends=ends)
    uid_of = lambda x: function_uid(fu, x["name"], x["line"])
    symbol = lambda c: F.concat(F.lit("symbol:"), c)
    module = lambda m: F.concat(F.lit("module:"), m)
    node = lambda branch, i, label, uid, **kv: _event(branch, i, "node", label, uid, props=_map(uid=uid, **kv))

    # all events of a file are one array of structs, so the files are scanned once
    head = F.array(
        _event(0, 0, "node", "Project", project, props=_map(name=project)),
        node(1, 0, "File", fu, project=project, path=F.col("path"), rel_path=rel, language=F.col("language"), line_count=F.col("line_count")),
        edge(2, 0, "CONTAINS", "Project", project, "File", fu),
    )
    defined = F.flatten(F.transform("functions", lambda x, i: F.array(
        node(3, i * 2, "Function", uid_of(x), name=x["name"], line=x["line"], project=project, file_uid=fu, signature_hash=signature(project, rel, x["name"])),
        edge(3, i * 2 + 1, "DEFINES", "File", fu, "Function", uid_of(x)),
    )))
    parts = [head, defined]
    if relations:
        place = lambda fi, ci: fi.cast("long") * (1 << 31) + ci
        parts.append(F.flatten(F.transform("function_calls", lambda x, fi: F.flatten(F.transform(x["calls"], lambda c, ci: F.array(
            node(4, place(fi, ci), "Symbol", symbol(c), name=c), edge(5, place(fi, ci), "CALLS", "Function", uid_of(x), "Symbol", symbol(c)),
        ))))))
        parts.append(F.flatten(F.transform("imports", lambda m, i: F.array(node(6, i, "Module", module(m), name=m), edge(7, i, "IMPORTS", "File", fu, "Module", module(m))))))
        parts.append(F.flatten(F.transform("calls", lambda c, i: F.array(node(8, i, "Symbol", symbol(c), name=c), edge(9, i, "CALLS", "File", fu, "Symbol", symbol(c))))))
    out = a.select("file_pos", F.inline(F.concat(*(F.coalesce(p, F.slice(head, 1, 0)) for p in parts))))

    if not resolve:
        return out.select(*EVENT.fieldNames())
    known, asked = _defined(a), _asked(a)
    pairs = asked.join(known, ["project", "dir", "callee"]).where("src <> dst").select("src", "dst")
    resolved = pairs.select(F.lit(1 << 62).cast("long").alias("file_pos"), _event(10, 0, "edge", type_="CALLS_FUNCTION", ends=("Function", F.col("src"), "Function", F.col("dst"))).alias("e")).select("file_pos", "e.*")
    return out.unionByName(resolved).select(*EVENT.fieldNames())


def _defined(a: DataFrame) -> DataFrame:
    """(project, dir, callee, dst): the functions of parsed files, once each."""
    f = a.select("project", "rel_path", "fu", F.explode("functions").alias("fn"))
    return f.select("project", parent_dir(F.col("rel_path")).alias("dir"), F.col("fn.name").alias("callee"), function_uid(F.col("fu"), F.col("fn.name"), F.col("fn.line")).alias("dst")).distinct()


def _asked(a: DataFrame) -> DataFrame:
    """(project, dir, callee, src): the names that functions of parsed files call, once each."""
    per = a.select("project", "rel_path", "fu", F.explode("function_calls").alias("fc"))
    return per.select("project", parent_dir(F.col("rel_path")).alias("dir"), F.explode("fc.calls").alias("callee"), function_uid(F.col("fu"), F.col("fc.name"), F.col("fc.line")).alias("src")).distinct()


def resolved_count(ast: DataFrame) -> DataFrame:
    """One row (n): how many CALLS_FUNCTION events the parsed files have, all distinct, from
    the number of functions of each name without making the events."""
    a = ast.withColumn("fu", file_uid())
    known = _defined(a)
    d = _asked(a).join(known.withColumnRenamed("dst", "src").withColumn("own", F.lit(1)), ["project", "dir", "callee", "src"], "left")
    d = d.join(known.groupBy("project", "dir", "callee").agg(F.count("*").alias("size")), ["project", "dir", "callee"])
    return d.agg(F.coalesce(F.sum(F.col("size") - F.coalesce("own", F.lit(0))), F.lit(0)).alias("n"))


def identity() -> Column:
    """The identity of an event: its kind and the uids that name it."""
    node = F.concat_ws(":", F.lit("node"), "label", "uid")
    edge = F.concat_ws(":", F.lit("edge"), "type", "src_label", "src_uid", "dst_label", "dst_uid")
    return F.when(F.col("kind") == "node", node).when(F.col("kind") == "edge", edge)
