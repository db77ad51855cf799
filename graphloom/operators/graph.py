"""Graph queries over functions(uid, name, project, dir, rel_path, file_uid, line) and
directed edges(src, dst): coupling, comparison, impact, iteration.

Degrees are aggregated before any join, so no query multiplies a function's callers by
its callees. Iterative operators write each round's frontier to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.storage import write_table

#: The name parts of the known design patterns.
PATTERN_WORDS = ("factory", "singleton", "observer", "repository", "plugin")


def kept(df: DataFrame, project: str = "", column: str = "project") -> DataFrame:
    """Rows of one project; an empty name filters nothing."""
    return df.where(F.col(column) == project) if project else df


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it."""
    return write_table(df, "graph")


def resolve_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges from a caller to every other function of the called name in the same project
    and directory; calls are (src, callee). A uid has one name and place, so edges of
    distinct calls are distinct and needn't be shuffled."""
    src = functions.select(F.col("uid").alias("src"), "project", "dir").distinct()
    dst = functions.select(F.col("uid").alias("dst"), "project", "dir", F.col("name").alias("callee")).distinct()
    return calls.select("src", "callee").distinct().join(src, "src").join(dst, ["project", "dir", "callee"]).where("src <> dst").select("src", "dst")


def degrees(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with distinct callers (fan_in) and callees (fan_out)."""
    e = edges.distinct()
    fan_in = e.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("fan_in"))
    fan_out = e.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return functions.join(fan_in, "uid", "left").join(fan_out, "uid", "left").withColumns({c: F.coalesce(c, zero) for c in ("fan_in", "fan_out")})


def metrics_by_name(functions: DataFrame, edges: DataFrame, project: str = "", limit: int = 20) -> DataFrame:
    """Distinct neighbours by function *name*; namesakes merge."""
    f = kept(functions, project).select("uid", "name")
    fan_in = f.join(edges, f.uid == edges.dst).groupBy("name").agg(F.count_distinct("src").alias("fan_in"))
    fan_out = f.join(edges, f.uid == edges.src).groupBy("name").agg(F.count_distinct("dst").alias("fan_out"))
    zero = F.lit(0).cast("long")
    out = f.select("name").distinct().join(fan_in, "name", "left").join(fan_out, "name", "left").withColumns({c: F.coalesce(c, zero) for c in ("fan_in", "fan_out")})
    return out.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "name").limit(limit)


def hotspots(functions: DataFrame, edges: DataFrame, project: str = "", limit: int = 25) -> DataFrame:
    """The most coupled functions, by node."""
    return top_coupled(degrees(kept(functions, project).select("uid", "name", "project"), edges), limit)


def top_coupled(d: DataFrame, limit: int = 25) -> DataFrame:
    """The most coupled of nodes with fan_in and fan_out."""
    return d.withColumn("coupling", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("coupling"), "uid").limit(limit)


def debt(functions: DataFrame, project: str = "") -> DataFrame:
    return kept(functions, project).groupBy("project").agg(F.count("*").alias("functions")).withColumn("debt", F.round(F.col("functions") * 0.3, 2))


def duplicates(functions: DataFrame, project: str = "", limit: int = 50) -> DataFrame:
    """Groups of functions with one signature hash."""
    g = kept(functions, project).groupBy("signature_hash").agg(F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return g.where("copies > 1").orderBy(F.desc("copies"), "signature_hash").limit(limit)


def name_contains(functions: DataFrame, words: tuple[str, ...], project: str = "", limit: int | None = None) -> DataFrame:
    """Functions whose lower-cased name holds any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("name"), F.lit(w.lower()))
    out = kept(functions, project).where(hit).select("project", "name", "line", "uid")
    return out.orderBy("name", "uid").limit(limit) if limit else out


def pattern_words(kind: str = "all") -> tuple[str, ...]:
    """All known words, or a custom kind without any of its final s."""
    return PATTERN_WORDS if kind == "all" else (kind.lower().rstrip("s"),)


def full_report(functions: DataFrame, project: str = "") -> DataFrame:
    """One row: functions, duplicate groups, pattern hits."""
    f = kept(functions, project)
    hit = F.lit(False)
    for w in PATTERN_WORDS:
        hit = hit | F.contains(F.lower("name"), F.lit(w))
    groups = f.groupBy("signature_hash").count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))
    return f.agg(F.count("*").alias("functions"), F.count_if(hit).alias("pattern_hits")).crossJoin(groups)  # one row each


def compare_shared(functions: DataFrame, a: str, b: str, limit: int = 50) -> DataFrame:
    left = functions.where(F.col("project") == a).select("name", F.col("uid").alias("uid_a"))
    right = functions.where(F.col("project") == b).select("name", F.col("uid").alias("uid_b"))
    return left.join(right, "name").orderBy("name", "uid_a", "uid_b").limit(limit)


def compare_unique(functions: DataFrame, a: str, b: str, limit: int = 50) -> DataFrame:
    """Functions of project a whose name project b lacks."""
    other = functions.where(F.col("project") == b).select("name")
    return functions.where(F.col("project") == a).join(other, "name", "left_anti").select("name", "uid").orderBy("name", "uid").limit(limit)


def compare_metrics(functions: DataFrame, projects: list[str]) -> DataFrame:
    return functions.where(F.col("project").isin(projects)).groupBy("project").agg(F.count("*").alias("functions")).orderBy(F.desc("functions"), "project")


def compare_patterns(functions: DataFrame, projects: list[str], words: dict[str, str]) -> DataFrame:
    n = [F.count_if(F.contains(F.lower("name"), F.lit(w))).alias(k) for k, w in words.items()]
    return functions.where(F.col("project").isin(projects)).groupBy("project").agg(*n)


def listing(functions: DataFrame, projects: list[str], limit: int = 100) -> DataFrame:
    """Functions of some projects by project, name and uid."""
    return functions.where(F.col("project").isin(projects)).select("project", "name", "uid").orderBy("project", "name", "uid").limit(limit)


def ask(functions: DataFrame, question: str, project: str = "", limit: int = 20) -> DataFrame:
    """Keyword router: duplicates, entry points, or a listing; one schema for all."""
    q, f = question.lower(), kept(functions, project)
    if "duplicate" in q:
        d = duplicates(f, limit=limit)
        return d.select(F.col("names").alias("name"), F.col("signature_hash").alias("uid"), "copies")
    if "entry" in q or "main" in q:
        f = f.where(F.contains(F.lower("name"), F.lit("main")) | F.contains(F.lower("name"), F.lit("entry")))
    return f.select("name", "uid", F.lit(1).cast("long").alias("copies")).orderBy("name", "uid").limit(limit)


def direct_callers(functions: DataFrame, calls: DataFrame, symbol: str, project: str = "", limit: int | None = 50) -> DataFrame:
    """Functions that call a symbol by name."""
    f = kept(functions, project).select(F.col("uid").alias("src"), "name", "project", "rel_path")
    d = calls.where(F.col("callee") == symbol).join(f.hint("merge"), "src").select(F.col("src").alias("uid"), "name", "project", "rel_path").distinct()
    return d if limit is None else d.orderBy("uid").limit(limit)


def file_callers(functions: DataFrame, calls: DataFrame, symbol: str, project: str = "", limit: int | None = 50) -> DataFrame:
    """Files with a function that calls the symbol; a missing project is the uid's first part."""
    f = functions.select(F.col("uid").alias("src"), "file_uid", F.coalesce("project", F.substring_index("uid", ":", 1)).alias("project"))
    d = kept(calls.where(F.col("callee") == symbol).join(f.hint("merge"), "src"), project).select("file_uid", "project").distinct()
    return d if limit is None else d.orderBy("file_uid").limit(limit)


def transitive_callers(functions: DataFrame, edges: DataFrame, symbol: str, depth: int = 3, project: str = "") -> DataFrame:
    """(uid, name, hops): functions from which a function named ``symbol`` is reached over
    at most ``depth`` calls. The targets are not marked as seen, so one that is reached
    through a cycle is reported with its cycle's length."""
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    frontier = kept(functions, project).where(F.col("name") == symbol).select("uid")
    seen = None
    for hops in range(1, depth + 1):
        step = frontier.join(edges, frontier.uid == edges.dst).select(F.col("src").alias("uid")).distinct()
        if seen is not None:
            step = step.join(seen, "uid", "left_anti")
        step = settle(step.withColumn("hops", F.lit(hops).cast("long")))
        seen = step if seen is None else seen.unionByName(step)
        if step.isEmpty():
            break
        frontier = step.select("uid")
    return seen.join(kept(functions, project).select("uid", "name"), "uid").select("uid", "name", "hops")


def impact_summary(functions: DataFrame, calls: DataFrame, edges: DataFrame, symbol: str, depth: int = 3) -> DataFrame:
    """Counts of the impact command's four result sets."""
    return impact_counts(functions, calls, symbol, transitive_callers(functions, edges, symbol, depth))


def impact_counts(functions: DataFrame, calls: DataFrame, symbol: str, transitive: DataFrame) -> DataFrame:
    parts = [
        ("definitions", functions.where(F.col("name") == symbol)), ("direct", direct_callers(functions, calls, symbol, limit=None)),
        ("files", file_callers(functions, calls, symbol, limit=None)), ("transitive", transitive),
    ]
    out = [df.agg(F.lit(k).alias("result"), F.count("*").alias("n")) for k, df in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def union_sizes(rows: DataFrame, member: str, sets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(names, n): how many distinct members any name of a set has, of rows (callee, member).

    A name's members are bitmaps of 32768 numbered members each, so a set of names costs a
    few bitmaps and not all its members' rows. ``ids`` (member, id) may number members
    that share names alike, so that a name has fewer bitmaps.
    """
    if ids is None:
        ids = write_table(rows.select(member).distinct().withColumn("id", F.monotonically_increasing_id() + 1), "members")
    d = rows.select("callee", member).distinct().join(ids, member)
    maps = d.groupBy("callee", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    met = sets.select("names", F.explode("names").alias("callee")).join(maps, "callee")
    return met.groupBy("names", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("names").agg(F.sum("n").alias("n"))


def file_impact(functions: DataFrame, calls: DataFrame, by_edge: DataFrame) -> DataFrame:
    """For each file: functions, distinct callers by resolved calls and by symbol name from
    outside of the file, and whether it is safe to move.

    Files with the same set of function names have the same callers by name but for their
    own: callers are counted once for each set, and each file's own callers are taken off.
    ``by_edge`` has the callers by resolved calls (file_uid, callers).
    """
    src = functions.select(F.col("uid").alias("src"), F.col("file_uid").alias("from_file"))
    files = functions.groupBy("file_uid").agg(F.count("*").alias("functions"), F.array_sort(F.collect_set("name")).alias("names"))
    made = write_table(calls.join(src, "src").select("callee", "src", "from_file").distinct(), "callers")
    sets = files.select("names").distinct()
    total = union_sizes(made, "src", sets).withColumnRenamed("n", "all_callers").join(union_sizes(made, "from_file", sets).withColumnRenamed("n", "all_files"), "names")
    inside = made.join(functions.select(F.col("file_uid").alias("from_file"), F.col("name").alias("callee")).distinct(), ["from_file", "callee"])
    inside = inside.groupBy(F.col("from_file").alias("file_uid")).agg(F.count_distinct("src").alias("own_callers"))
    zero = F.lit(0).cast("long")
    out = files.join(total, "names", "left").join(inside, "file_uid", "left").join(by_edge, "file_uid", "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("callers", "all_callers", "all_files", "own_callers")})
    out = out.select("file_uid", "functions", "callers", (F.col("all_callers") - F.col("own_callers")).alias("symbol_callers"), (F.col("all_files") - (F.col("own_callers") > 0).cast("long")).alias("symbol_files"))
    return out.withColumn("safe", ((F.col("callers") == 0) & (F.col("symbol_callers") == 0) & (F.col("symbol_files") == 0)).cast("int"))


# --- metrics over all relationships -----------------------------------------


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fan_in, fan_out over every relationship (repeated ones count), instability."""
    return with_instability(fans_of(nodes, fan_counts(edges)))


def fan_counts(edges: DataFrame) -> DataFrame:
    """(uid, fan_in, fan_out) of edge ends, a row for each way."""
    zero, n = F.lit(0).cast("long"), F.count("*")
    fan_in = edges.groupBy(F.col("dst").alias("uid")).agg(n.alias("fan_in")).select("uid", "fan_in", zero.alias("fan_out"))
    return fan_in.union(edges.groupBy(F.col("src").alias("uid")).agg(n.alias("fan_out")).select("uid", zero.alias("fan_in"), "fan_out"))


def fans_of(nodes: DataFrame, fans: DataFrame) -> DataFrame:
    """(uid, fan_in, fan_out) of each node, summed over the rows of ``fans``."""
    zero = F.lit(0).cast("long")
    sums = fans.groupBy("uid").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))
    return nodes.select("uid").join(sums, "uid", "left").withColumns({c: F.coalesce(c, zero) for c in ("fan_in", "fan_out")})


def with_instability(fans: DataFrame) -> DataFrame:
    total = F.col("fan_in") + F.col("fan_out")
    return fans.withColumn("instability", F.when(total > 0, F.col("fan_out") / total).otherwise(0.0))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def coupling(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in either direction; a self-loop counts itself."""
    return both_ways(edges).groupBy(F.col("src").alias("uid")).agg(F.count_distinct("dst").alias("coupling"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incident edges (a self-loop once) over the other nodes' number."""
    ends = edges.select(F.col("src").alias("uid")).union(edges.where("src <> dst").select(F.col("dst").alias("uid")))
    n = nodes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    deg = ends.groupBy("uid").agg(F.count("*").alias("degree"))
    return nodes.select("uid").join(deg, "uid", "left").crossJoin(n).select("uid", (F.coalesce("degree", F.lit(0)) / F.col("others")).alias("centrality"))  # one row


def dead_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points at."""
    return nodes.join(edges.select(F.col("dst").alias("uid")), "uid", "left_anti").select("uid")


def god_nodes(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    return gods(fan_metrics(nodes, edges), most)


def gods(fans: DataFrame, most: int = 20) -> DataFrame:
    return fans.where(F.col("fan_in") + F.col("fan_out") > most).select("uid", "fan_in", "fan_out")


def top_fans(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return top_totals(fan_metrics(nodes, edges), n)


def top_totals(fans: DataFrame, n: int = 10) -> DataFrame:
    out = fans.withColumn("total", F.col("fan_in") + F.col("fan_out"))
    return out.select("uid", "total").orderBy(F.desc("total"), "uid").limit(n)


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` undirected steps of the seeds(uid), without the seeds."""
    e, seen, frontier = both_ways(edges).distinct(), seeds.select("uid").distinct(), seeds.select("uid").distinct()
    first = seen
    for _ in range(hops):
        step = settle(frontier.join(e, frontier.uid == e.src).select(F.col("dst").alias("uid")).distinct().join(seen, "uid", "left_anti"))
        if step.isEmpty():
            break
        seen, frontier = seen.union(step), step
    return seen.join(first, "uid", "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges that remain when nodes without a way in or out are removed until none is left."""
    e = settle(edges)
    n = e.count()
    while n:
        e = settle(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = e.count()
        if m == n:
            break
        n = m
    return e


#: Graphs of so many edges at most are solved in one task; larger ones in rounds of joins.
ONE_TASK = 500_000


def _numbered(batches) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct node names, and the edges (src, dst) by their numbers, ordered by src."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = pa.Table.from_batches(got)
    both = pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]).combine_chunks().dictionary_encode()
    at = both.indices.to_numpy().astype(np.int64)
    src, dst = at[: t.num_rows], at[t.num_rows :]
    order = np.argsort(src, kind="stable")
    return both.dictionary, src[order], dst[order]


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Component number of each node, in reverse topological order, by one depth-first walk."""
    first = np.searchsorted(src, np.arange(n + 1)).tolist()
    to = dst.tolist()
    seen, low, comp = [0] * n, [0] * n, [-1] * n
    stack, count, done = [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        stack.append(root)
        walk = [(root, first[root])]
        while walk:
            v, i = walk.pop()
            if i < first[v + 1]:
                walk.append((v, i + 1))
                w = to[i]
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append(w)
                    walk.append((w, first[w]))
                elif comp[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = done
                    if w == v:
                        break
                done += 1
            if walk and low[v] < low[walk[-1][0]]:
                low[walk[-1][0]] = low[v]
    return np.array(comp, np.int64)


def _components_in_one_task(batches):
    names, src, dst = _numbered(batches)
    if len(names):
        comp = _strong(len(names), src, dst)
        size = np.bincount(comp)
        order = pc.sort_indices(names).to_numpy()
        greatest = np.zeros(len(size), np.int64)
        greatest[comp[order]] = order  # the last one written is the greatest
        on = np.flatnonzero(size[comp] > 1)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(on)), names.take(pa.array(greatest[comp[on]]))], names=["uid", "scc"])


def _depths_in_one_task(batches):
    names, src, dst = _numbered(batches)
    if len(names):
        comp = _strong(len(names), src, dst)
        a, b = comp[src], comp[dst]
        keep = a != b
        depth = [0] * (int(comp.max()) + 1)
        order = np.argsort(a[keep], kind="stable")
        # a component's number is greater than those it leads to
        for x, y in zip(a[keep][order].tolist(), b[keep][order].tolist(), strict=True):
            if depth[y] >= depth[x]:
                depth[x] = depth[y] + 1
        yield pa.RecordBatch.from_arrays([names, pa.array(np.array(depth, np.int64)[comp])], names=["uid", "depth"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(uid, scc): the strong component of every node on a cycle through other nodes, named
    by its greatest node. Small graphs are walked in one task; larger ones go in rounds.

    Each node takes the greatest node that reaches it; what reaches that node inside one
    label is its component, and the rest goes on. Rounds grow with the length of paths,
    rows of a round only with the edges.
    """
    e = settle(edges.where("src <> dst").select("src", "dst").distinct())
    if e.count() <= ONE_TASK:
        name = e.schema["src"].dataType
        return e.coalesce(1).mapInArrow(_components_in_one_task, T.StructType().add("uid", name).add("scc", name))
    e = trimmed(e)
    out = e.select(F.col("src").alias("uid"), F.col("src").alias("scc")).limit(0)
    while not e.isEmpty():
        label = settle(e.select(F.col("src").alias("uid")).distinct().select("uid", F.col("uid").alias("scc"), F.lit(True).alias("moved")))
        label = settle(label.union(e.select(F.col("dst").alias("uid")).distinct().join(label, "uid", "left_anti").select("uid", F.col("uid").alias("scc"), F.lit(True))))
        while not (front := label.where("moved")).isEmpty():
            best = e.join(front, e.src == front.uid).groupBy(F.col("dst").alias("uid")).agg(F.max("scc").alias("new"))
            label = settle(label.join(best, "uid", "left").select("uid", F.greatest("scc", "new").alias("scc"), F.coalesce(F.col("new") > F.col("scc"), F.lit(False)).alias("moved")))
        a, b = label.select(F.col("uid").alias("src"), "scc"), label.select(F.col("uid").alias("dst"), F.col("scc").alias("other"))
        inside = settle(e.join(a, "src").join(b, "dst").where("scc = other").select("src", "dst", "scc"))
        front = seen = label.where("uid = scc").select("uid", "scc")
        while not front.isEmpty():
            front = settle(inside.join(front.select(F.col("uid").alias("dst")), "dst").select(F.col("src").alias("uid"), "scc").distinct().join(seen, "uid", "left_anti"))
            seen = settle(seen.union(front))
        out = settle(out.union(seen))
        done = seen.select(F.col("uid").alias("src"))
        e = trimmed(inside.select("src", "dst").join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    return out.join(out.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1"), "scc").select("uid", "scc")


def in_cycle(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle, self-loops included: those of strong components."""
    loops = edges.where("src = dst").select(F.col("src").alias("uid"))
    return strong_components(edges).select("uid").union(loops).distinct()


def longest_depth(edges: DataFrame) -> DataFrame:
    """(uid, depth): edges on the longest path from each node. Strong components count as
    one node, so edges inside a cycle add nothing; there are as many rounds as the longest
    path has edges, so at most one for each node; small graphs are solved in one task."""
    e = settle(edges.where("src <> dst").select("src", "dst").distinct())
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInArrow(_depths_in_one_task, T.StructType().add("uid", e.schema["src"].dataType).add("depth", "long"))
    nodes = e.select(F.col("src").alias("uid")).union(e.select("dst")).distinct()
    names = settle(nodes.join(strong_components(e), "uid", "left").select("uid", F.coalesce("scc", "uid").alias("node")))
    a, b = names.select(F.col("uid").alias("src"), F.col("node").alias("a")), names.select(F.col("uid").alias("dst"), F.col("node").alias("b"))
    e = settle(e.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    found, d = e.select(F.col("src").alias("node"), F.lit(1).cast("long").alias("depth")).limit(0), 0
    while not e.isEmpty():
        d += 1
        layer = e.select(F.col("src").alias("node")).distinct()
        found = found.union(layer.withColumn("depth", F.lit(d).cast("long")))
        if d % 32 == 0:  # keeps the plan short
            found = settle(found.groupBy("node").agg(F.max("depth").alias("depth")))
        e = settle(e.join(layer.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    found = found.groupBy("node").agg(F.max("depth").alias("depth"))
    return names.join(found, "node", "left").select("uid", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def witnesses(sets: list[tuple[int, ...]], own: int, more: int) -> list[tuple[int, ...]]:
    """A few of the node sets, so that whenever one of ``sets`` avoids ``more`` given nodes
    (never ``own``, which all hold), a chosen one does too: a set that is hit is hit in one of
    its nodes, and the next choice has to avoid that node."""
    chosen, todo, seen = [], [frozenset()], set()
    while todo:
        avoid = todo.pop()
        if avoid in seen:
            continue
        seen.add(avoid)
        got = next((s for s in chosen if avoid.isdisjoint(s)), None) or next((s for s in sets if avoid.isdisjoint(s)), None)
        if got is not None:
            if got not in chosen:
                chosen.append(got)
            if len(avoid) < more:
                todo += [avoid | {x} for x in got if x != own]
    return chosen


def few(more: int):
    """Witnesses of each node's paths (v, p) in one batch."""

    def run(batches):
        for b in batches:
            by: dict[int, list] = {}
            for v, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(v, []).append(tuple(p))
            rows = [(v, p) for v, ps in by.items() for p in witnesses(ps, v, more)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([list(x[1]) for x in rows], pa.list_(pa.int64()))], names=["v", "p"])

    return run


def fewer(more: int):
    """Witnesses of one node's paths (v, p)."""

    def run(t):
        v = t.column("v")[0].as_py()
        ps = witnesses([tuple(p) for p in t.column("p").to_pylist()], v, more)
        return pa.table({"v": pa.array([v] * len(ps), pa.int64()), "p": pa.array([list(p) for p in ps], pa.list_(pa.int64()))})

    return run


def longest_chain(edges: DataFrame, most: int = 6) -> DataFrame:
    """(uid, chain): edges of the longest simple path from each node, plus the edge that
    closes a cycle, counted up to ``most``.

    A chain of n edges is a simple path of n nodes whose last node has a way out. Paths grow
    at the front; of a node's paths only ``witnesses`` are kept, a fixed number for each
    node that decides exactly whether a longer path exists.
    """
    e = settle(edges.select("src", "dst").distinct())
    ids = settle(e.select(F.col("src").alias("uid")).distinct().withColumn("id", F.monotonically_increasing_id()))
    a, b = ids.select(F.col("uid").alias("src"), F.col("id").alias("u")), ids.select(F.col("uid").alias("dst"), F.col("id").alias("v"))
    steps = settle(e.where("src <> dst").join(a, "src").join(b, "dst").select("u", "v"))
    paths = ids.select(F.col("id").alias("v"), F.array("id").alias("p"))
    out = ids.select("id", F.lit(1).cast("long").alias("n"))
    for k in range(2, most + 1):
        longer = steps.join(paths, "v").where(~F.array_contains("p", F.col("u"))).select(F.col("u").alias("v"), F.array_sort(F.concat("p", F.array("u"))).alias("p"))
        kind = "v long, p array<long>"
        paths = settle(longer.mapInArrow(few(most - k), kind).groupBy("v").applyInArrow(fewer(most - k), kind))
        if paths.isEmpty():
            break
        out = out.union(paths.select(F.col("v").alias("id"), F.lit(k).cast("long").alias("n")).distinct())
    return out.groupBy("id").agg(F.max("n").alias("chain")).join(ids, "id").select("uid", "chain")


def risk_flags(metrics: DataFrame) -> DataFrame:
    """Flags over (uid, complexity, fan_in, fan_out, chain, cyclic), joined by commas."""
    flags = F.array(
        F.when((F.col("complexity") > 10) & (F.col("fan_in") > 5), "complex_and_used"), F.when(F.col("chain") > 5, "deep_chain"),
        F.when(F.col("fan_in") + F.col("fan_out") > 20, "god_class"), F.when(F.col("cyclic"), "cyclic"),
    )
    return metrics.select("uid", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


def quality_gate(metrics: DataFrame, most_complexity: float = 12, most_risky: int = 25, most_cyclic: int = 15) -> DataFrame:
    """One row: averages, counts, violations of the gate."""
    m = metrics.agg(F.avg("complexity").alias("avg_complexity"), F.count_if(F.col("flags") != "").alias("risky"), F.count_if("cyclic").alias("n_cyclic"))
    bad = F.array(F.when(F.col("avg_complexity") > most_complexity, "complexity"), F.when(F.col("risky") > most_risky, "risk"), F.when(F.col("n_cyclic") > most_cyclic, "cycles"))
    out = m.withColumn("violations", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ","))
    return out.withColumn("passed", (F.col("violations") == "").cast("int"))


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """One row over (uid, complexity, flags): nodes, average and largest complexity, flagged
    nodes and the first of them."""
    risky = F.col("flags") != ""
    return metrics.agg(
        F.count("*").alias("nodes"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).cast("long").alias("max_complexity"),
        F.count_if(risky).alias("risky"), F.min(F.when(risky, F.col("uid"))).alias("first_risky"),
    )


def counts_by(rows: DataFrame, column: str, more: DataFrame | None = None) -> DataFrame:
    """Rows of each label or type, the commonest first; ``more`` are counted rows (column, n)."""
    d = rows.groupBy(column).agg(F.count("*").alias("n"))
    return (d if more is None else d.union(more)).orderBy(F.desc("n"), column)


def most_called(functions: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(project, name, fan_in): calls of functions by name and project."""
    f = functions.select(F.col("uid").alias("dst"), "project", "name")
    return edges.join(f, "dst").groupBy("project", "name").agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "project", "name").limit(limit)


def importing_files(files: DataFrame, imports: DataFrame, module: str) -> DataFrame:
    """(project, file) of files (uid, project, rel_path) that import a module; imports are (uid, module)."""
    return files.join(imports.where(F.col("module") == module).select("uid").distinct(), "uid").select("project", F.col("rel_path").alias("file")).orderBy("project", "file")


def shared_symbols(functions: DataFrame, calls: DataFrame, a: str, b: str, limit: int = 50) -> DataFrame:
    """Symbols that functions of both projects call."""
    d = calls.join(functions.select(F.col("uid").alias("src"), "project"), "src").where(F.col("project").isin(a, b))
    return d.groupBy("callee").agg(F.count_distinct("project").alias("n")).where("n = 2").select(F.col("callee").alias("shared_symbol")).orderBy("shared_symbol").limit(limit)


def plugin_clusters(inherits: DataFrame) -> DataFrame:
    """(base, project, impls, n): bases with several implementations (name, base) in a project."""
    d = inherits.groupBy("base", "project").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("impls"), F.count("*").alias("n"))
    return d.where("n > 1").orderBy(F.desc("n"), "base", "project")


def signature_groups(functions: DataFrame, limit: int = 50) -> DataFrame:
    """(signature, ids, n): functions that share a signature hash."""
    g = functions.where("signature_hash is not null").groupBy("signature_hash").agg(F.array_join(F.array_sort(F.collect_list("uid")), ",").alias("ids"), F.count("*").alias("n"))
    return g.where("n > 1").orderBy(F.desc("n"), "signature_hash").limit(limit)


def result_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and relationships a result has, and their distinct kinds; a
    row of edges may stand for ``n`` of them."""
    kinds = lambda c: F.array_join(F.array_sort(F.collect_set(F.coalesce(c, F.lit("")))), ",")
    n = nodes.agg(F.count("*").alias("total_nodes"), kinds("label").alias("node_types"))
    count = F.coalesce(F.sum("n"), F.lit(0)).cast("long") if "n" in edges.columns else F.count("*")
    return n.crossJoin(edges.agg(count.alias("total_relationships"), kinds("type").alias("relationship_types")))  # one row each


def inheritance_depth(inherits: DataFrame) -> DataFrame:
    """(uid, depth) over edges (src, dst) from a class to its bases: edges of the longest way
    up through distinct classes, where a base that closes a cycle counts 1 more.

    Ways grow by a base in each round until none is left; of the ways from one class to
    another over the same classes one is kept.
    """
    e = settle(inherits.select("src", "dst").distinct())
    paths = e.select(F.col("src").alias("uid"), F.col("dst").alias("last"), F.array("src").alias("seen"))
    out, d = None, 0
    while not paths.isEmpty():
        d += 1
        here = paths.select("uid").distinct().withColumn("depth", F.lit(d).cast("long"))
        out = settle(here if out is None else out.union(here).groupBy("uid").agg(F.max("depth").alias("depth")))
        open_ = paths.where(~F.array_contains("seen", F.col("last"))).select("uid", F.col("last").alias("src"), F.array_sort(F.concat("seen", F.array("last"))).alias("seen"))
        paths = settle(open_.join(e, "src").select("uid", F.col("dst").alias("last"), "seen").distinct())
    nodes = e.select(F.col("src").alias("uid")).union(e.select("dst")).distinct()
    if out is None:
        return nodes.select("uid", F.lit(0).cast("long").alias("depth"))
    return nodes.join(out, "uid", "left").select("uid", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
