"""Snapshots, diffs, incremental loads and upserts over (identity, hash) and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hashed(df: DataFrame, identity: Column, content: list[str]) -> DataFrame:
    """(identity, hash): SHA-256 over the content columns in a canonical form."""
    return df.select(identity.alias("identity"), F.sha2(F.to_json(F.struct(*sorted(content))), 256).alias("hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(identity, change): added, removed, changed or unchanged."""
    o, n = old.select("identity", F.col("hash").alias("was")), new.select("identity", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return o.join(n, "identity", "full").select("identity", change.alias("change"))


def category(identity: Column) -> Column:
    """kind:label of a node identity, kind:type of an edge identity."""
    return F.concat_ws(":", F.slice(F.split(identity, ":"), 1, 2))


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change", category(F.col("identity")).alias("category")).agg(F.count("*").alias("n"))


def parse_identity(df: DataFrame) -> DataFrame:
    """Columns kind, type, project, file, function, line of node identities."""
    p = F.split("identity", ":")
    get = lambda i: F.get(p, F.lit(i))
    fn = get(1) == "Function"
    return df.withColumns({"kind": get(0), "type": get(1), "project": get(2), "file": F.when(fn | (get(1) == "File"), get(3)), "function": F.when(fn, get(4)), "line": F.when(fn, get(5).cast("int"))})


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose hash isn't the state's."""
    return new.join(old.select("identity", F.col("hash").alias("_h")), "identity", "left").where(~F.col("_h").eqNullSafe(F.col("hash"))).drop("_h")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, "identity", "left_anti").select("identity")


def load_counters(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """One row: unique, loaded, skipped, stale of an incremental load."""
    d = diff(old, new)
    n = d.agg(
        F.count_if(F.col("change") != "removed").alias("unique_events"), F.count_if(F.col("change").isin("added", "changed")).alias("loaded"),
        F.count_if(F.col("change") == "unchanged").alias("skipped"), F.count_if(F.col("change") == "removed").alias("stale"),
    )
    return n.withColumns({"loaded": F.col("unique_events"), "skipped": F.lit(0).cast("long")}) if force else n


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert that keeps old values where the new ones are null."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in cols))
    return old.join(n, keys, "full").select(*keys, *(F.coalesce(f"_n_{c}", c).alias(c) for c in cols))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of whole rows."""
    return old.join(new, keys, "left_anti").unionByName(new)


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose both ends are nodes(uid)."""
    ids = nodes.select("uid").distinct()
    return edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi").distinct()


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone``(uid), and edges without a gone end."""
    g = gone.select("uid").distinct()
    e = edges.join(g.withColumnRenamed("uid", "src"), "src", "left_anti").join(g.withColumnRenamed("uid", "dst"), "dst", "left_anti")
    return nodes.join(g, "uid", "left_anti"), e


def violations(nodes: DataFrame, key: str = "uid") -> DataFrame:
    """Keys that break uniqueness."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_cache(rows: DataFrame, cache: DataFrame, key: str = "path", digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Rows whose digest the cache has (with its columns), and those to work on."""
    hits = rows.select(key, digest).join(cache, [key, digest])
    return hits, rows.join(cache.select(key, digest), [key, digest], "left_anti")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: SHA-256 over digests of all natural keys, and counts. Each key's digest is
    summed, so the order of rows doesn't matter and nothing is collected."""
    def part(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256)
        limbs = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8)]
        return df.agg(F.count("*").alias(f"n_{name}"), F.concat_ws(",", *(F.coalesce(x, F.lit("0")) for x in limbs)).alias(f"h_{name}"))

    both = part(nodes, ["uid"], "nodes").crossJoin(part(edges, ["src", "dst"], "edges"))  # one row each
    return both.select("n_nodes", "n_edges", F.sha2(F.concat_ws("|", "h_nodes", "h_edges"), 256).alias("fingerprint"))


def create_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a fresh load: both ends are nodes(uid), repeats stay."""
    ids = nodes.select("uid").distinct()
    return edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")


def ghost_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid) of edge ends that are no nodes: a load edge by edge would create them."""
    ends = edges.select(F.col("src").alias("uid")).union(edges.select(F.col("dst").alias("uid"))).distinct()
    return ends.join(nodes.select("uid"), "uid", "left_anti")


def with_properties(nodes: DataFrame, properties: DataFrame, key: str = "uid") -> DataFrame:
    """Nodes with the columns of their properties; those without keep nulls."""
    return nodes.join(properties, key, "left")


def catalog_write(old: DataFrame, new: DataFrame, keys: list[str], append: bool = False, owner: str = "source_path") -> DataFrame:
    """A catalog table after rows of some owners are written: to replace takes all old rows of
    these owners away first, to append only those with the keys of new rows."""
    if append:
        return replace_rows(old, new, keys)
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


#: Columns that older catalogs lack, with their defaults.
ADDED_COLUMNS = {"summary_artifact": "", "fingerprint": "", "performance_json": "{}"}


def evolved(table: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """A catalog table with the columns it lacks, at their defaults; nulls of columns it has
    become defaults too, as they may not be null."""
    defaults = ADDED_COLUMNS if defaults is None else defaults
    return table.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in table.columns else F.lit(v) for c, v in defaults.items()})


def extract_counters(rows: DataFrame, cache: DataFrame, relations: bool = True) -> DataFrame:
    """One row: rows (path, hash, events), hits and misses of a cache (cache_key, hash) keyed
    by path and mode, and all events."""
    mode = "relations-on" if relations else "relations-off"
    keyed = rows.withColumn("cache_key", F.concat_ws("|", "path", F.lit(mode))).join(cache.select("cache_key", F.col("hash").alias("_h")), "cache_key", "left")
    hit = F.col("_h").eqNullSafe(F.col("hash"))
    return keyed.agg(F.count("*").alias("rows_total"), F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("cache_misses"), F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events_total"))


def tallies(rows: DataFrame, statuses: tuple[str, ...] = ("planned", "completed", "failed", "skipped_missing_path"), column: str = "status") -> DataFrame:
    """One row: all rows and those of each status."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == s).alias(s) for s in statuses))


def newest_first(records: DataFrame, created: str, key: str) -> DataFrame:
    """Records by creation time, the newest first; of equals the smaller key first."""
    return records.orderBy(F.desc(created), key)


def merged_maps(old: Column, new: Column) -> Column:
    """Property maps merged key by key; the new value wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
