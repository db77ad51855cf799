"""The graph store: tables derived from events, in versioned Parquet folders."""

from __future__ import annotations

import json
import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pyparse import parse_files
from graphloom.operators.extract import events as make_events
from graphloom.operators.extract import identity, parent_dir
from graphloom.operators.incremental import changed_rows, create_edges, detach_delete, diff, first_wins, hashed, load_counters, merge, merge_edges, stale
from graphloom.operators.search import indexed
from graphloom.schema import HASHES
from graphloom.sources.files import Project, Settings, scan
from graphloom.storage import list_names, read_text, write_text


class Store:
    """Tables under one folder. A table's versions stand beside each other, and the
    ``LATEST`` file names the one to read, so no table is written over while it is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _latest(self, name: str) -> str | None:
        v = read_text(self.spark, f"{self.path}/{name}/LATEST")
        return v.strip() if v else None

    def read(self, name: str, schema=None) -> DataFrame:
        v = self._latest(name)
        if v is None:
            if schema is None:
                raise FileNotFoundError(f"{name} has not been written")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}/{v}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        v = f"v{time.time_ns()}"
        df.write.parquet(f"{self.path}/{name}/{v}")
        write_text(self.spark, f"{self.path}/{name}/LATEST", v)
        return self.read(name)

    # --- stages ---

    def scan(self, projects: list[Project], settings: Settings) -> DataFrame:
        return self.write("scan", scan(self.spark, projects, settings))

    def parse(self) -> DataFrame:
        """Files whose content hash the last parse has are taken from it."""
        files = self.read("scan").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        key = ["project", "path", "hash"]  # projects can share files
        if self._latest("ast") is None:
            return self.write("ast", parse_files(files).join(files.select(*key).distinct(), ["project", "path"]))
        old = self.read("ast")
        hits = old.join(files.select(*key), key, "left_semi")
        fresh = files.join(old.select(*key), key, "left_anti")
        return self.write("ast", hits.unionByName(parse_files(fresh).join(fresh.select(*key).distinct(), ["project", "path"])))

    def extract(self, relations: bool = True) -> DataFrame:
        return self.write("events", make_events(self.read("ast"), relations))

    def hashes(self) -> DataFrame:
        ev = self.read("events").withColumn("identity", identity())
        ev = first_wins(ev, ["identity"], [F.col("file_pos"), F.col("branch"), F.col("i")])
        return hashed(ev.withColumn("p", F.to_json("props")), F.col("identity"), ["identity", "p"])

    def load(self, force: bool = False, fresh: bool = False) -> dict:
        """Incremental load; the state is written after the graph.

        Only new and changed identities are upserted, old properties kept where the new are
        null, and stale ones are deleted, nodes with their edges; a load without a change
        writes nothing. ``force`` loads all events, ``fresh`` into an empty graph, whose edges
        needn't be looked for.
        """
        force = force or fresh or self._latest("nodes") is None
        new, old = self.hashes(), self.read("state", HASHES)
        counts = load_counters(old, new, force).first().asDict()
        if not force and not counts["loaded"] and not counts["stale"]:
            return counts
        ev = self.read("events")
        gone = stale(old, new)
        if not force:
            ev = ev.withColumn("identity", identity()).join(changed_rows(old, new).select("identity"), "identity", "left_semi")
        first = first_wins(ev.where("kind = 'node'"), ["label", "uid"], [F.col("file_pos"), F.col("branch"), F.col("i")])
        get = lambda k: F.col("props")[k]
        text = [get(k).alias(k) for k in ("name", "project", "path", "rel_path", "file_uid", "signature_hash")]
        nodes = first.select("label", "uid", *text, get("line").cast("int").alias("line"))
        edges = ev.where("kind = 'edge'").select("type", F.col("src_uid").alias("src"), F.col("dst_uid").alias("dst"))
        if force:
            self.write("nodes", nodes)
            ids = self.read("nodes").select("uid")
            self.write("edges", create_edges(edges.distinct(), ids) if fresh else merge_edges(edges, ids))
        else:
            gone = gone.withColumn("p", F.split("identity", ":", 3))
            dead = gone.where("p[0] = 'node'").select(F.col("p")[1].alias("label"), F.col("p")[2].alias("uid"))
            ends = F.regexp_extract("identity", "^edge:([^:]+):([^:]+):(.*)$", 1)
            kept, own = detach_delete(self.read("nodes"), self.read("edges"), dead)
            lost = self._edge_identities(own).join(gone.where(ends != "").select("identity"), "identity", "left_anti").drop("identity")
            self.write("nodes", merge(kept, nodes, ["label", "uid"]))
            self.write("edges", merge_edges(lost.select("type", "src", "dst").union(edges), self.read("nodes").select("uid")))
        self.write("search", indexed(self.search_nodes()))
        self.write("state", new)
        return counts

    def _edge_identities(self, edges: DataFrame) -> DataFrame:
        """Edges with their identity: type, labels and names of both ends."""
        label = lambda c: self.read("nodes").select(F.col("uid").alias(c), F.col("label").alias(f"{c}_label"))
        d = edges.join(label("src"), "src", "left").join(label("dst"), "dst", "left")
        return d.select("type", "src", "dst", F.concat_ws(":", F.lit("edge"), "type", "src_label", "src", "dst_label", "dst").alias("identity"))

    def wipe(self) -> None:
        """An empty graph and state; snapshots stay."""
        for name in ("nodes", "edges", "state"):
            if self._latest(name):
                self.write(name, self.read(name).limit(0))

    # --- graph views ---

    def functions(self) -> DataFrame:
        n = self.read("nodes")
        files = n.where("label = 'File'").select(F.col("uid").alias("file_uid"), F.col("rel_path").alias("_r"))
        f = n.where("label = 'Function'").drop("rel_path").join(files, "file_uid", "left").withColumnRenamed("_r", "rel_path")
        return f.withColumn("dir", parent_dir(F.col("rel_path")))

    def edges(self, kind: str = "CALLS_FUNCTION") -> DataFrame:
        return self.read("edges").where(F.col("type") == kind).select("src", "dst")

    def calls(self) -> DataFrame:
        return self.edges("CALLS").where(F.startswith("dst", F.lit("symbol:"))).select("src", F.substring("dst", 8, 1 << 30).alias("callee"))

    def search_nodes(self) -> DataFrame:
        n = self.read("nodes")
        return n.select("uid", "label", F.coalesce("project", F.lit("")).alias("project"), "name", F.coalesce("rel_path", "path", F.element_at(F.split("file_uid", ":"), 2), F.lit("")).alias("path"))

    def search_index(self) -> DataFrame | None:
        """The index that the last load wrote, if there is one."""
        return self.read("search") if self._latest("search") else None

    # --- snapshots ---

    def snapshot(self, label: str = "") -> str:
        slug = re.sub("-+", "-", "".join(c.lower() if c.isalnum() or c in "-_" else "-" for c in label.strip())).strip("-_")
        name = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ") + (f"-{slug}" if slug else "")
        src = self.read("state", HASHES) if self._latest("state") else self.hashes()
        src.write.parquet(f"{self.path}/snapshots/{name}")
        return name

    def snapshots(self) -> list[str]:
        return list_names(self.spark, f"{self.path}/snapshots")

    def snapshot_rows(self, token: str) -> DataFrame:
        """Rows of a snapshot, by its name or by the path of its folder."""
        return self.spark.read.schema(HASHES).parquet(token if "/" in token else f"{self.path}/snapshots/{token}")

    def diff(self, a: str, b: str) -> DataFrame:
        return diff(self.snapshot_rows(a), self.snapshot_rows(b))

    def changed(self) -> tuple[DataFrame, DataFrame]:
        """What a load would write and delete."""
        new, old = self.hashes(), self.read("state", HASHES)
        return changed_rows(old, new), stale(old, new)


def run_pipeline(store: Store, projects: list[Project], settings: Settings, load: bool = False, relations: bool = True, manifest: str | None = None) -> dict:
    """scan, parse, extract and, if asked for, load; stops at the first failing stage and
    records status, seconds and count of each."""
    out: dict = {"stages": [], "status": "ok"}
    steps = [("scan", lambda: store.scan(projects, settings).count()), ("parse", lambda: store.parse().count()), ("extract", lambda: store.extract(relations).count())]
    if load:
        steps.append(("load", lambda: store.load()["loaded"]))
    for name, step in steps:
        t, row = time.time(), {"name": name, "status": "ok"}
        try:
            row["count"] = step()
        except Exception as e:  # the manifest says what failed
            row |= {"status": "failed", "error": str(e)[:500]}
            out["status"] = "failed"
        row["seconds"] = round(time.time() - t, 3)
        out["stages"].append(row)
        if row["status"] == "failed":
            break
    if manifest:
        write_text(store.spark, manifest, json.dumps(out, indent=2))
    return out
