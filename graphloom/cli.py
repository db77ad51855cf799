"""Command line: ``python -m graphloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import catalog as C
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators import similarity as Y
from graphloom.operators.incremental import parse_identity, report
from graphloom.operators.trees import key_audit
from graphloom.plans import enrich as N
from graphloom.plans import guard
from graphloom.plans.store import Store, run_pipeline
from graphloom.session import get_session
from graphloom.sources.files import Project, churn_text, load_projects, load_settings, read_sqlite, scan, sqlite_keys, sqlite_tables, write_jsonl
from graphloom.storage import clean, write_table


def table(rows: list[dict], keys: list[str] | None = None) -> None:
    """Rows under the sorted union of their keys, or the given ones; nested values as JSON."""
    keys = sorted({k for r in rows for k in r}) if keys is None else keys
    print("\t".join(keys))
    for r in rows:
        print("\t".join(json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else "" if v is None else str(v) for v in (r.get(k) for k in keys)))


def show(df: DataFrame, output: str = "", limit: int = 1000) -> None:
    """A table of at most ``limit`` rows, which says when there are more; all rows go to the
    folder ``output``, if given, as JSON lines."""
    if output:
        write_jsonl(df, output)
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    table(rows[:limit], df.columns)
    if len(rows) > limit:
        print(f"... only the first {limit} rows are shown", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--config", default="config/projects.yaml")
    p.add_argument("--settings", default="config/default.yaml")
    p.add_argument("--master", default="local[*]")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        s = c.add_parser(name)
        for flags, kw in args:
            s.add_argument(*flags, **kw)

    project, limit = (("-p", "--project"), {"default": ""}), lambda n: (("-l", "--limit"), {"type": int, "default": n})
    for n in ("scan", "parse", "doctor"):
        add(n)
    add("extract", (("--no-relations",), {"action": "store_true"}))
    add("load", (("--force-full",), {"action": "store_true"}), (("--fresh",), {"action": "store_true"}), (("--snapshot-label",), {"default": ""}), (("--no-snapshot",), {"action": "store_true"}))
    add("pipeline", (("--load",), {"action": "store_true"}), (("--manifest",), {"default": None}))
    add("query", (("text",), {}), (("--safe",), {"action": "store_true"}))
    add("search", (("text",), {}), project, limit(20), (("-i", "--index"), {"choices": ["all", "functions", "symbols"], "default": "all"}))
    add("ask", (("text",), {}), project)
    add("compare", (("a",), {}), (("b",), {}), (("-m", "--mode"), {"default": "shared"}))
    add("impact", (("symbol",), {}), project, limit(50), (("-d", "--depth"), {"type": int, "default": 3, "choices": range(1, 11)}))
    output, yes = (("-o", "--output"), {"default": ""}), {"action": "store_true"}
    add("analyze", (("what",), {"choices": ["metrics", "hotspots", "security", "debt", "refactor", "duplicates", "patterns", "full", "churn-hotspots"]}), project, limit(25), (("-t", "--type", "-c"), {"default": ""}), (("--since",), {"default": "6.months"}), output)
    add("snapshots", (("what",), {"choices": ["list", "create", "diff", "report"]}), (("names",), {"nargs": "*"}), (("--label",), {"default": ""}), (("--show-keys",), yes), output)
    add("delta", (("names",), {"nargs": 2}), (("--show-lists",), yes), output)
    add(
        "enrich", (("what",), {"choices": ["backlog", "collectors", "intelligence", "repos", "campaign", "chunk-scan", "index-audit"]}), (("--root",), {"default": ""}), (("--catalog",), {"default": "catalog"}), (("--db",), {"default": ""}),
        (("--limit",), {"type": int, "default": 20}), (("--min-lines",), {"type": int, "default": 1}), (("--root-prefix",), {"default": ""}), (("--include-enriched",), yes), (("--min-score",), {"type": float, "default": 4.0}), (("--top",), {"type": int, "default": 50}),
        (("--exclude-subpath",), {"action": "append", "default": []}), (("--append",), yes), (("--dry-run",), yes), (("--execute",), yes), (("--stop-on-error",), yes), (("--chunk-size",), {"type": int, "default": 6}), (("--max-projects",), {"type": int, "default": 0}),
        (("--resume",), yes), (("--min-file-sim",), {"type": float, "default": 0.65}), (("--min-func-sim",), {"type": float, "default": 0.8}), (("--max-file-pairs",), {"type": int, "default": 1000}), (("--max-func-pairs",), {"type": int, "default": 2000}),
        (("--complexity",), {"type": int, "default": 10}), output,
    )
    return p


def churn_hotspots(s: Store, projects: list, project: str, since: str, limit: int) -> DataFrame:
    """Files by coupling and recent churn of the projects' version control."""
    chosen = [p for p in projects if not project or p.name == project]
    texts = s.spark.createDataFrame([(p.name, churn_text(p.root, since)) for p in chosen], "project string, text string")
    return C.churn_hotspots(C.file_stats(G.kept(s.functions(), project), s.edges()), X.numstat(texts, "project"), limit)


def enrich(s: Store, a: argparse.Namespace) -> None:
    """Catalog commands: reports are shown, what is written goes to the catalog."""
    spark = s.spark
    if a.what == "backlog":
        done = read_sqlite(spark, a.db, "enrichment") if "enrichment" in sqlite_tables(a.db) else None
        show(C.backlog(read_sqlite(spark, a.db, "projects"), done, a.min_lines, a.root_prefix, a.include_enriched, a.limit), a.output)
    elif a.what == "index-audit":
        keys, columns = sqlite_keys(a.db)
        show(spark.createDataFrame(key_audit(keys, columns), "table string, columns string, status string"), a.output)
    elif a.what == "chunk-scan":
        table(N.chunk_scan(spark, a.root, a.catalog, a.chunk_size, tuple(a.exclude_subpath), a.max_projects, a.resume, a.dry_run))
    elif a.what == "campaign":
        table(N.campaign(spark, a.catalog, a.root, a.limit, a.min_lines, a.execute, a.include_enriched, a.stop_on_error))
    elif a.what == "repos":
        table(N.enrich_repository(spark, a.root, a.catalog, append=a.append))
    else:
        files = write_table(scan(spark, [Project(a.root.rstrip("/").rsplit("/", 1)[-1], a.root)]), "scan")
        owner = F.lit(a.root).alias("source_path")
        if a.what == "collectors":
            rows = write_table(N.collectors(files.select("path", "text"), a.min_score, tuple(a.exclude_subpath)), "collectors")
            if not a.dry_run:
                N.write_catalog(spark, a.catalog, "file_signals", rows.select(owner, "*"), a.append)
                N.write_catalog(spark, a.catalog, "project_signals", Y.collector_summary(rows, a.top).select(owner, "*"), a.append)
            show(Y.top_collectors(rows, a.top), a.output)
        else:
            parts = N.intelligence(files, a.min_file_sim, a.min_func_sim, a.max_file_pairs, a.max_func_pairs, a.complexity)
            for name, rows in parts.items() if not a.dry_run else ():
                N.write_catalog(spark, a.catalog, name, rows.select(owner, "*"), a.append)
            show(parts["project_intelligence"], a.output)


def analyze(s: Store, what: str, project: str, limit: int, kind: str) -> DataFrame:
    f = s.functions()
    if what == "metrics":
        return G.metrics_by_name(f, s.edges(), project, limit)
    if what == "hotspots":
        return G.hotspots(f, s.edges(), project, limit)
    if what == "debt":
        return G.debt(f, project)
    if what == "duplicates":
        return G.duplicates(f, project, limit)
    if what == "full":
        return G.full_report(f, project)
    words = G.pattern_words(kind or "all") if what == "patterns" else (kind,)
    return G.name_contains(f, words, project, 100 if what == "patterns" else 50)


def compare(s: Store, a: str, b: str, mode: str) -> DataFrame:
    f = s.functions()
    if mode == "shared":
        return G.compare_shared(f, a, b)
    if mode in ("unique-a", "unique-b"):
        return G.compare_unique(f, *((a, b) if mode == "unique-a" else (b, a)))
    if mode == "metrics":
        return G.compare_metrics(f, [a, b])
    if mode == "patterns":
        return G.compare_patterns(f, [a, b], {"factories": "factory", "singletons": "singleton"})
    return G.listing(f, [a, b])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "doctor":
        for m in ("pyspark", "pyarrow", "pandas", "yaml"):
            print(f"{m}: {'ok' if importlib.util.find_spec(m) else 'missing'}")
        return 0
    settings = load_settings(a.settings)
    s = Store(get_session(master=a.master), settings.out_dir)
    if a.command == "scan":
        print(s.scan(load_projects(a.config), settings).count())
    elif a.command == "parse":
        print(s.parse().count())
    elif a.command == "extract":
        print(s.extract(not a.no_relations).count())
    elif a.command == "load":
        print(json.dumps(s.load(a.force_full, a.fresh)))
        if not a.no_snapshot:
            print(s.snapshot(a.snapshot_label))
    elif a.command == "pipeline":
        out = run_pipeline(s, load_projects(a.config), settings, a.load, manifest=a.manifest)
        print(json.dumps(out, indent=2))
        return int(out["status"] != "ok")
    elif a.command == "query":
        for name in ("nodes", "edges"):
            s.read(name).createOrReplaceTempView(name)
        show(guard.run(s.spark, open(a.text, encoding="utf-8").read() if a.text.endswith(".sql") else a.text, a.safe))
    elif a.command == "search":
        show(S.find(s.search_nodes(), s.search_index(), a.text, a.index, a.project, a.limit))
    elif a.command == "ask":
        show(G.ask(s.functions(), a.text, a.project))
    elif a.command == "compare":
        show(compare(s, a.a, a.b, a.mode))
    elif a.command == "impact":
        f, calls, edges = s.functions(), s.calls(), s.edges()
        show(G.direct_callers(f, calls, a.symbol, a.project, a.limit))
        show(G.file_callers(f, calls, a.symbol, a.project, a.limit))
        show(G.transitive_callers(f, edges, a.symbol, a.depth, a.project).orderBy("hops", "name", "uid").limit(a.limit))
        show(G.impact_summary(f, calls, edges, a.symbol, a.depth))
    elif a.command == "analyze":
        show(churn_hotspots(s, load_projects(a.config), a.project, a.since, a.limit) if a.what == "churn-hotspots" else analyze(s, a.what, a.project, a.limit, a.type), a.output)
    elif a.command == "enrich":
        enrich(s, a)
    elif a.command == "snapshots":
        if a.what == "create":
            print(s.snapshot(a.label))
        elif a.what == "list":
            print("\n".join(s.snapshots()))
        else:
            changes = s.diff(*a.names[:2]).where("change <> 'unchanged'")
            show(report(s.diff(*a.names[:2])), a.output)
            if a.what == "diff" and a.show_keys:
                show(changes.orderBy("change", "identity"))
    elif a.command == "delta":
        changes = parse_identity(s.diff(*a.names).where("change <> 'unchanged'"))
        show(changes.groupBy("change", "kind", "type").count().orderBy("change", "kind", "type"), a.output)
        for kind in ("Function", "File") if a.show_lists else ():
            show(changes.where((F.col("kind") == "node") & (F.col("type") == kind)).orderBy("identity"))
    clean(s.spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
