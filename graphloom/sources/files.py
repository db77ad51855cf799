"""Sources: project configuration, file scans, JSON lines, SQLite catalogs, version control."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_VARIABLE = re.compile(r"\$\{([A-Z0-9_]+)(?::-([^}]*))?\}")


@dataclass(frozen=True)
class Project:
    name: str
    root: str
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    out_dir: str = "data"
    include_ext: tuple[str, ...] = (".py", ".js", ".ts")
    max_files: int = 0
    extra: dict = field(default_factory=dict)


def expand_variables(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME:-default}`` from the environment."""
    env = dict(os.environ) if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)


def read_dotenv(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        k, eq, v = line.strip().removeprefix("export ").partition("=")
        if eq and not line.lstrip().startswith("#"):
            out[k.strip()] = v.strip().strip("'\"")
    return out


@cache
def _dotenv_file(path: Path) -> dict[str, str]:
    """Variables of a .env file, read once in a process."""
    return read_dotenv(path.read_text(encoding="utf-8"))


def environment(config_dir: Path, cwd: Path | None = None) -> dict[str, str]:
    """Variables of .env files in the working folder, the configuration's and its ancestors;
    later ones win among them, the real environment over all."""
    found: dict[str, str] = {}
    for d in [cwd or Path.cwd(), config_dir, *config_dir.parents]:
        if (d / ".env").is_file():
            found.update(_dotenv_file(d / ".env"))
    return {**found, **os.environ}


def _yaml(path: str) -> object:
    import yaml

    p = Path(path)
    return yaml.safe_load(expand_variables(p.read_text(encoding="utf-8"), environment(p.resolve().parent))) or {}


def load_projects(path: str) -> list[Project]:
    """Projects of a YAML list; entries without name or root are skipped."""
    data = _yaml(path)
    rows = data.get("projects", []) if isinstance(data, dict) else data
    out = []
    for r in rows if isinstance(rows, list) else []:
        if isinstance(r, dict) and r.get("name") and r.get("root"):
            ex = r.get("exclude")
            out.append(Project(str(r["name"]), str(r["root"]), tuple(map(str, ex)) if isinstance(ex, list) else ()))
    return out


def load_settings(path: str) -> Settings:
    d = _yaml(path)
    d = d if isinstance(d, dict) else {}
    run = d.get("run", d)
    return Settings(str(run.get("out_dir", "data")), tuple(run.get("include_ext", Settings.include_ext)), int(run.get("max_files", 0) or 0), {k: v for k, v in d.items() if k != "run"})


def list_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, size) of all files below a folder of any file system, in no order."""
    plain = re.sub(r"^file:/+", "/", root)
    if "://" not in plain:
        return [(p, os.path.getsize(p)) for d, _, names in os.walk(os.path.abspath(plain)) for n in names if os.path.isfile(p := os.path.join(d, n))]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen()))
    return out


def read_bytes(path: str) -> bytes:
    """A file's content, in a worker."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        return f.read()


def _passed_over(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of files that Spark's sources never read: those with nothing in
    them, and those whose name, or a folder's, begins with '_' or '.'; workers read them."""
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    base = base if "://" in base else os.path.abspath(base)
    hidden = re.compile(r"(^|/)[._]")
    rows = [(p, n) for p, n in list_files(spark, root) if n == 0 or hidden.search(p[len(base) :].lstrip("/"))]
    listed = spark.createDataFrame(rows, "path string, length long")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            content = [read_bytes(p) if n else b"" for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.binary())], names=["path", "length", "content"])

    return listed.mapInArrow(read, "path string, length long, content binary")


def scan(spark: SparkSession, projects: list[Project], settings: Settings | None = None, most_bytes: int | None = None, content: bool = True) -> DataFrame:
    """(project, root, path, rel_path, ext, size[, text]) of all files of the projects.

    Spark reads the files in parallel, workers those that its sources pass over. A file goes if a part of its path is an
    excluded name, if its lower-cased suffix isn't included, or if it is over ``most_bytes``.
    With ``max_files`` the first files of each project by path stay.
    """
    settings = settings or Settings()
    out = None
    for p in projects:
        d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p.root).select("path", "length", "content")
        d = d.unionByName(_passed_over(spark, p.root))
        root = re.sub(r"^file:/+", "/", p.root.rstrip("/"))
        path = F.regexp_replace("path", "^file:/+", "/")
        rel = path.substr(F.lit(len(root if "://" in root else os.path.abspath(root)) + 2), F.lit(1 << 30))
        d = d.select(F.lit(p.name).alias("project"), F.lit(p.root).alias("root"), path.alias("path"), rel.alias("rel_path"), F.col("length").alias("size"), *(["content"] if content else []))
        d = d.withColumn("ext", F.lower(F.regexp_extract("rel_path", r"\.[^./]+$", 0))).where(F.col("ext").isin(*settings.include_ext))
        if p.exclude:
            d = d.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, p.exclude))))
        if most_bytes:
            d = d.where(F.col("size") <= most_bytes)
        if settings.max_files:
            d = d.orderBy(F.split("rel_path", "/")).limit(settings.max_files)
        out = d if out is None else out.unionByName(d)
    cols = ["project", "root", "path", "rel_path", "ext", "size"]
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'size' else 'string'}" for c in [*cols, *(["text"] if content else [])]))
    return out.select(*cols, F.decode("content", "UTF-8").alias("text")) if content else out.select(*cols)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSON-lines file; a missing file is empty, blank lines and lines that
    aren't objects are skipped."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path).where(F.trim("value").startswith("{"))
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_document(path: str) -> dict:
    """A JSON object; {} for anything else."""
    try:
        d = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return d if isinstance(d, dict) else {}


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ..).option("table", ..)``: rowid ranges
    are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "REAL": "double"}
        with sqlite3.connect(self.options["path"]) as c:
            cols = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get((r[2] or '').upper(), 'string')}" for r in cols)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.options["path"]) as c:
            lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if lo is None:  # one empty range: no partition at all is read as one without a value
            return [InputPartition((0, -1))]
        step = max(1, (hi - lo + 1) // int(self.options.get("partitions", 4)) + 1)
        return [InputPartition((s, min(hi, s + step - 1))) for s in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition):
        cols = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(self.options["path"]) as c:
            yield from c.execute(f'SELECT {cols} FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', partition.value)


def sqlite_tables(path: str) -> set[str]:
    with sqlite3.connect(path) as c:
        return {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def sqlite_keys(path: str) -> tuple[list[tuple[str, tuple[str, ...]]], dict[str, set[str]]]:
    """Keys (table, columns) of a catalog's indexes, and the columns of its tables."""
    keys, columns = [], {}
    with sqlite3.connect(path) as c:
        for t in sorted(sqlite_tables(path)):
            columns[t] = {r[1] for r in c.execute(f'PRAGMA table_info("{t}")')}
            for i in c.execute(f'PRAGMA index_list("{t}")').fetchall():
                keys.append((t, tuple(str(r[2]) for r in c.execute(f'PRAGMA index_info("{i[1]}")'))))
    return keys, columns


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).load()


def _run(command: list[str], cwd: str) -> str:
    try:
        r = subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=120, check=False)
    except FileNotFoundError:
        if not os.path.isdir(cwd):
            raise
        return ""
    return r.stdout if r.returncode == 0 else ""


def churn_text(root: str, since: str = "6.months", run: Callable[[list[str], str], str] = _run) -> str:
    """Version-control history as numstat text; empty without a history."""
    return run(["git", "log", f"--since={since.replace('.', ' ')}", "--numstat", "--pretty=format:COMMIT"], root)


def staged_files(root: str, run: Callable[[list[str], str], str] = _run) -> list[str]:
    return [x for x in run(["git", "diff", "--cached", "--name-only"], root).splitlines() if x.strip()]


def discover(root: str, include: set[str] | None = None, exclude: set[str] | None = None) -> list[Project]:
    """Child folders as projects, without those that begin with '_'."""
    out = []
    for d in sorted(Path(root).iterdir()):
        if d.is_dir() and not d.name.startswith("_") and (not include or d.name in include) and d.name not in (exclude or ()):
            out.append(Project(d.name, str(d)))
    return out
