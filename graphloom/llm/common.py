"""What every training-data operator shares: shared storage, batches, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.storage import drop_table, write_table

#: Rows of an Arrow batch between the JVM and Python: texts are long, so few.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Make this package importable by Python workers and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage durably: a lost executor costs a re-read, never a recomputation.
    Shuffles that only fed the written table become garbage, and are collected.
    """
    out = write_table(df, tag, "zstd")
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


discard = drop_table


def release() -> None:
    """Give memory that was freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def lean(work: Callable) -> Callable:
    """``work`` over batches, and then ``release``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


#: A key with more rows than this doesn't go through a shuffle if its rows can meet a broadcast one.
HEAVY = 5_000
#: Heavy keys that are broadcast, at most; more of them are left to the engine's skew joins.
HEAVY_KEYS = 200_000


def join_split(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """``left`` joined with ``right``, a written table that has each key once and in ``rows``
    how many rows of ``left`` the key has: rows of heavy keys stay where they are and meet a
    broadcast side of checked size, the others are shuffled, so no task gathers a heavy key."""
    heavy = right.where(F.col(rows) > HEAVY)
    n = heavy.limit(HEAVY_KEYS + 1).count()
    if not 0 < n <= HEAVY_KEYS:
        return left.join(right.hint("merge"), on)
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(rows) <= HEAVY).hint("merge"), on)
    return left.join(F.broadcast(heavy), on).unionByName(rest)


def size_of(df: DataFrame) -> int:
    """Bytes of a plan's result, as the optimiser estimates them; those of files are known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, for tasks that each build a table of fixed size: some for
    each core, and at least one for every two gigabytes, however few cores there are yet."""
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(max(2 * cores, min(size_of(df) >> 31, 100_000)))


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, tag: str) -> DataFrame:
    """Stash ``df`` with ``out``: the sum of ``value`` over all rows before it in ``order``.

    Rows are range-partitioned by ``order``, summed inside each partition as a
    stream, and shifted by the totals of the earlier partitions. Only one total
    for each partition reaches the driver, so no task sees more than its range.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(out, T.LongType())])
    at = df.columns.index(value)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.cumsum(v)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(total + c - v)],
                names=[*b.schema.names, "_part", out],
            )
            total += int(c[-1]) if len(c) else 0

    got = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(local), schema), tag)
    totals = sorted((r[0], r[1]) for r in got.groupBy("_part").agg(F.sum(value)).collect())
    shift, total = [], 0
    for p, t in totals:
        shift.append((p, total))
        total += t or 0
    at_part = df.sparkSession.createDataFrame(shift or [(0, 0)], "_part int, _shift long")
    return got.join(F.broadcast(at_part), "_part").withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_shift")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with one value of ``key`` (never null), from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and not (i == 0 and held[-1].column(b.schema.get_field_index(key))[-1].as_py() == k[s]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) reaches.

    Alternating min-label hooking and pointer jumping on a written edge table:
    each round sends every node the least label around it, so labels shrink over
    doubling distances. The number of rounds is logarithmic in the longest chain;
    each round is two aggregations with map-side combine.
    """
    e = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), tag)
    label = stash(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("c")), tag)
    while True:
        # the least label of the neighbours, told also to the own label's node
        near = e.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("n"))
        low = label.join(near, "node").select("node", "c", F.least("c", "n").alias("n"))
        hook = low.groupBy(F.col("c").alias("node")).agg(F.min("n").alias("h"))
        step = low.join(hook, "node", "left").select("node", F.col("c").alias("was"), F.least("n", "h").alias("c"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("j"))
        new = stash(step.join(jump, "c", "left").select("node", "was", F.least("c", "j").alias("c")), tag)
        moved = new.where("c <> was").limit(1).count()
        discard(label)
        label = new.select("node", "c")
        if not moved:
            discard(e)
            return label.withColumnRenamed("c", "component")
