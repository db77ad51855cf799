"""Structured Streaming form of the incremental load: files of events arrive in a folder,
and each micro-batch appends its new or changed identities to a state of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.incremental import changed_rows
from graphloom.schema import HASHES
from graphloom.storage import list_names

#: After so many batches the state is written whole, so that reading it stays short.
COMPACT = 64


def _parts(spark: SparkSession, path: str, version: int) -> list[str]:
    """The last whole state and the batches after it, of batches up to ``version``."""
    batches = sorted(int(n[1:]) for n in list_names(spark, path) if n[0] == "b" and int(n[1:]) <= version)
    whole = [n for n in batches if n % COMPACT == COMPACT - 1]
    return [f"{path}/b{n}" for n in batches if not whole or n >= whole[-1]]


def state(spark: SparkSession, path: str, version: int = 1 << 62) -> DataFrame:
    """(identity, hash): the last hash of every identity up to a batch."""
    parts = _parts(spark, path, version)
    if not parts:
        return spark.createDataFrame([], HASHES)
    rows = None
    for p in parts:
        d = spark.read.schema(HASHES).parquet(p).withColumn("n", F.lit(int(p.rsplit("/b", 1)[1])).cast("long"))
        rows = d if rows is None else rows.unionByName(d)
    return rows.groupBy("identity").agg(F.max_by("hash", "n").alias("hash"))


def load_stream(spark: SparkSession, events: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Run over what has arrived. Batch n writes folder n from the folders before it, so a
    batch that is run again gives the same state; only what changed is written."""

    def upsert(batch: DataFrame, n: int) -> None:
        new = batch.groupBy("identity").agg(F.max("hash").alias("hash"))
        old = state(spark, state_path, n - 1)
        rows = changed_rows(old, new).select("identity", "hash")
        if n % COMPACT == COMPACT - 1:
            rows = old.join(rows, "identity", "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{state_path}/b{n}")

    rows = spark.readStream.schema(HASHES).parquet(events)
    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
