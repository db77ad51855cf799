"""Corpus pipeline: quality, line dedup, near-duplicate groups, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns the columns of ``documents``; the last returns packed pieces. Null texts are
empty texts; rows with a null doc_id pass the filters; repeated rows share one fate
except in the near-duplicate stage, which keeps one of them. An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, stash
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.jaccard import keep_one
from graphloom.llm.linededup import dedup_lines
from graphloom.llm.packing import pack
from graphloom.llm.quality import score
from graphloom.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document with a lower calibrated probability of quality 1 goes.
LEAST_QUALITY = 0.3
#: A document that covers so much of a benchmark item goes.
LEAST_COVERAGE = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    got = score(docs, table(spark, sf_dir, "labels"))
    bad = stash(got.where((F.col("score") < LEAST_QUALITY) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_bad")).distinct(), "rejected")
    return docs.select(*COLUMNS).join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more documents share; ``n_chars`` follows."""
    got = dedup_lines(docs.select(*COLUMNS))
    return got.select("doc_id", "text", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    got = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), threshold=LEAST_COVERAGE)
    return got.where("_n_items = 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, mixed by source."""
    return pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name)
    return docs


#: No SQL expresses the trained classifier, so the chain is tested against brute force.
ORACLE_SQL = None
