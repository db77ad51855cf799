"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

Pass 1 builds, for each group of input partitions, a filter of the lines it saw and
one of the lines it saw again. Two such pairs merge without the lines: what is in
both once-filters has been seen twice, so twice = a.twice | b.twice | (a.once & b.once).
A line held by two documents is always in the merged twice-filter. Pass 2 shuffles
only lines which that filter suspects (digest and document, no text), and an exact
count confirms them. Pass 3 joins each document's confirmed lines to its text.

The filters' size follows the corpus between two documented bounds, so what is broadcast
is bounded: a fuller filter suspects more lines, and stays right.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import gathered, join_split, lean, prepare, size_of, stash

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST_BITS, MOST_BITS = 26, 29  # 8 to 64 MB for each filter
PROBES = 2


def line_key(line: str) -> str:
    """The line without ASCII white space around it, ASCII letters in lower case."""
    k = line.strip(STRIP)
    return k.lower() if k.isascii() else k.translate(LOWER)


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def doc_digests(text: str | None, least: int) -> set[bytes]:
    """Digests of a text's distinct long keys."""
    found = set()
    for line in (text or "").split("\n"):
        if len(line) >= least and len(k := line_key(line)) >= least:
            found.add(digest(k))
    return found


def probes(digests: list[bytes], log_bits: int) -> np.ndarray:
    """Bit places (probe, line) of 16-byte digests."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, PROBES)
    return (words >> np.uint64(64 - log_bits)).T


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def filter_bits(docs: DataFrame) -> int:
    """Binary logarithm of a filter's bits: four for each line, of about 50 bytes in files."""
    return min(MOST_BITS, max(LEAST_BITS, (size_of(docs.select("text")) * 4 // 50).bit_length()))


def twice_filter(docs: DataFrame, least: int, log_bits: int) -> bytes:
    """The merged twice-filter of ``docs.text``.

    Tasks build filters over many partitions each; they merge by 64 KB segments in parallel.
    """
    size, seg = 1 << (log_bits - 3), 1 << min(16, log_bits - 3)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for b in batches:
            lines = [x for text in b.column(0) for x in doc_digests(text.as_py(), least)]
            if lines:
                at = probes(lines, log_bits)
                again = np.logical_and.reduce([_has(once, p) for p in at])
                n = Counter(lines)
                if len(n) < len(lines):  # seen twice in this batch
                    again |= np.fromiter((n[x] > 1 for x in lines), bool, len(lines))
                for p in at:
                    _set(twice, p[again])
                    _set(once, p)
        for i in range(0, size, seg):
            o, t = once[i : i + seg], twice[i : i + seg]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // seg], pa.int32()), pa.array([o.tobytes()]), pa.array([t.tobytes()])], names=["seg", "once", "twice"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(seg, np.uint8), np.zeros(seg, np.uint8)
        for b in parts:
            for o, t in zip(b.column(1), b.column(2), strict=True):
                o, t = np.frombuffer(o.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)
                twice |= t | (once & o)
                once |= o
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()])], names=["seg", "twice"])

    made = gathered(docs.select("text")).mapInArrow(lean(build), "seg int, once binary, twice binary")
    out = np.zeros(size, np.uint8)
    for r in made.groupBy("seg").applyInArrow(merge, "seg int, twice binary").toLocalIterator():
        out[r[0] * seg : r[0] * seg + seg] = np.frombuffer(r[1], np.uint8)
    return out.tobytes()


def repeated_lines(docs: DataFrame, key: str = "doc_id", least: int = 20, copies: int = 3, log_bits: int | None = None) -> DataFrame:
    """(key, lines): for each document, digests of the lines that it has to lose."""
    spark = docs.sparkSession
    prepare(spark)
    log_bits = filter_bits(docs) if log_bits is None else log_bits
    bits = spark.sparkContext.broadcast(twice_filter(docs, least, log_bits))
    schema = T.StructType().add(key, docs.schema[key].dataType).add("line", "binary")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            found = [(i, x) for i, text in enumerate(b.column(1)) for x in doc_digests(text.as_py(), least)]
            hit = np.logical_and.reduce([_has(table, p) for p in probes([x for _, x in found], log_bits)]) if found else []
            rows, lines = [found[k][0] for k in np.flatnonzero(hit)], [found[k][1] for k in np.flatnonzero(hit)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.binary())], names=schema.names)

    seen = stash(docs.select(key, "text").where(F.col(key).isNotNull()).mapInArrow(lean(suspects), schema), "suspects")
    counted = seen.groupBy("line").agg(F.count_distinct(key).alias("copies"), F.max(key).alias("keeper"), F.count("*").alias("rows")).where(F.col("copies") >= copies)
    return join_split(seen, stash(counted, "repeated"), ["line"], "rows").where(F.col(key) < F.col("keeper")).groupBy(key).agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", least: int = 20, copies: int = 3, log_bits: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines gone from ``text``, plus
    ``_n_lines`` (before) and ``_n_dropped``.

    A key of at least ``least`` code points held by at least ``copies`` documents
    (distinct values of ``key``) loses all its lines but those of the largest. Null
    texts count as one empty line and stay null; rows with a null key neither count
    nor lose lines; repeated rows of one key are one document and keep or lose alike.
    """
    lose = stash(repeated_lines(docs, key, least, copies, log_bits), "drops")
    # one plan at every size: the list of drops grows with the corpus
    lose = lose.select(F.col(key).alias("_key"), F.col("lines").alias("_lines")).hint("merge")
    joined = docs.join(lose, F.col(key) == F.col("_key"), "left").drop("_key")
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    at = docs.columns.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, lost = [], [], []
            for text, gone in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                text = text.as_py()
                lines = (text or "").split("\n")
                n.append(len(lines))
                if gone.is_valid:
                    bad = set(gone.as_py())
                    kept = [x for x in lines if len(x) < least or len(k := line_key(x)) < least or digest(k) not in bad]
                    lost.append(len(lines) - len(kept))
                    text = "\n".join(kept)
                else:
                    lost.append(0)
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

    return joined.mapInArrow(lean(drop), schema)
