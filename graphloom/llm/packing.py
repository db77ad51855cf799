"""Mixture-controlled packing: deficit round-robin over source queues, by tokens.

Each source is a queue of tokens, its documents end to end. In every round a queue's
deficit grows by its quantum, its share of one window, and the queue serves as many
tokens as the deficit has whole ones; the fraction is carried into the next round,
across windows and partitions. A queue's first deficit is a fraction drawn from its
name, so that the carried fractions of many queues average out and rounds stay as long
as windows. Token x (from 0) of a queue with quantum q and first deficit f is thus
served in the round r with floor(r q + f) <= x < floor((r + 1) q + f), so the service
order is a sort key and no task walks the queues: one distributed running sum gives
each document's place in its queue, another the place of each served piece in the
stream, which is cut every ``window`` tokens. Only the last sequence can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bpe
from graphloom.llm.common import lean, prepare, running_sum, stash
from graphloom.llm.textkit import utf8

END = 1


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", source: str = "source", end_id: int = END) -> DataFrame:
    """(row, key, source, n, ids): token ids with ``end_id`` last, as 16-bit little-endian.

    Null and empty texts have the end id alone. Null sources form the queue ''.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType().add("row", "long").add(key, kind).add("source", "string").add("n", "long").add("ids", "binary")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        for b in batches:
            flat, off = coder.encode(b.column(3))
            n = np.diff(off)
            out = np.full(len(flat) + len(n), end_id, np.uint16)
            to = off + np.arange(len(off))
            mask = np.ones(len(out), bool)
            mask[to[1:] - 1] = False
            if len(flat) and flat.max() > 0xFFFF:
                raise ValueError("token ids above 65535 are not supported")
            out[mask] = flat
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * to).astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n + 1), ids], names=schema.names)

    return stash(src.mapInArrow(lean(run), schema), "tokens")


#: Sources whose quanta are broadcast, at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 200_000
LAST = 1 << 62


def served_pieces(tokens: DataFrame, key: str = "doc_id", window: int = 2048, weights: dict[str, float] | None = None) -> DataFrame:
    """(row, begin, n, round, at): the pieces of each document that the rounds serve, with
    their place in the document and in the served stream.

    ``weights`` are the sources' target proportions; without them the corpus's own token
    shares, with which all queues end together. When a queue is empty the others go on in
    their proportions. Sources without a weight, or with one of 0, count 0 and are served
    last. Within a queue, documents go by key, nulls first, then row.
    """
    spark = tokens.sparkSession
    meta = tokens.select("row", key, "source", "n")
    queued = running_sum(meta, [F.col("source"), F.col(key).asc_nulls_first(), F.col("row")], "n", "before", "queues")
    per = stash(queued.groupBy("source").agg(F.min("before").alias("first"), F.sum("n").alias("tokens")), "sources")
    if weights is None:
        per = per.withColumn("w", F.col("tokens").cast("double"))
        total = per.agg(F.sum("tokens")).first()[0] or 1
    else:
        if any(v < 0 for v in weights.values()):
            raise ValueError("weights are not negative")
        total = sum(weights.values()) or 1
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        per = per.join(given, "source", "left").fillna(0.0, ["w"])
    drawn = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    per = per.select("source", "first", (F.lit(float(window)) * F.col("w") / F.lit(float(total))).alias("quantum"), drawn.alias("f"))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    named = queued.join(per, "source").select("row", "before", "n", "first", "quantum", "f")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, before, n, first, q, f = (b.column(i).to_numpy() for i in range(6))
            x = before - first
            none, few = q <= 0, q < 1
            safe = np.where(none, 1.0, q)
            # a round too many on either side, as quotients are rounded; empty ones go below
            low = np.maximum(np.ceil((x + 1 - f) / safe).astype(np.int64) - 2, 0)
            high = np.ceil((x + n - f) / safe).astype(np.int64)
            count = np.where(none, 1, np.where(few, n, high - low + 1))
            k = np.repeat(np.arange(len(row)), count)
            i = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            r = low[k] + i
            s, e = (np.floor(u * q[k] + f[k]).astype(np.int64) for u in (r, r + 1))
            tiny = few[k] & ~none[k]  # less than a token in a round: token by token
            r = np.where(tiny, np.maximum(np.ceil((x[k] + i + 1 - f[k]) / safe[k]).astype(np.int64) - 1, 0), r)
            s, e = np.where(tiny, x[k] + i, s), np.where(tiny, x[k] + i + 1, e)
            rest = none[k]
            r, s, e = np.where(rest, LAST, r), np.where(rest, x[k], s), np.where(rest, x[k] + n[k], e)
            s, e = np.maximum(s, x[k]), np.minimum(e, x[k] + n[k])
            ok = e > s
            k, r, s, e = k[ok], r[ok], s[ok], e[ok]
            yield pa.RecordBatch.from_arrays([pa.array(row[k]), pa.array(s - x[k]), pa.array(e - s), pa.array(r), pa.array(first[k] + s)], names=["row", "begin", "n", "round", "g"])

    pieces = named.mapInArrow(lean(split), "row long, begin long, n long, round long, g long")
    # g, the place in all queues end to end, orders a round by source and by place in the queue
    return running_sum(pieces, [F.col("round"), F.col("g")], "n", "at", "served").select("row", "begin", "n", "round", "at")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", source: str = "source", window: int = 2048, weights: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens.

    Columns: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    ``ids`` (array<int>) if asked for. An empty table gives no piece; a repeated row
    is packed as often as it stands there.
    """
    tokens = tokenize(docs, tokenizer, key, source)
    order = served_pieces(tokens, key, window, weights).groupBy("row").agg(F.collect_list(F.struct("begin", "n", "at")).alias("pieces"))
    kind = docs.schema[key].dataType
    schema = T.StructType().add(key, kind)
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema.add(c, "long")
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            size = np.diff(off) // 2
            ids = data.view("<u2").astype("<u4")
            base = np.cumsum(size) - size
            doc, begin, n, at = in_order(b.column(1))
            # a document's neighbouring pieces that are neighbours in the stream too are one
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])
            head = np.flatnonzero(new)
            n = np.add.reduceat(n, head) if len(head) else n
            doc, begin, at = doc[head], begin[head], at[head]
            # and every window's end cuts
            count = (at + n - 1) // window - at // window + 1
            k = np.repeat(np.arange(len(doc)), count)
            w = at[k] // window + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            s, e = np.maximum(at[k], w * window), np.minimum(at[k] + n[k], (w + 1) * window)
            start, length, doc = begin[k] + s - at[k], e - s, doc[k]
            raw, lo = memoryview(ids).cast("B"), 4 * (base[doc] + start)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, size[doc], w, s - w * window))]
            if with_ids:
                cols.append(pa.array([ids[i // 4 : i // 4 + m].astype(np.int32) for i, m in zip(lo.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return tokens.join(order.hint("merge"), "row").select(key, "pieces", "ids").mapInArrow(lean(cut), schema)


def in_order(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, begin, n, at) of lists of pieces, by row and begin."""
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    begin, n, at = (flat.field(i).to_numpy() for i in range(3))
    o = np.lexsort((begin, doc))
    return doc[o], begin[o], n[o], at[o]
