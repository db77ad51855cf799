"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed, ``least`` words in a row, are tiled:
running Karp-Rabin hashes find the longest run of words that both still have unmarked,
it is marked on both sides, and so on down to ``least`` words. The share of the item's
words in tiles is its coverage, whatever order the document has them in.

Seeds are joined by hash. Documents are first sifted by a bit table of all items' seeds,
whose size is fixed; only what it lets through is shuffled, as hashes. Texts that share a
seed with an item are tiled once, however often they stand there, as a stream sorted by
text: no document's items and no item's documents are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import textkit as tk
from graphloom.llm.common import lean, prepare, stash

LEAST = 5
#: The bit table of seeds has 2**LOG_BITS bits (2 MB); a fuller one only lets more through.
LOG_BITS = 24
_SEGMENT = 16  # its low bits are put together in segments of 2**16


def runs(w: np.ndarray) -> np.ndarray:
    """Prefix sums of which ``window`` makes Karp-Rabin hashes of any length."""
    return tk.prefix(w)


def window(pre: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all windows of n words."""
    at = np.arange(max(len(pre) - n, 0))
    return tk.span_hash(pre, at, at + n)


def free(marked: np.ndarray, n: int) -> np.ndarray:
    """Places where a window of n words holds no marked one."""
    s = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(s[n:] == s[:-n]) if n < len(s) else np.zeros(0, np.int64)


def near_seeds(item: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """The document's words that lie in a common seed, with a word that no text has
    between stretches: every common run of ``least`` words is in one of them."""
    hit = np.isin(window(runs(doc), least), window(runs(item), least))
    if not hit.any():
        return doc[:0]
    inside = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + least, -1)
    inside = np.cumsum(inside[:-1]) > 0
    out = np.where(inside, doc, np.uint64(0))
    return out[inside | np.concatenate([[False], inside[:-1]])]


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> int:
    """Number of the item's words in greedy tiles.

    The longest common run of unmarked words is sought by Karp-Rabin hashes of falling
    lengths, then all runs of that length are marked, the first places first. Memory is
    in proportion to the two texts, however repetitive they are.
    """
    least = min(least, len(item))
    if not least:
        return 0
    doc = near_seeds(item, doc, least)
    a, b = np.zeros(len(item), bool), doc == 0
    own, other = runs(item), runs(doc)

    def common(n: int) -> tuple | None:
        """Unmarked windows of n words: the item's that the document has too, and the document's."""
        i, j = free(a, n), free(b, n)
        if not len(i) or not len(j):
            return None
        hi, hj = window(own, n)[i], window(other, n)[j]
        both = np.isin(hi, hj)
        return (n, i[both], hi[both], j, hj) if both.any() else None

    most = min(len(item), len(doc))
    while found := common(least):
        # a common run holds common runs of any shorter length: double, then halve
        while 2 * found[0] <= most and (more := common(2 * found[0])):
            found = more
        low, high = found[0] + 1, min(most, 2 * found[0] - 1)
        while low <= high:
            n = (low + high + 1) // 2
            if more := common(n):
                found, low = more, n + 1
            else:
                high = n - 1
        most, i, hi, j, hj = found
        order = np.argsort(hj, kind="stable")
        j, hj = j[order], hj[order]
        first, last = np.searchsorted(hj, hi, "left"), np.searchsorted(hj, hi, "right")
        passed: dict[int, int] = {}  # of each hash, places that are marked by now
        for p, s, e in zip(i.tolist(), first.tolist(), last.tolist(), strict=True):
            if a[p : p + most].any():
                continue
            k = passed.get(s, s)
            while k < e and b[j[k] : j[k] + most].any():
                k += 1
            if k < e:
                a[p : p + most] = b[j[k] : j[k] + most] = True
            passed[s] = k
    return int(a.sum())


def _words(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets) of slices of a column."""
    data, off = tk.utf8(pc.utf8_lower(col))
    for i, j in tk.slices(off):
        w, woff, _ = tk.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, np.maximum(w, np.uint64(1)), woff


def seed_bits(seeds: DataFrame) -> np.ndarray:
    """The bit table of (seed): segments are made in parallel, one array of fixed size is collected."""
    slot = F.shiftrightunsigned("seed", 64 - LOG_BITS)
    width = 1 << _SEGMENT

    def fill(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, bool)
        for b in parts:
            bits[b.column(1).to_numpy() & (width - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()])], names=["seg", "bits"])

    out = np.zeros((1 << LOG_BITS) // 8, np.uint8)
    slots = seeds.select(slot.alias("slot")).distinct().select(F.shiftright("slot", _SEGMENT).alias("seg"), "slot")
    for r in slots.groupBy("seg").applyInArrow(fill, "seg long, bits binary").toLocalIterator():
        out[r[0] * (width // 8) : (r[0] + 1) * (width // 8)] = np.frombuffer(r[1], np.uint8)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", least: int = LEAST, threshold: float = 0.8) -> DataFrame:
    """All rows and columns of ``docs``, with ``_coverage`` (double, the largest of any
    item), ``_item`` (that item; the smallest of equals, null last; null without a common
    seed) and ``_n_items`` (items covered to at least ``threshold``).

    Words are lower-cased runs of letters and digits. Null and empty texts have coverage
    0, and so have null and empty items. Items with fewer than ``least`` words are seeded
    by all their words: they are covered where these stand in a row. Repeated items count
    each; repeated documents share their result. An empty benchmark leaves every coverage 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = benchmark.schema[item_key].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, off in _words(b.column(2)):
                keep = np.flatnonzero(np.diff(off))
                words = [w[off[k] : off[k + 1]] for k in keep]
                short = [window(runs(x), min(least, len(x))).view(np.int64) for x in words]
                sizes = pa.array([min(least, len(x)) for x in words], pa.int32())
                at = pa.array(i + keep)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), sizes, pa.array(short, pa.list_(pa.int64())), pa.array([x.tobytes() for x in words], pa.binary())], names=["idx", "k", "n", "seeds", "words"]
                )

    listed = stash(benchmark.select(F.monotonically_increasing_id().alias("idx"), F.col(item_key).alias("k"), "text"), "benchmark")
    schema = T.StructType().add("idx", "long").add("k", kind).add("n", T.IntegerType()).add("seeds", T.ArrayType(T.LongType())).add("words", "binary")
    items = stash(listed.mapInArrow(lean(read), schema), "items")
    seeds = items.select("idx", F.explode(F.array_distinct("seeds")).alias("seed"))
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # from 1 to least
    bits = spark.sparkContext.broadcast(seed_bits(seeds))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).view(bool)
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, w, off in _words(b.column(2)):
                pre, row = runs(w), np.repeat(np.arange(len(off) - 1), np.diff(off))
                for n in lengths:
                    h = window(pre, n)
                    hit = np.flatnonzero(table[(h >> np.uint64(64 - LOG_BITS)).astype(np.int64)])
                    hit = hit[row[hit] == row[hit + n - 1]]  # inside one document
                    got = np.unique(np.stack([row[hit].astype(np.int64), h[hit].view(np.int64)]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h1[i + got[0]]), pa.array(h2[i + got[0]]), pa.array(got[1])], names=["h1", "h2", "seed"])

    # a text is named by 128 bits, so that equal ones are tiled once
    name = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    some = docs.where("text is not null").select(*name, "text")
    hits = stash(some.mapInArrow(lean(sift), "h1 long, h2 long, seed long").distinct(), "seeds")
    pairs = stash(hits.join(seeds, "seed").select("h1", "h2", "idx").distinct(), "pairs")

    null = lambda t: F.lit(None).cast(t)
    texts = some.join(pairs.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    texts = texts.select("h1", "h2", F.lit(0).alias("part"), "text", null("long").alias("idx"), null("binary").alias("words"))
    asked = pairs.join(items.select("idx", "words"), "idx").select("h1", "h2", F.lit(1).alias("part"), null("string").alias("text"), "idx", "words")
    work = texts.unionByName(asked).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "part")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = np.zeros(0, np.uint64)  # of the text that the following pairs belong to
        for b in batches:
            h1, h2, idx, share = [], [], [], []
            for i, (part, raw) in enumerate(zip(b.column(2).to_pylist(), b.column(5), strict=True)):
                if part == 0:
                    doc = np.concatenate([w for _, w, _ in _words(b.column(3).slice(i, 1))] or [np.zeros(0, np.uint64)])
                    continue
                item = np.frombuffer(raw.as_buffer(), np.uint64)
                h1.append(b.column(0)[i])
                h2.append(b.column(1)[i])
                idx.append(b.column(4)[i])
                share.append(tile(item, doc, least) / len(item))
            yield pa.RecordBatch.from_arrays([*(pa.array([x.as_py() for x in c], pa.int64()) for c in (h1, h2, idx)), pa.array(share, pa.float64())], names=["h1", "h2", "idx", "share"])

    tiled = stash(work.mapInArrow(lean(cover), "h1 long, h2 long, idx long, share double"), "tiles")
    best = F.min(F.struct((-F.col("share")).alias("s"), F.col("k").isNull().alias("z"), "k")).alias("best")
    found = tiled.join(items.select("idx", "k"), "idx").groupBy("h1", "h2").agg(best, F.count_if(F.col("share") >= threshold).alias("n"))
    found = stash(found.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (-F.col("best.s")).alias("_c"), F.col("best.k").alias("_k"), "n"), "covered").withColumnRenamed("n", "_n")
    out = docs.join(found, (F.xxhash64("text") == F.col("_h1")) & (F.xxhash64(F.lit(1), "text") == F.col("_h2")), "left")
    return out.select(*(docs[c] for c in docs.columns), F.coalesce("_c", F.lit(0.0)).alias("_coverage"), F.col("_k").alias("_item"), F.coalesce("_n", F.lit(0)).cast("long").alias("_n_items"))
