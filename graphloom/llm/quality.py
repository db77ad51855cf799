"""Quality classifier on random-indexing word vectors.

Every token gets a sparse random index vector from its hash. A token's word vector is
the sum of the index vectors of its neighbours, over the whole corpus; words share
2**LOG_VOCAB hashed rows, so the table has a fixed size. A document is the mean and
the spread of its tokens' vectors. A two-layer numpy network, fitted on a bounded
sample of labelled rows and calibrated by a temperature, turns that into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import textkit as tk
from graphloom.llm.common import gathered, lean, prepare, stash

LOG_VOCAB, DIMS, REACH, NONZERO = 14, 64, 2, 2
FEATURES = 2 * DIMS + 1
#: At most so many labelled rows (those with the smallest hashes) fit the network.
TRAIN_ROWS = 20_000

# 1 word, 2 punctuation, 0 blanks and controls
KIND = np.where(tk.WORD, 1, 2).astype(np.uint8)
KIND[:33] = 0
KIND[127] = 0


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of word characters and of punctuation, case kept; row offsets in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    kind = KIND[data]
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[off[:-1][off[:-1] < len(data)]] = True
    cut = np.flatnonzero(start)
    ends = np.append(cut[1:], len(data))
    real = kind[cut] > 0
    s, e = cut[real], ends[real]
    return tk.span_hash(tk.prefix(data), s, e), np.searchsorted(s, off)


def rows_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - LOG_VOCAB)).astype(np.int64)


def index_vector(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each nonzero of the tokens' index vectors."""
    out = []
    for k in range(NONZERO):
        b = h >> np.uint64(7 * k)
        out.append(((b & np.uint64(DIMS - 1)).astype(np.int64), 1.0 - 2.0 * ((b >> np.uint64(6)) & np.uint64(1)).astype(np.float64)))
    return out


def gather(h: np.ndarray, off: np.ndarray, into: np.ndarray, counts: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours in the same text."""
    rows, vecs = rows_of(h), index_vector(h)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    counts += np.bincount(rows, minlength=len(counts))
    for d in range(1, REACH + 1):
        same = text[d:] == text[:-d]
        left, right = np.flatnonzero(same), np.flatnonzero(same) + d
        for dim, sign in vecs:
            into += np.bincount(np.concatenate([rows[left] * DIMS + dim[right], rows[right] * DIMS + dim[left]]), np.concatenate([sign[right], sign[left]]), minlength=len(into))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(2**LOG_VOCAB, DIMS) float32 unit vectors from all of ``docs.text``, scaled so that
    frequent rows weigh less. Partial tables follow the cores and merge by segments."""
    prepare(docs.sparkSession)
    vocab, seg = 1 << LOG_VOCAB, 1 << (LOG_VOCAB - 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(vocab * DIMS), np.zeros(vocab, np.int64)
        for b in batches:
            data, off = tk.utf8(b.column(0))
            for i, j in tk.slices(off):
                gather(*tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]), sums, n)
        for k in range(16):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([sums[k * seg * DIMS : (k + 1) * seg * DIMS].astype(np.int64).tobytes()]), pa.array([n[k * seg : (k + 1) * seg].tobytes()])],
                names=["seg", "sums", "n"],
            )

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(seg * DIMS, np.int64), np.zeros(seg, np.int64)
        for b in parts:
            for x, y in zip(b.column(1), b.column(2), strict=True):
                s += np.frombuffer(x.as_buffer(), np.int64)
                n += np.frombuffer(y.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([s.tobytes()]), pa.array([n.tobytes()])], names=["seg", "sums", "n"])

    made = gathered(docs.select("text")).mapInArrow(lean(count), "seg int, sums binary, n binary")
    sums, n = np.zeros((vocab, DIMS)), np.zeros(vocab)
    for r in made.groupBy("seg").applyInArrow(merge, "seg int, sums binary, n binary").toLocalIterator():
        sums[r[0] * seg : (r[0] + 1) * seg] = np.frombuffer(r[1], np.int64).reshape(seg, DIMS)
        n[r[0] * seg : (r[0] + 1) * seg] = np.frombuffer(r[2], np.int64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    share = n / max(1.0, n.sum())
    return (sums / np.where(norm > 0, norm, 1) * np.sqrt(1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pooled(h: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text; zeros for one without tokens."""
    n = np.diff(off)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        x = vectors[rows_of(h)]
        at, c = off[:-1][some], n[some, None]
        mean = np.add.reduceat(x, at) / c
        out[some, :DIMS] = mean
        out[some, DIMS:-1] = np.sqrt(np.maximum(np.add.reduceat(np.square(x, out=x), at) / c - mean * mean, 0))
        out[:, -1] = np.log1p(n) / 10
    return out


def features(docs: DataFrame, vectors: np.ndarray, key: str) -> DataFrame:
    """(key, x): pooled features of every whole text, as float32 bytes."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = T.StructType().add(key, docs.schema[key].dataType).add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            data, off = tk.utf8(b.column(1))
            xs: list[bytes] = []
            for i, j in tk.slices(off, tk.SLICE // 4):
                xs += [r.tobytes() for r in pooled(*tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]), v)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.binary())], names=schema.names)

    return docs.select(key, "text").mapInArrow(lean(run), schema)


class Network:
    """One tanh layer, one logistic output, then a temperature."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w1, self.b1 = r.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden)
        self.w2, self.b2 = r.normal(0, 1 / np.sqrt(hidden), hidden), 0.0
        self.mu, self.sd, self.temperature, self.seed = np.zeros(FEATURES), np.ones(FEATURES), 1.0, seed

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mu) / self.sd @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128) -> Network:
        """Adam on four fifths of the rows; the rest chooses the epoch and the temperature."""
        if not len(y) or y.min() == y.max():
            self.w2[:] = 0
            p = (y.sum() + 1) / (len(y) + 2)
            self.b2 = float(np.log(p / (1 - p)))
            return self
        r = np.random.default_rng(self.seed)
        order = r.permutation(len(y))
        cal, tr = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
        self.mu, self.sd = x[tr].mean(0), x[tr].std(0) + 1e-3
        p = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v, t, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, None)
        for _ in range(epochs):
            tr = r.permutation(tr)
            for i in range(0, len(tr), batch):
                k = tr[i : i + batch]
                z = (x[k] - self.mu) / self.sd
                h = np.tanh(z @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[k]) / len(k)
                back = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                for j, g in enumerate((z.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - 3e-3 * m[j] / (1 - 0.9**t) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            self.w1, self.b1, self.w2, self.b2 = p[0], p[1], p[2], float(p[3][0])
            if (loss := self.loss(x[cal], y[cal], 1.0)) < best[0]:
                best = (loss, [a.copy() for a in p])
        self.w1, self.b1, self.w2 = best[1][:3]
        self.b2 = float(best[1][3][0])
        self.temperature = min(np.geomspace(0.25, 8, 41), key=lambda c: self.loss(x[cal], y[cal], c))
        return self

    def loss(self, x: np.ndarray, y: np.ndarray, temperature: float) -> float:
        z = self.logits(x) / temperature
        return float(np.mean(np.logaddexp(0, z) - y * z))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, held_out, score): the calibrated probability of label 1 for every row.

    A row is held out of training if crc32(key as text) mod 5 is 0, or the key is
    null. Null and empty texts have features of zero and a score like any other;
    repeated rows are scored alike. Without usable labels every score is the prior.
    """
    spark = docs.sparkSession
    prepare(spark)
    x = stash(features(docs, word_vectors(docs), key), "features")
    out = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))
    known = labels.select(F.col(key), F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & ~out).groupBy(key).agg(F.max("_y").alias("_y"))
    sample = x.join(known, key).orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key), "x").limit(train_rows).select("x", "_y").toPandas()
    xs = np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]).astype(np.float64) if len(sample) else np.zeros((0, FEATURES))
    net = Network().fit(xs, sample["_y"].to_numpy(np.float64))
    schema = T.StructType().add(key, docs.schema[key].dataType).add("score", "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(m))], names=schema.names)

    return x.mapInArrow(lean(apply), schema).select(key, out.alias("held_out"), "score")
