"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; equal sets are one class. In each run every set
picks a few of its tokens: those whose run-specific hash is below 1 / (threshold * size),
so that two sets of the wanted similarity share a pick more often than not, and
dissimilar ones hardly ever. Sets with a shared pick meet in a bucket, and the recursion
begins: a small bucket is brute-forced, by 64-byte sketches first, which only rule out
pairs far below the threshold; any other is split again by the next level's picks, of
which there are ``rate`` / threshold for a set, and its parts are treated alike. A split
multiplies the pairs that meet by about rate / threshold times their mean similarity, so
a dense bucket, where that is 1 or more (told by the sketches), is brute-forced, and so is
what is neither small nor dense after ``DEPTH`` levels. A passage shared by many sets puts
the same sets into a bucket for each of its picked tokens; of large buckets of one run with
the same sets, one goes on, as the others would only repeat its pairs and its parts.
``runs`` repetitions give the target recall: a pair at the threshold meets in one run with probability 1 - 1/e, and with
92 % of that at each further level, so twelve runs find 99.999 % of pairs in buckets that
are small or dense at once, and 99.97 % of those split down to the last level.

No bucket is capped, and pairs are never written out. Buckets that are brute-forced for
being dense or deep are joined into groups, compared in pairs of blocks, where every
pair meets exactly once; a pair that meets in several small buckets counts in the least
common one, which each side can tell from its own keys. Blocks and small buckets are
bounded by their number of sets and by their tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import textkit as tk
from graphloom.llm.common import components, discard, groups, lean, prepare, stash

RUNS = 12  # 16 at most
DEPTH = 4  # levels of picks
RATES = (1, 2.5, 2.5, 2.5)  # expected picks of a set in a run, times the threshold, by level
SMALL = 128  # sets of a brute-forced bucket, at most
MASS = 8_000_000  # tokens of a small bucket, or of a block on average, at most (64 MB)
BINS = 64  # bytes of a set's sketch
BLOCK = 384  # sets of a block of a group, on average
#: Keys of large buckets, or of documents, that are broadcast, at most (tens of MB); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Large buckets whose centers are sent to the workers, at most (150 bytes each); more are joined.
BROADCAST_CENTERS = 60_000

_rng = np.random.default_rng(20240229)
MULTIPLIERS = (_rng.integers(1, 1 << 63, (DEPTH, 16), np.uint64) << np.uint64(1)) | np.uint64(1)


def sets(col: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, in slices of the column."""
    data, off = tk.utf8(pc.utf8_lower(col))
    for i, j in tk.slices(off):
        w, woff, _ = tk.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h, soff = tk.shingles(w, woff, n)
        yield [np.unique(h[a:b]) for a, b in zip(soff, soff[1:], strict=False)]


def set_id(u: np.ndarray) -> bytes | None:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None


def picks(us: list[np.ndarray], level: int, runs: int, threshold: float) -> pa.ListArray:
    """Picked tokens of each set in every run at a level, the run in the low four bits."""
    size = np.array([len(u) for u in us], np.int64)
    flat = np.concatenate(us) if us else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(us)), size)
    share = np.minimum(RATES[level] / threshold / np.maximum(size, 1), 1.0) * 2.0**64
    limit = np.where(share >= 2.0**64, np.uint64((1 << 64) - 1), np.minimum(share, 2.0**63 * 1.999).astype(np.uint64))[of]
    got, rows = [], []
    for r in range(runs):
        by = MULTIPLIERS[level][r]
        hit = np.flatnonzero(flat * by <= limit)
        got.append((tk.mix(flat[hit] ^ by) & ~np.uint64(15)) | np.uint64(r))
        rows.append(of[hit])
    row, token = np.concatenate(rows), np.concatenate(got).view(np.int64)
    order = np.argsort(row, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(us)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(token[order]))


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def sketch(u: np.ndarray) -> bytes:
    """One byte of the least hash in each of ``BINS`` ranges; 0 where there is none."""
    if not len(u):
        return bytes(BINS)
    at = np.minimum(np.searchsorted(u, _EDGES), len(u) - 1)
    got = u[at]
    has = (got >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64)
    return np.where(has, 1 + tk.mix(got) % np.uint64(255), 0).astype(np.uint8).tobytes()


def likely(sketches: np.ndarray, threshold: float) -> np.ndarray:
    """Rows with a partner whose sketch doesn't rule out the threshold: five standard
    deviations below it are let through, so a link is lost with probability 3e-7."""
    some = sketches > 0
    same = ((sketches[:, None] == sketches[None]) & some[:, None]).sum(2)
    both = (some[:, None] | some[None]).sum(2)
    ok = same >= threshold * both - 5 * np.sqrt(threshold * (1 - threshold) * both)
    np.fill_diagonal(ok, False)
    return np.flatnonzero(ok.any(1))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of sets, row by row, as their sketches tell."""
    both = ((a > 0) | (b > 0)).sum(1)
    return ((a == b) & (a > 0)).sum(1) / np.maximum(both, 1)


def overlap(members: list[np.ndarray]) -> np.ndarray:
    """Pairwise intersection sizes."""
    m = len(members)
    out = np.zeros((m, m), np.float32)
    if m <= 4:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(members[i], members[j], assume_unique=True))
        return out
    size = np.array([len(x) for x in members])
    row = np.repeat(np.arange(m), size)
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    col, row = (np.cumsum(shared) - 1)[col[keep]], row[keep]
    step = 4096
    for c in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(col, [c, c + step])
        x = np.zeros((m, step), np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        out += x @ x.T
    return out


def roots(link: np.ndarray) -> np.ndarray:
    """The least index of each index's component in a symmetric boolean matrix."""
    label = np.arange(len(link))
    big = len(link)
    while True:
        near = np.where(link, label[None, :], big).min(1, initial=big)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare(t: pa.Table, threshold: float) -> tuple[list[int], list[int], np.ndarray]:
    """Of one bucket or pair of blocks: rows with links, their roots' rows, their link counts."""
    members = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens").combine_chunks()]
    size = np.array([len(x) for x in members], np.float64)
    inter = overlap(members).astype(np.float64)
    link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(link, False)
    side = t.column("side").to_numpy()
    count = link.copy()
    if side[0] >= 0:  # of a group: two blocks, one of which may be empty, only across; or one block
        if side[0] < 2:
            link &= side[:, None] != side[None, :]
        count = link
    else:
        unit = t.column("unit")[0].as_py()
        dense = t.column("dense").fill_null(0).to_numpy()
        count &= ~((dense[:, None] == dense[None, :]) & (dense[:, None] != 0))
        keys = t.column("keys").combine_chunks()
        lens = keys.value_lengths().to_numpy()
        rows, flat = np.repeat(np.arange(len(lens)), lens), keys.flatten().to_numpy()
        less = flat < unit
        if less.any():
            uniq, col = np.unique(flat[less], return_inverse=True)
            a = np.zeros((len(lens), len(uniq)), np.float32)
            a[rows[less], col] = 1
            count &= (a @ a.T) == 0
    copies = t.column("copies").to_numpy()
    some = np.flatnonzero(link.any(1))
    return some.tolist(), roots(link)[some].tolist(), (count.astype(np.int64) @ copies)[some]


def unlike(met: DataFrame) -> DataFrame:
    """Keys of ``met`` (sid, k), one for all buckets of a run with the same sets: these hold the
    same pairs, and their parts would be the same at every further level."""
    names = met.groupBy("k").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("m2"))
    return names.groupBy(F.col("k").bitwiseAND(F.lit(15).cast("long")).alias("run"), "c", "m1", "m2").agg(F.min("k").alias("k")).select("k")


def jaccard_links(docs: DataFrame, key: str = "doc_id", n: int = 5, threshold: float = 0.8, runs: int = RUNS) -> DataFrame:
    """(key, class_id, n_links) for every row of ``docs``.

    class_id is the smallest key reachable by links; n_links counts the other rows linked
    directly, copies included. Texts without a word link with nothing: their class is
    their own key. Texts with fewer than ``n`` words are one shingle. Null keys take part;
    a class of them alone has a null class_id. Repeated rows are copies of one another.
    """
    spark = docs.sparkSession
    prepare(spark)
    # comparing costs more than moving: no coalescing by bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType().add(key, docs.schema[key].dataType).add("sid", "binary").add("size", "long").add("picks", T.ArrayType(T.LongType())).add("sketch", "binary")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for us in sets(b.column(1), n):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(us)), pa.array([set_id(u) for u in us], pa.binary()), pa.array([len(u) for u in us], pa.int64()), picks(us, 0, runs, threshold), pa.array([sketch(u) for u in us], pa.binary())],
                    names=schema.names,
                )
                at += len(us)

    rows = stash(docs.select(key, "text").mapInArrow(lean(choose), schema), "picks")
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("picks").alias("picks"), F.first("sketch").alias("sketch"))
    classes = stash(classes, "classes")

    def texts_of(some: DataFrame) -> DataFrame:
        """Texts of the classes' representatives, and of what has their keys."""
        reps = some.select(F.col("rep").alias("_r")).distinct()
        reps = F.broadcast(reps) if some.count() <= BROADCAST_KEYS else reps.hint("merge")
        return docs.select(F.col(key).alias("_k"), "text").join(reps, F.col("_k").eqNullSafe(F.col("_r")), "left_semi").select("text")

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for us in sets(b.column(0), n):
                us = [u for u in us if len(u)]
                levels = [picks(us, k, runs, threshold) for k in range(1, DEPTH)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(u) for u in us], pa.binary()), *levels], names=["sid", *(f"p{k}" for k in range(1, DEPTH))])

    def bytes_of(col: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BINS)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, one, two = (bytes_of(b.column(i)) for i in (3, 4, 5))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(estimate(own, one)), pa.array(estimate(own, two))], names=["sid", "k", "center", "one", "two"])

    def against(centers) -> object:
        """The same, with the centers at hand."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ks, center, one, two = centers.value
            for b in batches:
                at = np.searchsorted(ks, b.column(1).to_numpy())
                own = bytes_of(b.column(2))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([center[i] for i in at], pa.binary()), pa.array(estimate(own, one[at])), pa.array(estimate(own, two[at]))], names=["sid", "k", "center", "one", "two"])

        return run

    paths, leaves, stars, deep = classes.select("sid", "size", F.explode("picks").alias("k")), [], [], None
    for level in range(DEPTH):
        sizes = stash(paths.groupBy("k").agg(F.count("*").alias("c"), F.sum("size").alias("mass")).where("c > 1"), "sizes")
        crowded = (F.col("c") > SMALL) | (F.col("mass") > MASS)
        large = sizes.where(crowded).select("k")
        many = large.count()
        held = F.broadcast(large) if many <= BROADCAST_KEYS else large
        # rows of large buckets never meet in a task by their key
        leaves.append(stash(paths.join(held, "k", "left_anti").join(sizes.where(~crowded).select("k").hint("merge"), "k", "left_semi").select("sid", "k"), "small"))
        if not many:
            break
        every = stash(paths.join(held, "k").select("sid", "size", "k"), "large")
        single = stash(unlike(every), "unlike")
        big = every.join(F.broadcast(single) if many <= BROADCAST_KEYS else single, "k", "left_semi")
        drawn = big.join(classes.select("sid", "sketch").hint("merge"), "sid")
        centers = drawn.groupBy("k").agg(F.min(F.struct("sid", "sketch")).alias("x"), F.max(F.struct("sid", "sketch")).alias("y"))
        centers = centers.select("k", F.col("x.sid").alias("center"), F.col("x.sketch").alias("s1"), F.col("y.sketch").alias("s2"))
        centers = stash(centers, "centers")
        kind = "sid binary, k long, center binary, one double, two double"
        if many <= BROADCAST_CENTERS:
            got = sorted(centers.collect(), key=lambda r: r[0])
            sketches = [np.frombuffer(b"".join(r[i] for r in got), np.uint8).reshape(-1, BINS) for i in (2, 3)]
            held_centers = spark.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), [bytes(r[1]) for r in got], *sketches))
            seen = drawn.select("sid", "k", "sketch").mapInArrow(lean(against(held_centers)), kind)
        else:
            seen = drawn.join(centers, "k").select("sid", "k", "center", "sketch", "s1", "s2").mapInArrow(lean(compared), kind)
        seen = stash(seen, "compared")
        dense = seen.groupBy("k").agg(F.greatest(F.avg("one"), F.avg("two")).alias("mean"))
        dense = stash(dense.where(F.col("mean") >= (threshold / RATES[level + 1] if level < DEPTH - 1 else -1.0)).select("k"), "dense")
        dense = F.broadcast(dense) if many <= BROADCAST_KEYS else dense
        stars.append(stash(seen.join(dense, "k", "left_semi").select(F.col("sid").alias("a"), F.col("center").alias("b")), "stars"))
        rest = big.join(dense, "k", "left_anti")
        if level == DEPTH - 1 or rest.isEmpty():
            break
        if deep is None:  # of sets that are split at all; the parts hold no others
            some = stash(classes.select("sid", "rep").join(rest.select("sid").distinct(), "sid", "left_semi"), "split")
            kinds = "sid binary, " + ", ".join(f"p{k} array<long>" for k in range(1, DEPTH))
            deep = stash(texts_of(some).mapInArrow(lean(deeper), kinds).dropDuplicates(["sid"]), "deeper")
        run = F.lit(15).cast("long")
        each = rest.groupBy("sid", "size").agg(F.collect_list("k").alias("ks")).join(deep.select("sid", F.col(f"p{level + 1}").alias("p")).hint("merge"), "sid")
        child = F.flatten(F.transform("ks", lambda k: F.transform(F.filter("p", lambda p: p.bitwiseAND(run) == k.bitwiseAND(run)), lambda p: F.xxhash64(k, p).bitwiseAND(F.lit(-16).cast("long")).bitwiseOR(k.bitwiseAND(run)))))
        paths = stash(each.select("sid", "size", F.explode(child).alias("k")), "paths")
        for done in (sizes, every, single, seen, centers):
            discard(done)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k"):
            if t.num_rows > 1:
                raw = b"".join(t.column("sketch").to_pylist())
                at = pa.array(likely(np.frombuffer(raw, np.uint8).reshape(-1, BINS), threshold))
                yield pa.RecordBatch.from_arrays([t.column("sid").combine_chunks().take(at), t.column("k").combine_chunks().take(at)], names=["sid", "k"])

    met = leaves[0]
    for more in leaves[1:]:
        met = met.union(more)
    sketched = met.join(classes.select("sid", "sketch").hint("merge"), "sid")
    leaves = stash(sketched.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(lean(sift), "sid binary, k long"), "leaves")

    star = spark.createDataFrame([], "a binary, b binary")
    for more in stars:
        star = star.union(more)
    comp = components(star, "dense").select(F.col("node").alias("sid"), F.xxhash64("component").alias("dense")).join(classes.select("sid", "size").hint("merge"), "sid")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / MASS)).cast("int")
    dense = stash(comp.join(comp.groupBy("dense").agg(blocks.alias("blocks")), "dense").drop("size"), "groups")

    known = leaves.groupBy("sid").agg(F.array_sort(F.collect_set("k")).alias("keys")).join(dense.select("sid", "dense"), "sid", "full")
    info = stash(known.join(classes.select("sid", "rep", "copies").hint("merge"), "sid"), "info")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for us in sets(b.column(0), n):
                us = [u for u in us if len(u)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(u) for u in us], pa.binary()), pa.array([u.tobytes() for u in us], pa.binary())], names=["sid", "tokens"])

    tokens = texts_of(info).mapInArrow(lean(whole), "sid binary, tokens binary")
    full = stash(info.join(tokens.dropDuplicates(["sid"]).hint("merge"), "sid"), "sets")

    block = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    paired = dense.select("sid", "dense", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("sid", F.xxhash64("dense", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    units = leaves.select("sid", F.col("k").alias("unit"), F.lit(-1).alias("side")).union(paired)
    work = units.join(full.hint("merge"), "sid").select("unit", "side", "sid", "keys", "dense", "copies", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            if t.num_rows > 1:
                at, root, links = compare(t, threshold)
                sid = t.column("sid").combine_chunks()
                yield pa.RecordBatch.from_arrays([sid.take(pa.array(at, pa.int64())), sid.take(pa.array(root, pa.int64())), pa.array(links, pa.int64())], names=["a", "b", "links"])

    found = stash(work.repartition(parts, "unit").sortWithinPartitions("unit", "side").mapInArrow(lean(verify), "a binary, b binary, links long"), "links")
    linked = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    graph = components(found.select("a", "b"), "classes")
    named = classes.join(graph.withColumnRenamed("node", "sid"), "sid", "left").join(linked, "sid", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left").select("sid", F.coalesce("least", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select(key, "sid").join(named, "sid", "left").select(
        key, F.when(F.col("sid").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that remain if one document of each near-duplicate group stays:
    the one with the smallest key. Rows without a word, and rows with a null key, stay;
    of repeated rows with one key and text, one stays. Rows with one key and different
    texts are different documents."""
    row = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    named = docs.withColumn("_id", row)
    links = jaccard_links(named.select("_id", "text"), "_id", n, threshold)
    gone = stash(links.where(F.col("_id") > F.col("class_id")).select(F.col("_id").alias("_gone")).distinct(), "gone")
    kept = named.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    twice = kept.where("_id is not null").groupBy("_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    kept = kept.where("_id is null").unionByName(kept.where("_id is not null").dropDuplicates(["_id"])) if twice else kept
    return kept.drop("_id")
