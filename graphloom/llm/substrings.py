"""Removal of long repeated byte strings by prefix-free parsing.

Triggers cut every text into phrases: the place with the least rolling hash among the
first ``reach`` places of a window is its trigger, so each window of ``length`` bytes has
one, chosen by the window's own bytes, and consecutive windows with one trigger form a
phrase. A phrase with the bytes that its windows reach is a context. The distinct
contexts are the dictionary, the sequence of contexts in a text is its parse.

In the order of all suffixes of the corpus, windows that are equal are neighbours. A
window that begins a bytes before its trigger is ordered by the a bytes of its phrase
that end there, and then by the parse, that is by the text from the trigger on:
  - contexts that occur twice repeat in every one of their windows;
  - of the others only those that share with another one the ``seed`` bytes that every
    window has behind its trigger can share a window. For them two suffix arrays are built,
    of the parse (contexts by the text from the trigger on) and of the dictionary (contexts
    by their phrase, read backwards from the trigger), with the lengths that neighbours
    have in common. Windows at distance a are equal if no neighbour on the way from one to
    the other has less than a bytes in common in the second array, nor less than
    ``length`` - a in the first.
Both arrays are built by ranges of seeds, many at a time. A seed with more than ``HOT``
contexts isn't gathered in a task: its windows fall into bands by their distance to the
trigger, all windows of a band hold the same long stretch, and those whose stretch another
context has too are matched by fingerprints. Bulk copies never leave the parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import textkit as tk
from graphloom.llm.common import discard, groups, join_split, lean, prepare, stash

LENGTH = 200
#: Contexts that share a seed and are ordered in one task, at most (about 350 bytes each).
HOT = 50_000
#: Contexts that are ordered at once.
BATCH = 20_000


def shape(length: int) -> tuple[int, int, int]:
    """(reach, seed, gram): places that a trigger is chosen from, bytes behind it that
    every window holds, and the width of the rolling hash."""
    reach = max(1, length * 16 // 25)
    seed = length - reach + 1
    return reach, seed, min(16, seed)


def band_width(length: int) -> int:
    return max(1, shape(length)[0] // 8)


def row_id(key: str) -> Column:
    """A row's name, 16 bytes of its key and text: equal rows are equal documents."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.to_json(F.struct(F.col(key).alias("k"))), F.col("text"))))


def phrases(data: np.ndarray, off: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Phrases of texts laid end to end: row, s0 (first window, in the text), n (windows),
    d (distance from the first window to the trigger), seed and context fingerprints."""
    reach, seed, gram = shape(length)
    count = np.maximum(np.diff(off) - length + 1, 0)
    total = int(count.sum())
    if not total:
        return {}
    pre = tk.prefix(data)
    at = np.arange(len(data) - gram + 1)
    low = (tk.span_hash(pre, at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    w = 1
    while 2 * w <= reach:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < reach:
        low = np.minimum(low[: len(low) - (reach - w)], low[reach - w :])
    row = np.repeat(np.arange(len(count)), count)
    s = off[row] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    t = (np.uint64(0xFFFFFFFF) - (low[s] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = t[1:] != t[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, total))
    s0, t, row = s[first], t[first], row[first]
    return {
        "row": row, "s0": (s0 - off[row]).astype(np.int32), "n": n.astype(np.int32), "d": (t - s0).astype(np.int32),
        "seed": tk.span_hash(pre, t, t + seed).view(np.int64), "ctx": tk.span_hash(pre, s0, s0 + n - 1 + length).view(np.int64),
    }


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.StructArray]]:
    """(bytes, structs) of rows (rid, text, structs); repeated rows, which are side by side, once."""
    last = None
    for b in batches:
        for rid, text, reps in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            if rid != last:
                last = rid
                yield np.frombuffer(text.as_buffer(), np.uint8), reps.values


def twice(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with a neighbour of the same keys, by one sort; nothing is counted or gathered."""
    w = Window.partitionBy(*keys).orderBy("ctx")
    near = df.withColumns({"_b": F.lag(F.lit(1)).over(w), "_a": F.lead(F.lit(1)).over(w)})
    return near.where("_b is not null or _a is not null").drop("_b", "_a")


def suffix_array(seed: np.ndarray, parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of at most ``width`` bytes by seed and then by their bytes, and for
    each place in it the length in common with the one before, -1 where a seed begins."""
    n = len(parts)
    size = np.array([len(x) for x in parts], np.int64)
    wide = -(-width // 8) * 8
    m = np.zeros((n, wide), np.uint8)
    row = np.repeat(np.arange(n), size)
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(parts) if n else np.zeros(0, np.uint8)
    words = m.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), seed))
    m, size, seed = m[order], size[order], seed[order]
    lcp = np.full(n, -1, np.int64)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), wide)
    lcp[1:] = np.where(seed[1:] == seed[:-1], np.minimum(first, np.minimum(size[1:], size[:-1])), -1)
    return order, lcp


def repeated(seed: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, a) of all windows that another context with the same seed has too: the window
    that begins a bytes before the trigger is the end of ``left`` and the begin of ``right``."""
    n = len(seed)
    most = np.array([len(x) for x in left])
    least = length - np.array([len(x) for x in right])
    by_parse, common = suffix_array(seed, right, length)
    by_phrase, ending = suffix_array(seed, [x[::-1] for x in left], int(most.max(initial=0)) or 1)
    out_c, out_a = [], []
    r, w = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        has = (least <= a) & (a <= most)
        if has.sum() < 2:
            continue
        r[by_parse] = np.cumsum(common < length - a)
        w[by_phrase] = np.cumsum(ending < a)
        at = np.flatnonzero(has)
        code = r[at] * (n + 1) + w[at]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[1:] = same
        hit[:-1] |= same
        got = at[order][hit]
        out_c.append(got)
        out_a.append(np.full(len(got), a, np.int16))
    return np.concatenate(out_c or [np.zeros(0, np.int64)]), np.concatenate(out_a or [np.zeros(0, np.int16)])


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Flags of the bytes in windows that begin at ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0


def by_seeds(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Whole seeds, at least ``least`` rows at a time, from batches sorted by seed."""
    held: list[pa.Table] = []
    for t in groups(batches, "seed"):
        held.append(t)
        if sum(x.num_rows for x in held) >= least:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def by_bands(contexts: DataFrame, length: int) -> DataFrame:
    """(seed, ctx, a) of windows that another context has too, over any number of contexts
    with one seed: bands, then single windows of the bands that are alive."""
    width = band_width(length)

    def cells(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, int]]:
        """(row, prefix sums, bytes before the trigger, least distance) of contexts."""
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            left, right = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            yield i, tk.prefix(np.concatenate([left, right])), len(left), max(length - len(right), 0)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, band, stretch = [], [], []
            for i, pre, d, least in cells(b):
                k = np.arange(least // width, d // width + 1)
                # windows of a band hold what the first and the last of them share
                s, e = d - k * width, d - k * width - width + 1 + length  # never outside of the context
                row.append(np.full(len(k), i))
                band.append(k)
                stretch.append(tk.span_hash(pre, s, e).view(np.int64))
            at = pa.array(np.concatenate(row or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(band or [np.zeros(0, np.int64)]).astype(np.int16)), pa.array(np.concatenate(stretch or [np.zeros(0, np.int64)]))], names=["seed", "ctx", "band", "stretch"])

    cut_up = stash(contexts.mapInArrow(lean(bands), "seed long, ctx long, band short, stretch long"), "bands")
    live = twice(cut_up, "seed", "band", "stretch").groupBy("seed", "ctx").agg(F.collect_set("band").alias("bands"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, dist, w = [], [], []
            for i, pre, d, least in cells(b):
                a = np.arange(least, d + 1)
                a = a[np.isin(a // width, np.array(b.column(4)[i].as_py()))]
                row.append(np.full(len(a), i))
                dist.append(a)
                w.append(tk.span_hash(pre, d - a, d - a + length).view(np.int64))
            at = pa.array(np.concatenate(row or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(dist or [np.zeros(0, np.int64)]).astype(np.int16)), pa.array(np.concatenate(w or [np.zeros(0, np.int64)]))], names=["seed", "ctx", "a", "w"])

    fine = stash(contexts.join(live.hint("merge"), ["seed", "ctx"]).select("seed", "ctx", "left", "right", "bands").mapInArrow(lean(windows), "seed long, ctx long, a short, w long"), "windows")
    discard(cut_up)
    return twice(fine, "seed", "w").select("seed", "ctx", "a")


def remove_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans, kept) for every row of ``docs``.

    ``spans`` are the maximal removed byte runs [start, end) of the UTF-8 text, ``kept``
    the other bytes: gone is each byte covered by a ``length``-byte string that begins
    anywhere else too, in the same text included, judged on the input. Null is empty;
    repeated rows remove each other's repeats; texts shorter than ``length`` stay whole.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", row_id(key))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.utf8(b.column(1))
            for i, j in tk.slices(off):
                if p := phrases(data[off[i] : off[j]], off[i : j + 1] - off[i], length):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + p["row"])), *(pa.array(p[k]) for k in ("s0", "n", "d", "seed", "ctx"))], names=["rid", "s0", "n", "d", "seed", "ctx"])

    occ = stash(named.select("rid", "text").mapInArrow(lean(parse), "rid binary, s0 int, n int, d int, seed long, ctx long"), "parse")
    shared = occ.groupBy("seed").agg(F.count("*").alias("c"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("c > 1")
    shared = stash(shared.select("seed", (F.col("lo") != F.col("hi")).alias("mixed"), "c"), "shared")
    active = stash(join_split(occ, shared, ["seed"], "c").drop("c"), "active")
    discard(occ)
    classes = stash(active.groupBy("seed", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("rid", "s0", "n", "d")).alias("at"), F.first("mixed").alias("mixed")), "dictionary")

    # of contexts that share a seed with others, one occurrence of each, with its bytes
    mixed = classes.where("mixed")
    hot = mixed.groupBy("seed").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("seed", F.lit(True).alias("hot"))
    reps = mixed.select(F.col("at.rid").alias("rid"), "at.s0", "at.n", "at.d", "seed", "ctx")
    each = reps.groupBy("rid").agg(F.collect_list(F.struct(*(c for c in reps.columns if c != "rid"))).alias("reps"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, reps in texts(batches):
            s0, n, d = (reps.field(i).to_numpy().astype(np.int64) for i in range(3))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [reps.field(3), reps.field(4), pa.array([raw[s : s + k] for s, k in zip(s0, d, strict=True)], pa.binary()), pa.array([raw[s + k : s + m - 1 + length] for s, k, m in zip(s0, d, n, strict=True)], pa.binary())],
                names=["seed", "ctx", "left", "right"],
            )

    spelled = stash(named.select("rid", "text").join(each.hint("merge"), "rid").mapInArrow(lean(spell), "seed long, ctx long, left binary, right binary"), "contexts")
    crowded = hot.limit(1).count() > 0
    calm = spelled.join(hot, "seed", "left").where("hot is null").drop("hot") if crowded else spelled

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_seeds(batches, BATCH):
            raw = [[np.frombuffer(x.as_buffer(), np.uint8) for x in t.column(c).combine_chunks()] for c in ("left", "right")]
            k, a = repeated(t.column("seed").to_numpy(), *raw, length)
            yield pa.RecordBatch.from_arrays([t.column("seed").combine_chunks().take(pa.array(k)), t.column("ctx").combine_chunks().take(pa.array(k)), pa.array(a)], names=["seed", "ctx", "a"])

    fine = calm.repartition("seed").sortWithinPartitions("seed").mapInArrow(lean(order), "seed long, ctx long, a short")
    if crowded:
        fine = fine.union(by_bands(spelled.join(hot.hint("merge"), "seed", "left_semi"), length))
    some = fine.groupBy("seed", "ctx").agg(F.collect_set("a").alias("a"))
    # a window's place in its context: the trigger's less a
    offsets = F.transform("a", lambda a: (F.col("at.d") - a).cast("short"))
    found = classes.join(some.hint("merge"), ["seed", "ctx"], "left").where("c > 1 or a is not null").select("seed", "ctx", "c", F.when(F.col("c") == 1, offsets).alias("a"))
    found = stash(found, "found")
    lose = join_split(active, found, ["seed", "ctx"], "c").groupBy("rid").agg(F.collect_list(F.struct("s0", "n", "a")).alias("lose"))
    lose = stash(lose, "removals")
    for done in (spelled, active, classes, shared, found):
        discard(done)
    schema = T.StructType().add(key, docs.schema[key].dataType).add("n_bytes", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, spans, kept = [], [], []
            for text, lose in zip(b.column(1), b.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                size.append(len(data))
                if not lose.is_valid:
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                v = lose.values
                s0, n, a = v.field(0).to_numpy().astype(np.int64), v.field(1).to_numpy().astype(np.int64), v.field(2)
                whole = a.is_null().to_numpy(zero_copy_only=False)
                k = np.repeat(s0[whole], n[whole])
                begin = [k + np.arange(len(k)) - np.repeat(np.cumsum(n[whole]) - n[whole], n[whole])]
                part = a.drop_null()
                begin.append(np.repeat(s0[~whole], part.value_lengths().to_numpy()) + part.flatten().to_numpy())
                gone = covered(len(data), np.concatenate(begin), length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=schema.names
            )

    return named.join(lose.hint("merge"), "rid", "left").select(key, "text", "lose").mapInArrow(lean(cut), schema)
