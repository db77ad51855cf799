import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import common, jaccard, linededup, substrings


def tokens(t):
    import re

    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def shingle_set(t, n=5):
    w = tokens(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_links(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[a] = b
    out = []
    for i, (k, _) in enumerate(rows):
        root = lambda x: x if parent[x] == x else root(parent[x])
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((k, min(ids) if ids else None, n[i]))
    return Counter(out)


def test_jaccard_edge_cases(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_links(docs).collect())
    assert got == brute_links(rows)
    assert jaccard.jaccard_links(none).count() == 0


def test_jaccard_large_group_goes_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(30)] + [(100 + k, " ".join(f"z{k}q{i}" for i in range(60))) for k in range(10)] + [(200, " ".join(base))] * 3
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_links(rows)


def test_jaccard_groups_of_long_sets_have_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MASS", 60)  # a block for each set, on average
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in (5, 95, 100)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_links(rows)


def test_keep_one(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(x) for x in [0, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, None])


def brute_lines(rows, least=20, copies=3):
    where = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            y = linededup.line_key(x)
            if len(y) >= least and k is not None:
                where[y].add(k)
    out = []
    for k, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (k is not None and len(linededup.line_key(x)) >= least and len(where[linededup.line_key(x)]) >= copies and k < max(where[linededup.line_key(x)]))]
        out.append((k, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("heavy", [1, 5000])
def test_lines(docs, none, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = linededup.dedup_lines(docs, log_bits=10)
    assert got.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in got.collect()) == brute_lines(rows)
    assert sum(x[2] for x in brute_lines(rows)) == 2
    assert linededup.dedup_lines(none).count() == 0


def test_line_key_strips_and_folds_only_ascii():
    assert linededup.line_key("\x0b ÀB c \r") == "Àb c"


def brute_cut(rows, length):
    seen = Counter()
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, t in raw:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] += 1
    out = []
    for k, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((k, len(t), sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


def check_cut(df, length):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = substrings.remove_repeats(df, length=length).collect()
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_cut(rows, length)


@pytest.fixture(params=["arrays", "bands", "small batches", "heavy keys"])
def way(request, monkeypatch):
    """Contexts ordered by suffix arrays, or by bands as where a seed has too many."""
    if request.param == "bands":
        monkeypatch.setattr(substrings, "HOT", 1)
    if request.param == "heavy keys":
        monkeypatch.setattr(common, "HEAVY", 2)
    if request.param == "small batches":
        monkeypatch.setattr(substrings, "BATCH", 3)
    return request.param


def test_substrings_edge_cases(docs, none):
    check_cut(docs, 200)
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_short_length_many_overlaps(spark, way):
    import random

    r = random.Random(5)
    rows = [(k, "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for k in range(40)] + [(99, "é" * 30), (98, "abc" * 20), (97, "a\0\0b" * 9), (97, "\0" * 25)]
    check_cut(spark.createDataFrame(rows, "doc_id long, text string"), 12)


def test_substrings_around_a_shared_passage(spark, way):
    """A passage between words of each text's own, so that contexts share only parts."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(90)
    rows = []
    for k in range(30):
        s = r.randint(0, 200)
        rows.append((k, own(r.randint(0, 40)) + " " + passage[s : s + r.randint(150, 420)] + " " + own(r.randint(0, 40))))
    check_cut(spark.createDataFrame(rows, "doc_id long, text string"), 200)


def test_suffix_arrays_equal_plain_ones():
    import random

    r = random.Random(3)
    for _ in range(60):
        n, width = r.randint(1, 30), r.randint(1, 20)
        parts = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, width))) for _ in range(n)]
        seed = np.array([r.randint(0, 2) for _ in range(n)], np.int64)
        order, lcp = substrings.suffix_array(seed, [np.frombuffer(p, np.uint8) for p in parts], width)
        assert [(seed[i], parts[i]) for i in order] == sorted((seed[i], parts[i]) for i in range(n))
        for k in range(n):
            i, j = order[k], order[k - 1]
            same = next((x for x in range(min(len(parts[i]), len(parts[j]))) if parts[i][x] != parts[j][x]), min(len(parts[i]), len(parts[j])))
            assert lcp[k] == (-1 if k == 0 or seed[i] != seed[j] else same)
