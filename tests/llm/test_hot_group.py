"""Recall of pairs near the threshold whose shared picks lie in hot buckets down to the last level."""

import numpy as np

from graphloom.llm import jaccard


def test_contained_pairs_in_hot_buckets_are_rarely_missed():
    rng, met, pairs = np.random.default_rng(3), 0, 4000
    for _ in range(pairs):
        big = np.sort(rng.integers(0, 1 << 64, 100, np.uint64, endpoint=False))
        small = big[rng.permutation(100) < 80]  # similarity 0.8
        # every bucket is split, so a run needs a shared pick at each level
        runs = set(range(jaccard.RUNS))
        for level in range(jaccard.DEPTH):
            a, b = jaccard.picks([big, small], level, jaccard.RUNS, 0.8).to_pylist()
            runs &= {t & 15 for t in set(a) & set(b)}
        met += bool(runs)
    assert met >= 0.998 * pairs


def test_hot_passage_is_split_and_no_link_is_lost(spark, monkeypatch):
    """Documents that share a passage and little else, and near copies among them."""
    from test_dedup import Counter, brute_links

    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for k in range(60):
        own = [f"w{k}x{i}" for i in range(30 + k % 7)]
        rows.append((k, " ".join(own[:10]) + " " + passage + " " + " ".join(own[10:])))
        if k % 6 == 0:
            rows.append((1000 + k, rows[-1][1] + " more"))
    monkeypatch.setattr(jaccard, "MASS", 300)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_links(rows)
