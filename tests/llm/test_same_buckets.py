"""Buckets of one run that hold the same sets: a shared passage makes one for each of its picked tokens."""

from collections import defaultdict

from test_dedup import Counter, brute_links

from graphloom.llm import jaccard


def passage_rows(m):
    """Documents of one length that share a passage and little else, and near copies of some."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for k in range(m):
        own = [f"w{k}x{i}" for i in range(34)]
        rows.append((k, " ".join(own[:10]) + " " + passage + " " + " ".join(own[10:])))
        if k % 8 == 0:
            rows.append((1000 + k, rows[-1][1].replace(own[-1], "other")))
    return rows


def test_same_buckets_go_on_once_and_rows_grow_with_the_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    went_on, split, stash = [], [], jaccard.stash

    def watch(df, tag):
        out = stash(df, tag)
        if tag == "compared":
            members = defaultdict(set)
            for r in out.select("k", "sid").collect():
                members[r.k].add(bytes(r.sid))
            went_on.extend((len(split), k & 15, frozenset(x)) for k, x in members.items())
        if tag == "paths":
            split.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stash", watch)
    made = []
    for m in (40, 80):
        rows = passage_rows(m)
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute_links(rows)
        assert went_on and len(set(went_on)) == len(went_on)  # by level, run and sets
        made.append(sum(split))
        went_on.clear()
        split.clear()
    assert 0 < made[1] <= 2.5 * made[0]  # in proportion to the group, not with its square
