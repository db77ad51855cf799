"""Rows that share a key and not their text."""

from graphloom.llm import jaccard


def test_one_key_with_different_texts_keeps_both(spark):
    a, b, c = ("one two three four five six seven", "wholly other words that nothing else here holds", "something new again for the last of these rows")
    rows = [(1, a), (2, b), (2, c), (2, c), (3, a), (None, b)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # (2, b) is no copy of (2, c); (3, a) is a copy of (1, a); a null key stays
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, [(1, a), (2, b), (2, c), (None, b)]))
