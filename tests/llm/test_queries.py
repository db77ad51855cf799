"""The registered queries on small tables: against their SQL, or against plain Python."""

import hashlib
import json
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from test_dedup import brute_cut, brute_lines, brute_links
from test_models import brute_coverage

import corpus_pipeline as cp
from graphloom.llm import pii, queries, secrets

NAMES = ("op1_jaccard_join", "op2_near_vectors", "op5_chat_format", "op7_line_dedup", "op9_substrings")


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    """A folder of tables: documents without a null or repeated id, as SQL has to give the same."""
    d = str(tmp_path_factory.mktemp("sf"))
    more = [
        (20, "call +1 (555) 010-9999 or 4111 1111 1111 1111, not 4111 1111 1111 1112"), (21, "hosts 10.0.0.1.2.3.4 and 256.1.1.1, 0000.1.1.255 mail a@b.c.d,x@y"), (22, "é 😀 x.y+z@mail-1.example.org +44 20 7946 0958; 12345678901234567890"),
        (23, "commit 3f786850e387550fdab836ed7e6dc881de23001b\ntoken: ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4\nx = 'correct horse'"),
    ]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in [*texts, *more]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 16))
    v[1:6] = v[0] + 0.02 * rng.normal(size=(5, 16))
    vectors = [(k, x.astype(np.float32).tolist(), k % 3) for k, x in enumerate(v)] + [(90, None, 0), (91, [0.0] * 16, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    talk = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "[INST] yo\n"), (2, 0, "system", None), (2, 1, "assistant", ""), (3, 0, "assistant", "é <\\s> 😀")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 24)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, " ".join(texts[3][1].split()[10:30])), (2, "no such words"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r[k] for k in cols) for r in got.collect()) == Counter(want.fetchall())


def test_links_and_lines_and_cuts_equal_brute_force(spark, sf, documents):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in queries.op1_jaccard_join(spark, sf).collect())
    assert got == brute_links(documents)
    want = {(k, n, gone, hashlib.sha256(t.encode()).hexdigest()) for k, n, gone, t in brute_lines(documents)}
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op7_line_dedup(spark, sf).collect()} == want
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op9_substrings(spark, sf).collect()) == brute_cut(documents, 200)


def test_personal_data_equals_the_plain_patterns(spark, sf, documents):
    def luhn(d):
        s = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(s)) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    want, got, some = {}, {}, Counter()
    for k, t in documents:
        found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, t or "") if ok(m[0])]
        base = ",".join(x for *_, x in sorted(found))
        n = Counter(x.split(":")[0] for *_, x in found)
        some.update(n)
        want[k] = (*(n[kind] for kind in rules), hashlib.sha256(base.encode()).hexdigest())
        got[k] = set(base.split(",")) - {""}
    assert all(some[kind] > 1 for kind in rules if kind != "card")
    rows = queries.op3_pii(spark, sf).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows} == want
    for r in rows:  # the field adds spans, the base's stay, all in order
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert got[r.doc_id] <= {":".join(x) for x in spans}
        assert spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0])))


def plain_features(c, before, after):
    """The features of a candidate, by another engine of patterns."""
    flags = regex.ASCII
    n = len(c)
    has = lambda p, s: float(regex.search(p, s, flags) is not None)
    count = lambda p, s=c: len(regex.findall(p, s, flags))
    low, value = c.lower(), regex.sub("^[A-Za-z_-]{2,}[=:]+", "", c, flags=flags)
    m = regex.search(r"([^\s=:\"']*)[\s=:\"']*$", before, flags)
    last = m[1] if m else ""
    own = regex.search("^([A-Za-z_-]{2,})=", c, flags)
    words = "|".join(sorted(secrets.DICTIONARY, key=lambda w: (-len(w), w)))
    return {
        "length": n, "value_length": len(value), "digits": count("[0-9]") / n, "upper": count("[A-Z]") / n, "lower": count("[a-z]") / n, "vowels": count("(?i)[aeiou]") / n,
        "punctuation": count("[_+/=.-]") / n, "kind_changes": count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "consonant_runs": count("[bcdfghjklmnpqrstvwxz]{4,}", low), "distinct": len(set(value)) / max(len(value), 1), "repeats": count(r"(.)\1") / n,
        "hex": has("^[0-9a-f]{12,}$", value), "all_digits": has("^[0-9.+/=-]+$", value), "key_prefix": has("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|glpat-)", value),
        "coverage": 1 - len(regex.sub(words, "", low)) / n, "path": max(has("[A-Za-z0-9]/[A-Za-z0-9]", c), has("[/\\\\]$|://\\S*$", before)), "dotted": count("[.]"),
        "uuid": has("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", c), "cue_inside": has(secrets.CUES, c), "cue_before": has(secrets.CUES, last), "cue_near": has(secrets.CUES + r"[^\n]{0,24}$", before),
        "harmless_before": max(has(secrets.HARMLESS, last), has(secrets.HARMLESS + r"\W{1,4}$", before)), "assigned": max(has("[=:]\\s*[\"']?$", before), has("^[A-Za-z_]+=", c)), "quoted": has("[\"']$", before),
        "private_key": float(c.startswith("-----BEGIN")), "symbols": count(r"[^A-Za-z0-9_+/=.\s-]") / n, "spaces": count("\\s") / n,
        "strong_cue": has("(?i)(passw(or)?d|passwd|pwd|secret|token|key|credential)$", last + (own[1] if own else "")),
        "placeholder": has("(?i)^([<$%{*]|your|change|example|none$|null$|true$|false$|required|optional|string|x+$|self[.]|os[.]|get|input|env)|[(]", value), "at_after": has("^@", after), "sentence_after": has("^\\s+[a-z]", after),
    }


def test_secrets_equal_plain_python(spark, sf, documents):
    trees, names, want = secrets.forest(spark), list(secrets.features()), set()
    for k, t in documents:
        found = list(regex.finditer(secrets.CANDIDATE, t or "", regex.ASCII))
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(t or "")]
        for i, m in enumerate(found):
            f = plain_features(m[0], t[ends[i] : m.start()][-secrets.CONTEXT :], t[m.end() : starts[i + 1]][: secrets.CONTEXT])
            score = sum(secrets.vote(tree, [f[n] for n in names]) for tree in trees) / len(trees)
            if round(score, 6) >= 0.5:
                want.add((k, m.start(), m.end(), m[0], round(score, 6)))
    assert len(want) >= 3
    assert {(r.doc_id, r.start, r.end, r.secret, r.score) for r in queries.op4_secrets(spark, sf).collect()} == want


def test_scores_never_see_held_out_labels(spark, sf, tmp_path):
    import shutil

    one = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op6_quality(spark, sf).collect()}
    other = str(tmp_path / "sf")
    shutil.copytree(sf, other)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flip = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "1 - toxic as toxic")
    assert flip.exceptAll(labels.select("doc_id", "quality", "toxic")).count() > 0
    shutil.rmtree(f"{other}/labels.parquet")
    flip.write.parquet(f"{other}/labels.parquet")
    two = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op6_quality(spark, other).collect()}
    assert one == two
    for k, (held, score, predicted) in one.items():
        assert held == (zlib.crc32(str(k).encode()) % 5 == 0) and predicted == int(score >= 0.3)


def test_decontamination_equals_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [(k, t) for k, t in documents if k != 9]
    got = sorted([(r.doc_id, round(r.coverage, 9), r.item_id, r.n_items) for r in queries.op8_decontamination(spark, sf).collect() if r.doc_id != 9], key=str)
    assert got == brute_coverage(short, items)


def check_pieces(pieces, texts):
    """Every id of every text lies in one piece; sequences are gapless."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    ids = {k: coder.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts}
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert [s * 2048 + o for s, o, _ in at] == [0, *np.cumsum([n for *_, n in at]).tolist()][:-1]
    assert all(o + n <= 2048 for _, o, n in at)
    seen = {k: [] for k in ids}
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.doc_tokens == len(ids[p.doc_id]) and p.start == sum(seen[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id].append(p.length)
    assert {k: sum(v) for k, v in seen.items()} == {k: len(v) for k, v in ids.items()}


def test_packing_covers_every_token(spark, sf, documents):
    check_pieces(queries.op10_packing(spark, sf).collect(), documents)


def test_pipeline_equals_the_chain_in_plain_python(spark, sf, documents):
    """Each stage by brute force on what its predecessor has to keep; the scores are the classifier's own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in queries.op6_quality(spark, sf).collect()}
    kept = [(k, t) for k, t in documents if scores[k] >= cp.LEAST_QUALITY]
    got = cp.quality_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k, _ in kept)
    kept = [(k, t) for k, _, _, t in brute_lines(kept)]
    got = cp.line_stage(spark, got, sf)
    assert {(r.doc_id, r.text or "", r.n_chars) for r in got.collect()} == {(k, t, len(t)) for k, t in kept}
    classes = {k: c for k, c, _ in brute_links(kept)}
    kept = [(k, t) for k, t in kept if classes[k] == k]
    got = cp.near_stage(spark, got, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k, _ in kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    coverage = {k: n for k, _, _, n in brute_coverage(kept, items)}
    kept = [(k, t) for k, t in kept if not coverage[k]]
    got = cp.benchmark_stage(spark, got, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k, _ in kept)
    pieces = cp.run(spark, sf).collect()
    check_pieces(pieces, kept)
    assert json.dumps(sorted(map(tuple, cp.packing_stage(spark, got, sf).collect()))) == json.dumps(sorted(map(tuple, pieces)))
