import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bpe, chat, packing
from graphloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(reference):
    import random

    r = random.Random(2)
    parts = ["a", "B", "don't", "'s", "'S", "'re", " ", "  ", "\n", "\t", "é", "ñ", "١", "½", "!", "'", "''", "日本", "😀", "x1", "'tis", "\r\n", " '", " ", "\x1c", "́", "<|endoftext|>"]
    col = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", None]
    coder = bpe.Bpe(tokenizer_path())
    for part in (col[:1500], [x for x in col[1500:] if x is None or "<|" not in x]):
        ids, off = coder.encode(pa.array(part, pa.string()))
        for i, x in enumerate(part):
            assert ids[off[i] : off[i + 1]].tolist() == reference.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_bpe_memory_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder = bpe.Bpe(tokenizer_path())
    for x in ("one two three four", "five six seven", "one two nine"):
        assert coder.encode(pa.array([x]))[0].tolist() == reference.encode(x).ids


def round_robin(queues, quantum, deficit):
    """Deficit round-robin over tokens, one after the other: (source, place in its queue)."""
    out, at, deficit, passed = [], Counter(), dict(deficit), 0
    live = {s for s in queues if quantum[s] > 0}
    while any(at[s] < queues[s] for s in live):
        for s in sorted(live):
            deficit[s] += quantum[s]
            while at[s] < queues[s] and deficit[s] >= 1 - 1e-9:
                deficit[s] -= 1
                out.append((s, at[s]))
                at[s] += 1
        passed += 1
    return out + [(s, x) for s in sorted(set(queues) - live) for x in range(queues[s])]


def test_packing(docs, none, reference):
    pieces = packing.pack(docs, tokenizer_path(), window=64, with_ids=True).collect()
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    place = [s * 64 + o for s, o, _ in at]
    assert place == np.concatenate([[0], np.cumsum([n for *_, n in at])])[:-1].tolist()  # gapless, only the last is short
    assert all(o + n <= 64 for _, o, n in at)
    want = {r.doc_id: reference.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    copies, seen = Counter(r.doc_id for r in docs.collect()), {k: [0] * len(ids) for k, ids in want.items()}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
        assert p.ids == want[p.doc_id][p.start : p.start + p.length] and p.length == len(p.ids) > 0
        for i in range(p.start, p.start + p.length):
            seen[p.doc_id][i] += 1
    assert all(set(n) == {copies[k]} for k, n in seen.items())  # each id in exactly one piece
    assert packing.pack(none, tokenizer_path()).count() == 0


def served(spark, rows, window, weights):
    """(source, place in its queue) of every token of the stream, and its round."""
    df = spark.createDataFrame([(k, k, s, n) for k, s, n in rows], "row long, doc_id long, source string, n long")
    place, at = {}, Counter()
    for k, s, n in sorted(rows, key=lambda x: (x[1], x[0])):
        place[k] = (s, at[s])
        at[s] += n
    stream = {}
    for p in packing.served_pieces(df, window=window, weights=weights).collect():
        s, x = place[p.row]
        for i in range(p.n):
            assert p.at + i not in stream
            stream[p.at + i] = (s, x + p.begin + i)
    assert sorted(stream) == list(range(sum(n for *_, n in rows)))
    return [stream[i] for i in range(len(stream))], at


def first_deficit(spark, names):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s,) for s in names], "source string")
    return {r[0]: r[1] / (1 << 20) for r in df.select("source", F.pmod(F.xxhash64("source"), F.lit(1 << 20))).collect()}


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.998, "b": 0.002}, {"a": 0.0}])
def test_service_order_is_deficit_round_robin(spark, weights):
    import random

    r = random.Random(4)
    rows = [(k, "abc"[min(2, r.randrange(6))], r.randint(1, 900)) for k in range(60)]
    got, sizes = served(spark, rows, 128, weights)
    total = sum(weights.values()) or 1 if weights else sum(sizes.values())
    quantum = {s: 128 * (weights.get(s, 0) if weights else sizes[s]) / total for s in sizes}
    assert got == round_robin(sizes, quantum, first_deficit(spark, sizes))


def test_every_window_holds_the_target_mixture(spark):
    import random

    r = random.Random(8)
    rows = [(k, f"s{min(11, int(r.expovariate(0.3)))}", r.choice([1, 5, 40, 300, 6000])) for k in range(300)]
    got, sizes = served(spark, rows, 512, None)
    total, widest = sum(sizes.values()), 0
    for w in range(total // 512):
        here = Counter(s for s, _ in got[w * 512 : (w + 1) * 512])
        widest = max(widest, sum(abs(here[s] - 512 * sizes[s] / total) for s in sizes) / 2 / 512)
    # a token of rounding for each of the twelve queues at most
    assert widest <= 12 / 512


def test_template_language():
    f = chat.compile_template("{% set who = 'you' %}{% for m in messages %}{% if loop.first %}<{% elif m.role == 'a' and not loop.last %}|{% else %}>{% endif %}{{ loop.index ~ m['text'] | upper }}{% generation %}{{ m.x | string }}{% endgeneration %}{% endfor %}{{ who + '!' }}")
    got = list(f(iter([{"role": "a", "text": "x", "x": 1}, {"role": "a", "text": "y"}, {"role": "b", "text": "z"}])))
    assert "".join(t for t, _ in got) == "<1X1|2YNone>3ZNoneyou!"
    assert [t for t, g in got if g] == ["1", "None", "None"]


def test_template_folds_constants():
    nodes = chat.fold_block(chat.Parser("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ x }}").block(())[0])
    assert nodes == [("text", "ab1c"), ("out", ("name", "x"))]


@pytest.mark.parametrize("bad", ["{{ x.__class__() }}", "{% for %}", "{% if x %}", "{{ x | eval }}", "{{ 1 + }}", "{% exec x %}"])
def test_template_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_template_has_no_attributes():
    with pytest.raises(chat.TemplateError):
        list(chat.compile_template("{{ x.real }}")([], x=3))


def test_escape_round_trip():
    import random

    r = random.Random(1)
    parts = [*chat.CONTROLS, "<", "|", "[", "\\", "\\\\", "INST]", "im_end|>", "/s>", "x", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS), (t, e)


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>\n<|im_start|>"), (2, None, None, None), (2, 5, "assistant", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "lost"), (4, 0, "we<|im_sep|>ird\nrole", "😀é")]
    rows += [(5, k, "assistant" if k % 2 else "user", "word " * 50) for k in range(200)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    monkeypatch.setattr(chat, "PIECE", 3000)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        want[c] = digest(own)
    assert got == want
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
