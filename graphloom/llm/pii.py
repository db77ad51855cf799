"""Personal data: base patterns, and a semi-Markov conditional random field.

The base finds canonical e-mail addresses, IP addresses, payment cards and phone numbers.
The field adds what the patterns miss: numbers written without a plus sign, cards with
other separators, addresses spelled with "at" and "dot". It scores whole candidate spans,
by features of the span and of the words beside it, and a dynamic programme over spans of
at most ``MOST`` tokens chooses boundaries and kinds together. It is trained here, by
maximum likelihood on sentences made by rule from a fixed seed.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import lean, prepare

KINDS = ("email", "ip", "card", "phone")
MOST = 24
#: An added span needs at least this posterior probability.
SURE = 0.7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses; linear, as an @ ends every local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            done = m.end()
            yield s, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base patterns, by start and then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
        out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


# --- semi-Markov CRF ---------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\s]")
#: Stretches in which a candidate span can lie: figures with separators, or words around an @ sign.
_NUMERIC = re.compile(r"(?:\+ ?|\()?[0-9](?:[ \t]?[().+/:_-]?[ \t]?[()]?[0-9]){6,}+")
_MAILISH = re.compile(r"[\w.%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[\w-]{1,64}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]{1,64}+){1,6}")
_AT = re.compile(r"\(at\)|\[at\]| at ")
CUES = {
    "phone": re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp|dial|ring|number is)\W*$"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|pan)( number)?\W*$"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|ping|ssh|from|client)\W*$"),
    "email": re.compile(r"(?i)\b(mail|email|e-mail|contact|write|reach|address)( me| us)?\W*$"),
}
_MORE = re.compile(r" ?(?:\.|\(dot\)|\[dot\]|dot ) ?\w| dot ")
_PLAIN = re.compile(r"(?i)\b(order|invoice|isbn|id|ref|total|amount|year|date|version|v|page|pages|room|score|build|ticket|sku|part|price|section|lines?|population)\W*$")


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Tokens of text[lo:hi], and candidate spans (token i, token j, start, end): at most
    ``MOST`` tokens, beginning with a figure, a plus, a bracket or a word, ending with a
    figure or a word."""
    tok = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    out = []
    mail = any(text[s] == "@" or text[s:e] == "at" for s, e in tok)
    for i, (s, e) in enumerate(tok):
        first = text[s]
        if not (first.isdigit() or first in "+(" or mail and first.isalnum()):
            continue
        digits = 0
        for j in range(i, min(len(tok), i + MOST)):
            a, b = tok[j]
            piece = text[a:b]
            digits += len(piece) if piece[0].isdigit() else 0
            if not mail and (piece[0].isalpha() or digits > 19):
                break
            if (piece[-1].isalnum()) and (digits >= 7 or mail and j >= i + 4):
                out.append((i, j + 1, s, b))
    return tok, out


def describe(text: str, s: int, e: int) -> list[str]:
    """Names of a candidate's features, whatever the kind."""
    span = text[s:e]
    digits = re.sub(r"[^0-9]", "", span)
    parts = re.findall(r"[0-9]+", span)
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))[:6]
    shape = "-".join(str(min(len(p), 9)) for p in parts) if len(parts) <= 6 else "many"
    left, right = text[max(0, s - 1) : s], text[e : e + 1]
    before = text[max(0, s - 24) : s]
    f = ["bias", f"digits={min(len(digits), 20)}", f"parts={min(len(parts), 7)}", f"shape={shape}", f"seps={seps}", f"first={span[0] if not span[0].isalnum() else 'd' if span[0].isdigit() else 'w'}"]
    f.append(f"luhn={12 <= len(digits) <= 19 and luhn(digits)}")
    f.append(f"octets={len(parts) == 4 and seps == '.' and all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    f.append(f"word={any(c.isalpha() for c in span)}")
    f.append(f"at={'sign' if '@' in span else 'word' if _AT.search(span) else 'no'}")
    f.append(f"dot={'word' if re.search(r'[ (\[]dot[ )\]]', span) else 'sign' if '.' in span else 'no'}")
    f.append(f"open_left={bool(left) and (left.isalnum() or left in '._+(@')}")
    f.append(f"open_right={bool(right) and (right.isalnum() or right in '@_/' or right in '.-:' and text[e + 1 : e + 2].isalnum())}")
    f.append(f"more_right={bool(_MORE.match(text, e))}")
    f.append(f"last={'dot' if span.endswith(('dot', 'at')) else 'n'}")
    f.append(f"brackets={span.count('(') == span.count(')')}")
    for k, cue in CUES.items():
        if cue.search(before):
            f.append(f"cue={k}")
    if _PLAIN.search(before):
        f.append("cue=plain")
    if before.rstrip().endswith(("$", "€", "£", "#")):
        f.append("cue=sign")
    return f


Lattice = tuple[int, list[tuple[int, int, list[int]]]]  # tokens, (i, j, feature numbers) of candidates


class Field:
    """Weights by kind and feature; a token outside of spans scores 0."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w: list[list[float]] = [[] for _ in KINDS]

    def numbers(self, names: list[str], learn: bool = False) -> list[int]:
        if learn:
            for n in names:
                if n not in self.index:
                    self.index[n] = len(self.index)
                    for w in self.w:
                        w.append(0.0)
        return [self.index[n] for n in names if n in self.index]

    def scores(self, lattice: Lattice) -> list[list[float]]:
        return [[sum(w[f] for f in feats) for w in self.w] for _, _, feats in lattice[1]]

    def posterior(self, lattice: Lattice, scores: list[list[float]]) -> tuple[list[list[float]], float]:
        """Probability of each candidate with each kind, by forward and backward sums."""
        n, cand = lattice
        start: dict[int, list[int]] = {}
        stop: dict[int, list[int]] = {}
        for c, (i, j, _) in enumerate(cand):
            start.setdefault(i, []).append(c)
            stop.setdefault(j, []).append(c)
        mass = [_logsum(s) for s in scores]
        fore = [0.0] * (n + 1)
        for p in range(1, n + 1):
            fore[p] = _logsum([fore[p - 1], *(fore[cand[c][0]] + mass[c] for c in stop.get(p, ()))])
        back = [0.0] * (n + 1)
        for p in range(n - 1, -1, -1):
            back[p] = _logsum([back[p + 1], *(back[cand[c][1]] + mass[c] for c in start.get(p, ()))])
        z = fore[n]
        return [[math.exp(fore[cand[c][0]] + s + back[cand[c][1]] - z) for s in scores[c]] for c in range(len(cand))], z

    def best(self, lattice: Lattice, scores: list[list[float]]) -> list[tuple[int, int]]:
        """(candidate, kind) of the best segmentation."""
        n, cand = lattice
        stop: dict[int, list[int]] = {}
        for c, (_, j, _) in enumerate(cand):
            stop.setdefault(j, []).append(c)
        top, via = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for p in range(1, n + 1):
            top[p] = top[p - 1]
            for c in stop.get(p, ()):
                k = max(range(len(KINDS)), key=scores[c].__getitem__)
                if (v := top[cand[c][0]] + scores[c][k]) > top[p]:
                    top[p], via[p] = v, (c, k)
        out, p = [], n
        while p > 0:
            c, k = via[p]
            if c < 0:
                p -= 1
            else:
                out.append((c, k))
                p = cand[c][0]
        return out[::-1]

    def fit(self, data: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-3) -> Field:
        """Stochastic gradient on the log-likelihood of labelled texts."""
        made = []
        for text, gold in data:
            tok, cand = candidates(text, 0, len(text))
            lattice = (len(tok), [(i, j, self.numbers(describe(text, s, e), True)) for i, j, s, e in cand])
            want = {(s, e): KINDS.index(k) for s, e, k in gold}
            made.append((lattice, [want.get((s, e), -1) for _, _, s, e in cand]))
        r = random.Random(3)
        for t in range(epochs):
            r.shuffle(made)
            step = rate / (1 + t / 3)
            for lattice, gold in made:
                if not lattice[1]:
                    continue
                p, _ = self.posterior(lattice, self.scores(lattice))
                for c, (_, _, feats) in enumerate(lattice[1]):
                    for k in range(len(KINDS)):
                        g = (gold[c] == k) - p[c][k]
                        if abs(g) > 1e-4:
                            w = self.w[k]
                            for f in feats:
                                w[f] += step * (g - l2 * w[f])
        return self


def _logsum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def sentences(n: int = 1400, seed: int = 21) -> list[tuple[str, list[Span]]]:
    """Labelled texts by rule from a fixed seed; half hold no personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "ed", "le", "ma", "to"]) for _ in range(r.randint(1, 3)))

    def card_number() -> str:
        d = "4" + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def thing() -> tuple[str, str, str | None]:
        k = r.randrange(14)
        if k == 0:
            a, b, c = num(3), num(3), num(4)
            return r.choice(["call ", "phone: ", "tel ", "", "mobile "]), r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}"]), "phone"
        if k == 1:
            d = card_number()
            sep = r.choice(["", " ", "-", "."])
            return r.choice(["card ", "visa ", "", "pay with "]), sep.join(d[i : i + 4] for i in range(0, 16, 4)), "card"
        if k == 2:
            return r.choice(["host ", "ip ", "", "from "]), ".".join(str(r.randint(1, 255)) for _ in range(4)), "ip"
        if k in (3, 4):
            at, dot = r.choice([("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
            return r.choice(["mail ", "write to ", "", "contact "]), f"{word()}.{num(2)}{at}{word()}{dot}{word()}{dot}com".replace("..", "."), "email"
        if k == 5:
            d = card_number()
            bad = d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)
            return r.choice(["", "order ", "id "]), r.choice([bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4))]), None
        if k == 6:
            return r.choice(["date ", "", "on "]), r.choice([f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}"]), None
        if k == 7:
            return r.choice(["version ", "build ", "v "]), ".".join(str(r.randint(0, 900)) for _ in range(r.choice([3, 5, 6]))), None
        if k == 8:
            return r.choice(["order ", "invoice ", "ref ", "ticket ", "", "part "]), num(r.randint(7, 15)), None
        if k == 9:
            return r.choice(["total ", "$", "population ", ""]), f"{r.randint(1, 999)}.{num(3)}.{num(3)}" + r.choice(["", "." + num(3)]), None
        if k == 10:
            return r.choice(["isbn ", "sku ", "id "]), r.choice([f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}-{num(5)}-{num(2)}"]), None
        if k == 11:
            return "scores ", " ".join(num(r.randint(1, 3)) for _ in range(r.randint(4, 8))), None
        if k == 12:
            return "meet ", f"{word()} at {word()} {r.choice(['dot', '.'])} {word()}", None
        return r.choice(["from ", ""]), f"{num(3)}.{num(3)}.{r.randint(256, 999)}.{num(3)}", None

    out = []
    for _ in range(n):
        before = " ".join(word() for _ in range(r.randint(0, 3))) + " "
        cue, span, kind = thing()
        if kind == "ip" and r.random() < 0.3:
            span = f"{span}"
        after = r.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(0, 3)))
        s = len(before + cue)
        out.append((before + cue + span + after, [(s, s + len(span), kind)] if kind else []))
    return out


_trained: list[Field] = []


def trained() -> Field:
    """The field, trained once for each process that asks."""
    if not _trained:
        _trained.append(Field().fit(sentences()))
    return _trained[0]


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a candidate, a few characters wider; disjoint."""
    found = [m.span() for m in _NUMERIC.finditer(text)] if _DIGIT.search(text) else []
    for sign in _SIGNS:
        at = text.find(sign)
        while at >= 0:
            if _HOST.match(text, at + len(sign)):
                lo = at
                while lo > max(0, at - 64) and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
                    lo -= 1
                if lo == at and at and text[at - 1] == " " and sign != " at ":  # a blank before the sign
                    lo -= 1
                    while lo > max(0, at - 64) and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
                        lo -= 1
                if x := _MAILISH.match(text, lo):
                    found.append(x.span())
            at = text.find(sign, at + 1)
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SIGNS = ("@", "(at)", "[at]", " at ")
_HOST = re.compile(r" ?[\w-]{1,64}+ ?(?:\.(?=[\w])|\(dot\)|\[dot\]| dot )")


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds with a posterior of at least ``SURE`` beside the base's."""
    out = []
    starts = [s for s, _, _ in base]  # ascending
    reach = list(accumulate((e for _, e, _ in base), max))  # of all base spans up to each
    last = lambda at: reach[at - 1] if at else -1
    for lo, hi in windows(text):
        if last(bisect_right(starts, lo)) >= hi:  # inside of a base span
            continue
        tok, cand = candidates(text, lo, hi)
        if not cand:
            continue
        lattice = (len(tok), [(i, j, field.numbers(describe(text, s, e))) for i, j, s, e in cand])
        scores = field.scores(lattice)
        chosen = field.best(lattice, scores)
        if not chosen:
            continue
        p, _ = field.posterior(lattice, scores)
        for c, k in chosen:
            s, e = cand[c][2:]
            if p[c][k] >= SURE and last(bisect_left(starts, e)) <= s:  # overlaps no base span
                out.append((s, e, KINDS[k]))
    return out


SPAN = T.StructType().add("kind", "string").add("start", "long").add("end", "long")


def find_pii(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, base, spans) for every row of ``docs``: arrays of (kind, start, end) in code
    points, the base's alone and all, by start and then kind. Null and empty texts have
    none; repeated rows are searched alike."""
    spark = docs.sparkSession
    prepare(spark)
    field = spark.sparkContext.broadcast(trained())
    schema = T.StructType().add(key, docs.schema[key].dataType).add("base", T.ArrayType(SPAN)).add("spans", T.ArrayType(SPAN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        for b in batches:
            base, spans = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                more = sorted(found + added_spans(text, found, f), key=lambda x: (x[0], KINDS.index(x[2])))
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in more])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(spans, kind)], names=schema.names)

    return docs.select(key, "text").mapInArrow(lean(run), schema)
