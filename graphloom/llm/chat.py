"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, its constants are
folded, and the tree becomes Python closures. Rendering pulls messages from an iterator
and yields pieces, each with a flag that says if it lies between generation markers, so
a conversation of any length is formatted in the memory of a turn.

Language: text, ``{{ expr }}``, ``{% for x in expr %}..{% endfor %}`` (with ``loop.first``,
``loop.last``, ``loop.index``), ``{% if %}``/``{% elif %}``/``{% else %}``/``{% endif %}``,
``{% set x = expr %}``, ``{% generation %}..{% endgeneration %}``. Expressions: strings,
integers, true, false, none, names, ``a.b`` and ``a['b']`` (mapping keys only, never Python
attributes), ``or and not == != < > in + ~``, parentheses, and the filters of ``FILTERS``.
There are no calls, so a template reaches nothing but the values it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lean, prepare

#: Strings that have a meaning in formatted output; inside texts they are escaped.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """One more backslash behind the first character of each control string, so that
    none is left; strings that look escaped already get one more too."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(), "length": len, "string": str,
}


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*)|(==|!=|[<>+~|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "false": False, "none": None}


class Parser:
    """Source to a tree of tuples (kind, ...)."""

    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                self.parts.append(("text", source[at : m.start()]))
            self.parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        if at < len(source):
            self.parts.append(("text", source[at:]))
        self.i = 0

    def block(self, ends: tuple[str, ...]) -> tuple[list, str]:
        """Nodes up to a tag whose first word is in ``ends``, and that tag."""
        nodes: list = []
        while self.i < len(self.parts):
            kind, body = self.parts[self.i]
            self.i += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "out":
                nodes.append(("out", self.expression(body)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, body
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad for: {body}")
                    inner, _ = self.block(("endfor",))
                    nodes.append(("for", m[1], self.expression(m[2]), inner))
                elif word == "if":
                    nodes.append(self.branch(rest))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                        raise TemplateError(f"bad set: {body}")
                    nodes.append(("set", name.strip(), self.expression(value)))
                elif word == "generation":
                    inner, _ = self.block(("endgeneration",))
                    nodes.append(("gen", inner))
                else:
                    raise TemplateError(f"unknown tag: {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def branch(self, condition: str) -> tuple:
        then, end = self.block(("elif", "else", "endif"))
        if end.startswith("elif"):
            other = [self.branch(end[4:])]
        elif end == "else":
            other, _ = self.block(("endif",))
        else:
            other = []
        return ("if", self.expression(condition), then, other)

    def expression(self, text: str) -> tuple:
        tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"bad expression: {text}")
            tokens.append(("str", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), m[1][1:-1], flags=re.S)) if m[1] else ("int", int(m[2])) if m[2] else ("name", m[3]) if m[3] else ("op", m[4]))
            at = m.end()
        tokens.append(("end", ""))
        pos = 0

        def peek(*values: str) -> bool:
            return tokens[pos][0] in ("op", "name") and tokens[pos][1] in values

        def take() -> tuple:
            nonlocal pos
            pos += 1
            return tokens[pos - 1]

        def binary(level: int) -> tuple:
            levels = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "in"), ("+", "~"))
            if level == len(levels):
                return postfix()
            if levels[level] == ("not",):
                if peek("not"):
                    take()
                    return ("not", binary(level))
                return binary(level + 1)
            left = binary(level + 1)
            while peek(*levels[level]):
                left = ("bin", take()[1], left, binary(level + 1))
            return left

        def postfix() -> tuple:
            kind, value = take()
            if kind in ("str", "int"):
                node: tuple = ("const", value)
            elif kind == "name" and value in _CONSTANTS:
                node = ("const", _CONSTANTS[value])
            elif kind == "name":
                node = ("name", value)
            elif (kind, value) == ("op", "("):
                node = binary(0)
                if take() != ("op", ")"):
                    raise TemplateError(f"bad expression: {text}")
            else:
                raise TemplateError(f"bad expression: {text}")
            while peek(".", "[", "|"):
                what = take()[1]
                if what == "[":
                    node = ("item", node, binary(0))
                    if take() != ("op", "]"):
                        raise TemplateError(f"bad expression: {text}")
                    continue
                kind, value = take()
                if kind != "name" or what == "|" and value not in FILTERS:
                    raise TemplateError(f"bad {'filter' if what == '|' else 'key'}: {value}")
                node = ("filter", node, value) if what == "|" else ("item", node, ("const", value))
            return node

        node = binary(0)
        if tokens[pos][0] != "end":
            raise TemplateError(f"bad expression: {text}")
        return node


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}",
}


def fold(node: tuple) -> tuple:
    """An expression with its constant parts evaluated."""
    if node[0] in ("const", "name"):
        return node
    node = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    inner = [x for x in node if isinstance(x, tuple)]
    if node[0] == "bin" and node[1] in ("and", "or") and node[2][0] == "const":
        return node[3] if bool(node[2][1]) == (node[1] == "and") else node[2]
    return ("const", expr(node)({})) if all(x[0] == "const" for x in inner) else node


def fold_block(nodes: list) -> list:
    """A block without dead branches, constant output as text, texts merged."""
    out: list = []
    for n in nodes:
        if n[0] == "out":
            e = fold(n[1])
            n = ("text", str(e[1])) if e[0] == "const" else ("out", e)
        elif n[0] == "if":
            c = fold(n[1])
            if c[0] == "const":
                out += fold_block(n[2] if c[1] else n[3])
                continue
            n = ("if", c, fold_block(n[2]), fold_block(n[3]))
        elif n[0] == "for":
            n = ("for", n[1], fold(n[2]), fold_block(n[3]))
        elif n[0] == "gen":
            n = ("gen", fold_block(n[1]))
        elif n[0] == "set":
            n = ("set", n[1], fold(n[2]))
        out.append(n)
    merged: list = []
    for n in out:
        if n[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + n[1])
        else:
            merged.append(n)
    return merged


def expr(node: tuple) -> Callable[[dict], Any]:
    """A closure of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "not":
        return lambda env, f=expr(node[1]): not f(env)
    if kind == "filter":
        return lambda env, f=expr(node[1]), g=FILTERS[node[2]]: g(f(env))
    if kind == "item":

        def item(env: dict, f=expr(node[1]), k=expr(node[2])) -> Any:
            of = f(env)
            if not isinstance(of, dict):
                raise TemplateError("only mappings have keys")
            return of.get(k(env))

        return item
    a, b = expr(node[2]), expr(node[3])
    if node[1] == "and":
        return lambda env: a(env) and b(env)
    if node[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, g=_BINARY[node[1]]: g(a(env), b(env))


Piece = tuple[str, bool]


def block(nodes: list, gen: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields the pieces of a block."""
    steps = [_step(n, gen) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return run


def _step(n: tuple, gen: bool) -> Callable[[dict], Iterable[Piece]]:
    if n[0] == "text":
        return lambda env, p=((n[1], gen),): p
    if n[0] == "out":
        return lambda env, f=expr(n[1]): ((str(f(env)), gen),)
    if n[0] == "gen":
        return block(n[1], True)
    if n[0] == "if":
        return lambda env, c=expr(n[1]), a=block(n[2], gen), b=block(n[3], gen): a(env) if c(env) else b(env)
    if n[0] == "set":

        def assign(env: dict, k=n[1], f=expr(n[2])) -> tuple:
            env[k] = f(env)
            return ()

        return assign

    def loop(env: dict, k=n[1], f=expr(n[2]), body=block(n[3], gen)) -> Iterator[Piece]:
        it, i, none = iter(f(env) or ()), 0, object()
        now = next(it, none)
        while now is not none:
            then = next(it, none)  # one message ahead, for loop.last
            i += 1
            yield from body({**env, k: now, "loop": {"first": i == 1, "last": then is none, "index": i}})
            now = then

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages to pieces (text, is_generation)."""
    nodes, _ = Parser(source).block(())
    run = block(fold_block(nodes))
    return lambda messages, **env: run({**env, "messages": messages})


#: Output of one conversation is cut into rows of about so many characters.
PIECE = 1 << 20
FORMATTED = "conv_id long, piece long, text string, loss array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, text, loss): formatted conversations, with the generation spans
    [start, end) of each text in code points.

    Rows of a conversation go by turn (nulls first), then role and text; null roles and
    texts are empty. A conversation longer than about a million characters continues in
    further pieces, in order in one partition, so no conversation is held as a whole.
    """
    prepare(rows.sparkSession)
    blank = F.lit("")
    ready = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    ready = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        flow = ((c, {"role": r, "text": x, "turn": t}) for b in batches for c, t, r, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        head = next(flow, None)
        rows: list[tuple] = []
        size = 0
        while head is not None:
            conv = head[0]

            def messages() -> Iterator[dict]:
                nonlocal head
                while head is not None and head[0] == conv:
                    yield head[1]
                    head = next(flow, None)

            pieces, parts, loss, n = 0, [], [], 0
            for text, gen in render(messages()):
                if gen and text:
                    loss.append({"start": n, "end": n + len(text)})
                parts.append(text)
                n += len(text)
                if n >= PIECE:
                    rows.append((conv, pieces, "".join(parts), loss))
                    size, pieces, parts, loss, n = size + n, pieces + 1, [], [], 0
                    if size >= PIECE:
                        yield _formatted(rows)
                        rows, size = [], 0
            if n or not pieces:
                rows.append((conv, pieces, "".join(parts), loss))
                size += n
            while head is not None and head[0] == conv:  # a template that doesn't read all messages
                head = next(flow, None)
            if size >= PIECE:
                yield _formatted(rows)
                rows, size = [], 0
        if rows:
            yield _formatted(rows)

    return ready.mapInArrow(lean(run), FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], span)], names=["conv_id", "piece", "text", "loss"])


_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def read_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) of formatted text, unescaped, and the rest that isn't a whole turn."""
    turns, at = [], 0
    while m := _TURN.match(text, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, text[at:]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations say, read from the output alone; the pieces
    of a conversation are in order in one partition, as ``format_conversations`` leaves them."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> list:
            if rest:
                raise ValueError(f"conversation {conv}: output can't be read back")
            return [conv, turns, all_turns.hexdigest(), chars, loss_text.hexdigest(), total]

        conv, started = None, False
        for b in batches:
            done = []
            for c, piece, text, loss in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if piece == 0:
                    if started:
                        done.append(close())
                    conv, started, turns, chars, total, rest = c, True, 0, 0, 0, ""
                    all_turns, loss_text = hashlib.sha256(), hashlib.sha256()
                total += len(text)
                for s in loss:
                    x = unescape(text[s["start"] : s["end"]])
                    chars += len(x)
                    loss_text.update(x.encode())
                got, rest = read_turns(rest + text)
                turns += len(got)
                for role, said in got:
                    all_turns.update(f"{role}\n{said}\n".encode())
            if done:
                yield _digests(done)
        if started:
            yield _digests([close()])

    return formatted.mapInArrow(lean(run), DIGESTS)


def _digests(rows: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
