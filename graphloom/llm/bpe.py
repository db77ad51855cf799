"""Byte-level BPE over Arrow batches: pre-tokens are found with numpy and encoded once each.

A batch's distinct pre-tokens are few beside its pre-tokens, so the batch is cut
into pre-tokens by vectorised character classes, dictionary-encoded in Arrow, and
only unseen pre-tokens reach the BPE merges. Ids equal ``Tokenizer.encode``'s.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm import textkit as tk

#: The pre-token pattern of byte-level BPE files of this kind; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Pre-tokens remembered between batches; a full memory is emptied, which only costs time.
MEMO = 150_000


def char_class(c: int) -> int:
    # White_Space property
    if c in (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 9 <= c <= 13 or 0x2000 <= c <= 0x200A:
        return SPACE
    k = unicodedata.category(chr(c))[0]
    return LETTER if k == "L" else NUMBER if k == "N" else OTHER


class Bpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_piece = self.core._core_bpe.encode_single_piece if hasattr(self.core._core_bpe, "encode_single_piece") else lambda x: self.core.encode_ordinary(x.decode())
        self.path, self.slow = path, None
        self.classes = np.fromiter(map(char_class, range(0x110000)), np.uint8, 0x110000)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def cut(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of texts laid end to end."""
        n = len(data)
        cls = self.classes[:256][data]
        if len(lead := np.flatnonzero(data >= 0xC0)):
            b = [data[np.minimum(lead + k, n - 1)].astype(np.uint32) & 0x3F for k in range(4)]
            d = data[lead].astype(np.uint32)
            cp = np.where(d < 0xE0, (d & 0x1F) << 6 | b[1], np.where(d < 0xF0, (d & 0xF) << 12 | b[1] << 6 | b[2], (d & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
            k = self.classes[cp]
            cls[lead] = k
            for more, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
                of = d >= least
                cls[lead[of] + more] = k[of]
        start = np.ones(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        rows = off[:-1][np.diff(off) > 0]
        start[rows] = True
        space = cls == SPACE
        cut = np.flatnonzero(start)
        ends = np.append(cut[1:], n)
        at_end = np.zeros(n + 1, bool)
        at_end[off[1:]] = True
        # a run of white space before something else gives up its last character
        s, e = cut[space[cut]], ends[space[cut]]
        inner = ~at_end[e]
        s, e = s[inner], e[inner]
        last = e - 1
        while (cont := (data[last] & 0xC0) == 0x80).any():
            last = np.where(cont, last - 1, last)
        start[last] = True
        plain = data[last] == 0x20  # which a blank joins to what follows
        start[e[plain]] = False
        # contractions: a lone apostrophe that starts a pre-token, then letters
        q = np.flatnonzero((data == 0x27) & start)
        for i in q.tolist():
            row_end = int(off[np.searchsorted(off, i, "right")])
            if i + 1 < row_end and cls[i + 1] == LETTER:
                tail = data[i + 1 : min(i + 3, row_end)].tobytes()
                for x in SUFFIXES:
                    if tail.startswith(x):
                        start[i + 1] = False
                        if i + 1 + len(x) < row_end:
                            start[i + 1 + len(x)] = True
                        break
        return np.flatnonzero(start)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts end to end, and len + 1 offsets. Null is empty."""
        ids, counts = [], []
        if self.added and any(pc.any(pc.match_substring(col, x)).as_py() for x in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            for t in col.to_pylist():  # a special token's text is rare: the reference encoder takes the batch
                x = self.slow.encode(t or "", add_special_tokens=False).ids
                ids.append(np.array(x, np.uint32))
                counts.append(np.array([len(x)]))
        else:
            data, off = tk.utf8(col)
            for i, j in tk.slices(off, 2 * tk.SLICE):
                a, b = self._slice(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids.append(a)
                counts.append(b)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode unseen pre-tokens and append their ids to the memory."""
        got = list(map(self.encode_piece, pieces))
        k, n = len(self.memo), len(got)
        size = np.fromiter(map(len, got), np.int64, n)
        total = int(size.sum())
        while k + n > len(self.size):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.size)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[k : k + n] = size
        self.begin[k : k + n] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.used += total
        self.memo.update(zip(pieces, range(k, k + n), strict=True))

    def _slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        cut = self.cut(data, off)
        pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        if len(self.memo) > MEMO:
            self.forget()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        memo = self.memo
        if new := [x for x in words if x not in memo]:
            self.learn(new)
        known = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        sizes, begin, flat = self.size[known], self.begin[known], self.flat
        k = coded.indices.to_numpy()
        n = sizes[k]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n - begin[k], n)
        first = np.searchsorted(cut, off)  # pre-tokens before each row
        total = np.concatenate([[0], ends])
        return flat[at], np.diff(total[first])


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of a file, kept for the worker's life."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
