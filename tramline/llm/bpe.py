"""Byte-level BPE by a tree of joins.

A piece of text is cut into halves down to short leaves, leaves are merged by rank, and two
encoded neighbours are joined by encoding a window around their border anew. The window grows until
its outer tokens are compatible with the tokens beside it, where two tokens are compatible if the bytes of
both together encode to just these two. A sequence whose neighbours are all compatible is the
encoding of its bytes, so nothing outside the window can change: the join is associative and a
document may be reduced in any tree. Decoding concatenates up the tree.

Text is first split by the pattern of the vocabulary. A blank before a visible character always
begins a new match, so texts are cut there and the ids of a cut are kept in a bounded table.

Defined cases: null or empty text has no ids; repeated rows are encoded each; other columns pass
through unless ``encode`` adds a column of that name, which is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tramline.llm.common import once, slices

#: white space of the pattern's \\s
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BEFORE_VISIBLE = re.compile(f" (?=[^{_WS}])")
_BLANK_RUN = re.compile(f" (?:[{_WS}]|$)")
#: characters of the pattern's third class that end many words; a run of them is one match
_MARKS = ".,;:!?()[]{}#*$%&|<>\"-"
LEAF = 6
_NONE = 1 << 30


def cuts(text: str) -> list[str]:
    """Cuts of a text at blanks before a visible character; no match of the pattern crosses one."""
    if "  " not in text and not _BLANK_RUN.search(text):
        first, *rest = text.split(" ")
    else:
        first, *rest = _BEFORE_VISIBLE.split(text)
    return [first, *[" " + r for r in rest]]


def word_and_marks(cut: str) -> list[str] | None:
    """A cut of letters and closing marks as its two matches of the pattern; None for any other cut."""
    body = cut.rstrip(_MARKS)
    if body != cut and (body.isalpha() or body[:1] == " " and body[1:].isalpha()):
        return [body, cut[len(body) :]]
    return None


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, raw: bytes, pattern: str, kept: int = 700_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.split = regex.compile(pattern).findall
        self.kept = kept
        #: bounded tables: emptied when ``kept`` entries are in them
        self._windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self._leaves: dict[bytes, tuple[int, ...]] = {}
        self._cuts: dict[str, bytes] = {}

    def leaf(self, b: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        rank, parts = self.ranks.get, [b[i : i + 1] for i in range(len(b))]
        order = [rank(b[i : i + 2], _NONE) for i in range(len(b) - 1)]
        while order and (best := min(order)) != _NONE:
            i = order.index(best)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            order.pop(i)
            if i:
                order[i - 1] = rank(parts[i - 1] + both, _NONE)
            if i < len(order):
                order[i] = rank(both + parts[i + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of a few neighbouring tokens, from a bounded table where it is there."""
        got = self._windows.get(tokens)
        if got is None:
            got = tuple(self.leaf(b"".join([self.tokens[t] for t in tokens])))
            if len(self._windows) >= self.kept:
                self._windows.clear()
            self._windows[tokens] = got
        return got

    def compatible(self, x: int, y: int) -> bool:
        return self.window((x, y)) == (x, y)

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of ``a`` followed by those of ``b``."""
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            got = self.window(a[len(a) - i :] + b[:j])
            left = i == len(a) or self.compatible(a[len(a) - i - 1], got[0])
            right = j == len(b) or self.compatible(got[-1], b[j])
            if left and right:
                return a[: len(a) - i] + got + b[j:]
            i, j = min(len(a), i if left else i + 1), min(len(b), j if right else j + 1)

    def tree(self, b: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        if len(b) <= LEAF:
            got = self._leaves.get(b)
            if got is None:
                got = tuple(self.leaf(b))
                if len(self._leaves) >= self.kept:
                    self._leaves.clear()
                self._leaves[b] = got
            return got
        mid = len(b) // 2
        return self.join(self.tree(b[:mid]), self.tree(b[mid:]))

    def piece(self, s: str) -> bytes:
        b = s.encode("utf-8", "replace")
        whole = self.ranks.get(b)
        got = (whole,) if whole is not None else self.tree(b)
        return struct.pack(f"<{len(got)}I", *got)

    def kept_cut(self, cut: str) -> bytes:
        """Ids of a cut, which may be one match; short ones come from the bounded table."""
        ids = self._cuts.get(cut)
        if ids is None:
            if cut.isalpha() or cut[:1] == " " and cut[1:].isalpha():
                ids = self.piece(cut)
            else:
                parts = word_and_marks(cut) or self.split(cut)
                ids = self.piece(cut) if len(parts) == 1 else b"".join(map(self.kept_cut, parts))
            if len(cut) <= 64:
                if len(self._cuts) >= self.kept:
                    self._cuts.clear()
                self._cuts[cut] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, make = self._cuts.get, self.kept_cut
        return b"".join([known(cut) or make(cut) for cut in cuts(text)])

    def decode(self, ids: bytes) -> bytes:
        def up(part: list[int]) -> bytes:
            if len(part) <= 4096:
                return b"".join(map(self.tokens.__getitem__, part))
            mid = len(part) // 2
            return up(part[:mid]) + up(part[mid:])

        return up(np.frombuffer(ids, "<u4").tolist())


def loader(path: str, pattern: str) -> Callable[[], Bpe]:
    """Read the ranks here (under 2 MB) and let each worker build its encoder once."""
    with open(path, "rb") as f:
        raw = f.read()
    key = ("bpe", zlib.crc32(raw), pattern)
    return lambda: once(key, lambda: Bpe(raw, pattern))


def _with_binary(df: DataFrame, source: str, out: str, fn: Callable) -> DataFrame:
    """``df`` with the binary column ``out`` = fn(source), computed in Arrow batches."""
    rest = df.select(*[f"`{c}`" for c in df.columns if c != out])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"`{out}` binary"])
    at = rest.columns.index(source)

    def run(batches):
        for b in slices(batches):
            made = pa.array([fn(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return rest.mapInArrow(run, schema)


def encode(df: DataFrame, load: Callable[[], Bpe], text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of the whole text (little-endian unsigned 32 bit); null or empty text has none."""
    return _with_binary(df, text, out, lambda t: load().encode(t))


def decode(df: DataFrame, load: Callable[[], Bpe], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for; null ids give none."""
    return _with_binary(df, ids, out, lambda i: load().decode(i or b""))
