"""Vectorised word, line and n-gram hashing straight on Arrow string buffers.

Words are maximal runs of bytes other than space and \\t..\\r (``[^\\x20\\x09-\\x0D]+``), which on UTF-8
is the same as on code points. Hashes are 64 bits wide, fixed by the constants below, and the same on
every machine; they stand for the word itself (no per-word Python object is ever made).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


#: What other operators keep in this worker process between tasks: functions that let it go.
_kept: list[Callable[[], None]] = []


def keeps(release: Callable[[], None]) -> None:
    """Register memory that a worker keeps between tasks; it is released when the worker turns to other work."""
    if release not in _kept:
        _kept.append(release)


def let_go() -> None:
    while _kept:
        _kept.pop()()


def give_back() -> None:
    """Let go of what other operators keep here, and return to the system what this process has freed."""
    let_go()
    _powers[:] = [np.ones(1, U), np.ones(1, U)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        if n > 1 << 23:  # one huge text: not kept
            return _cumulative(_P, n), _cumulative(_PINV, n)
        size = max(n, 1 << 20)
        _powers[:] = [_cumulative(_P, size), _cumulative(_PINV, size)]
    return _powers[0][:n], _powers[1][:n]


def _cumulative(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or off is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``target`` bytes together; one longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``doc`` (index of the text), ``hash``."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, fold: bool = False):
        self.offsets, self.data, n = offsets, data, len(data)
        self.n_docs = len(offsets) - 1
        inside = ~SPACE[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            last = offsets[1:] - 1
            after[last[last >= 0]] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self._fold, self._prefix = fold, None

    def _sums(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.data)
            out = np.zeros(n + 1, U)
            if n:
                np.cumsum((_FOLDED if self._fold else _TABLE)[self.data] * _pow(n)[0], dtype=U, out=out[1:])
            self._prefix = out
        return self._prefix

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span; the empty span has one of its own."""
        s = self._sums()
        inv = _pow(len(self.data) + 1)[1]
        return mix((s[end] - s[start]) * inv[start])

    @property
    def hash(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, doc) of every \\n-split line, empty ones too; a text of n newlines has n + 1."""
        nl = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], nl + 1]), kind="stable")
        nl_doc = np.searchsorted(self.offsets, nl, "right") - 1
        doc = np.sort(np.concatenate([np.arange(self.n_docs), nl_doc]), kind="stable")
        # a line ends where the next of the same text begins less one, or at the end of the text
        end = np.empty_like(start)
        if len(start):
            same = np.empty(len(start), bool)
            same[-1], same[:-1] = False, doc[1:] == doc[:-1]
            end[same] = start[1:][same[:-1]] - 1
            end[~same] = self.offsets[1:]
        return start, end, doc

    def grams(self, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word's index) of every window of k words inside one text."""
        h = self.hash if h is None else h
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: n] == self.doc[k - 1 :])
        out = np.zeros(n, U)
        for i in range(k):
            out = (out + h[i : i + n]) * U(_P)
        return mix(out)[at], at


def texts(col: pa.Array, target: int = 1 << 20, fold: bool = False, keep: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, :class:`Words`) of runs of about ``target`` bytes; ``keep``: what this worker keeps stays."""
    if not keep:
        let_go()
    offsets, data = buffers(col)
    for i, j in pieces(offsets, target):
        o = offsets[i : j + 1]
        yield i, j, Words(o - o[0], data[o[0] : o[-1]], fold)
