"""Content-chosen anchors over token streams, shared by the two substring operators.

All windows of a fixed number of tokens are split among *anchors*: a window belongs to its token gram
of least hash (the leftmost on ties), so equal windows, wherever they stand, have equal anchors at the equal
place. Neighbouring windows with one anchor form a *run*; the text a run covers is its *block*.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64((1 << 24) - 1)
#: Tokens worked on at a time: positions must fit in 24 bits, and memory is about 100 bytes a token.
PIECE = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of unsigned integers (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLES: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64, worked out once a task."""
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _TABLES[name] = have
    return have[:n]


class Spans:
    """Hashes of any spans of one token stream, by prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.multiply(h, _powers("up", _BASE, len(h)), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        back = _powers("down", _UNBASE, int(start.max(initial=0)) + 1)
        return mixed((self.sums[start + length] - self.sums[start]) * back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k-gram."""
        n = max(0, len(self.sums) - k)
        out = self.sums[k:k + n] - self.sums[:n]
        out *= _powers("down", _UNBASE, n)
        return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


@dataclass
class Runs:
    doc: np.ndarray      # number of the document in the slice
    start: np.ndarray    # first window, as a token position in the document
    count: np.ndarray    # windows in the run
    place: np.ndarray    # anchor's distance from the first window
    anchor: np.ndarray   # hash of the anchor gram
    block: np.ndarray    # hash of the run's text, count and place
    left: np.ndarray     # hash of the anchor with half a window's other tokens before it; 0 if the run ends short of that
    right: np.ndarray    # the same after it. A window that two runs share reaches that far on one side in both


def runs_of(hashes: list[np.ndarray], window: int, gram: int) -> Runs:
    """Runs of all documents of a slice, given each document's token hashes.

    Documents longer than ``PIECE`` are cut in overlapping pieces; a run cut so becomes two runs.
    """
    pieces = [(n, at) for n, h in enumerate(hashes) if len(h) >= window
              for at in range(0, len(h) - window + 1, PIECE - window + 1)]
    parts, group, size = [], [], 0
    for n, at in pieces:
        length = min(len(hashes[n]) - at, PIECE)
        if size + length > PIECE and group:
            parts.append(_runs(hashes, group, window, gram))
            group, size = [], 0
        group.append((n, at, length))
        size += length
    if group:
        parts.append(_runs(hashes, group, window, gram))
    if not parts:
        empty = np.zeros(0, np.int64)
        return Runs(*[empty] * 4, *[empty.astype(np.uint64)] * 4)
    return Runs(*[np.concatenate([getattr(p, f) for p in parts]) for f in Runs.__dataclass_fields__])


def _runs(hashes, group, window, gram) -> Runs:
    h = np.concatenate([hashes[n][at:at + length] for n, at, length in group])
    lengths = np.array([g[2] for g in group])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    spans = Spans(h)
    grams = spans.grams(gram)
    key = grams & ~_LOW
    key |= np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(key, window - gram + 1) & _LOW).astype(np.int64)
    windows = lengths - window + 1
    own = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    a = anchor[own]
    breaks = np.flatnonzero((np.diff(a) != 0) | (np.diff(own) != 1)) + 1
    first = np.concatenate([[0], breaks])
    count = np.diff(np.concatenate([first, [len(own)]]))
    start, at = own[first], a[first]
    piece = np.searchsorted(begin, start, "right") - 1
    text = spans.hash(start, count + window - 1)
    place = at - start
    block = mixed(text ^ (place * 4096 + count).astype(np.uint64))
    half = -(-(window - gram) // 2)
    sides = []
    for reaches, shift in ((place >= half, -half), (count - 1 + window - gram - place >= half, 0)):
        side, k = np.zeros(len(at), np.uint64), np.flatnonzero(reaches)
        side[k] = spans.hash(at[k] + shift, gram + half) | np.uint64(1)
        sides.append(side)
    docs, offsets = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    return Runs(docs[piece], start - begin[piece] + offsets[piece], count, place, grams[at], block, *sides)


def window_hashes(h: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, hash) of all windows of the given runs of one document."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return at, Spans(h).hash(at, window)


def covered(length: int, start, count, window: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a window of the runs (first window, number of windows)."""
    edge = np.zeros(length + 1, np.int64)
    start, count = np.asarray(start, np.int64), np.asarray(count, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0
