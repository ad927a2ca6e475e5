"""Content anchors: cut a text at places that depend on nearby bytes only.

The smallest hash among the ``K``-byte strings inside a window of ``LENGTH`` bytes is the window's anchor. Equal windows
have equal anchors, so windows that could repeat each other meet under one anchor. Consecutive window starts with the
same anchor form a run; a run owns its window starts, and every start of a text is owned by exactly one run.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
K = 40
WIDTH = LENGTH - K + 1

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES = np.random.default_rng(2024).integers(0, 1 << 63, (2, 256), dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLY, _INVERSE):
        x = np.full(n + 1, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[i : i + width] for every i that fits (two running passes over blocks)."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.uint64(fill))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    forward = pick.accumulate(blocks, axis=1).ravel()
    backward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(backward[:n], forward[width - 1 : width - 1 + n])


class Hasher:
    """Runs of many texts at once; the powers are computed once per task."""

    def __init__(self):
        self.size = 0

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per run: index of the text, first and last owned start, anchor, hash of the run's bytes
        ``text[first : last + LENGTH]``, and whether the anchor's string stands in the run more than once."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(sizes) or sizes.max() < LENGTH:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none, none, none.astype(bool)
        n = len(buffer)
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.power, self.inverse = _powers(self.size)
        sums = []
        for table in _TABLES:
            s = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(table[buffer] * self.power[:n], out=s[1:])
            sums.append(s)
        grams = _stir((sums[0][K:] - sums[0][:-K]) * self.inverse[: n - K + 1])
        least = _sliding(grams, WIDTH, np.minimum, 0xFFFFFFFFFFFFFFFF)
        begin = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
        valid = np.arange(len(least)) + LENGTH <= (begin + sizes)[text]
        edge = np.ones(len(least), dtype=bool)
        edge[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(least)) - 1
        owned = valid[first]
        first, last = first[owned], last[owned]
        anchor = least[first]
        content = _stir((sums[1][last + LENGTH] - sums[1][first]) * self.inverse[first] + (last - first).astype(np.uint64) * _MULTIPLY)
        # Texts in which an anchor's string is repeated within one width: count it run by run there.
        highest = _sliding(np.concatenate([np.zeros(WIDTH - 1, np.uint64), np.where(valid, least, 0), np.zeros(WIDTH - 1, np.uint64)]), WIDTH, np.maximum, 0)
        place = np.flatnonzero(grams == highest[: len(grams)])
        order = np.lexsort((place, grams[place]))
        p, g = place[order], grams[place[order]]
        close = np.flatnonzero((g[1:] == g[:-1]) & (p[1:] - p[:-1] <= WIDTH))
        again = np.zeros(len(first), dtype=bool)
        for t in np.unique(text[np.minimum(p[close], len(text) - 1)]) if len(close) else ():
            for r in range(*np.searchsorted(first, [begin[t], begin[t] + sizes[t]])):
                again[r] = np.count_nonzero(grams[first[r] : last[r] + WIDTH] == anchor[r]) > 1
        which = text[first]
        return which, first - begin[which], last - begin[which], anchor.astype(np.int64), content.astype(np.int64), again
