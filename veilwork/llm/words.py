"""Words of an Arrow text column as numpy arrays: places, owners and hashes.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
Texts are never copied word by word: a word is a pair of byte places, and its
hash comes from prefix sums of a polynomial over the whole buffer, so that the
hash of any span costs two lookups.  Hashes have 64 bits and depend on the bytes
of the span alone, hence are the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21

_WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTES = np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)


def _powers(base: int) -> np.ndarray:
    out = np.full(_WINDOW, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of all but its last word and the last word's."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


class Piece:
    """Whole texts of a batch, one after the other.

    ``rows`` is the slice of the batch, ``offsets`` the byte places of its texts;
    word ``i`` is ``buf[starts[i]:ends[i]]``, and text ``d`` has the words
    ``first[d]:first[d + 1]``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool):
        self.buf = _LOWER[buf] if lower else buf
        self.offsets, self.rows, self._sums = offsets, rows, None
        word = ~_SPACE[buf]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        full = np.flatnonzero(np.diff(offsets))
        at = offsets[full]
        begin[at] = word[at]
        at = offsets[full + 1] - 1
        end[at] = word[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[self.offsets])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``buf[start:end]``."""
        if self._sums is None:
            n = len(self.buf)
            sums, scale = np.zeros(n + 1, np.uint64), 1
            for a in range(0, n, _WINDOW):
                b = min(a + _WINDOW, n)
                v = _BYTES[self.buf[a:b]]
                v *= _UP[:b - a]
                v *= np.uint64(scale)
                np.cumsum(v, out=sums[a + 1:b + 1])
                sums[a + 1:b + 1] += sums[a]
                scale = scale * pow(_BASE, _WINDOW, 1 << 64) & _MASK
            step = pow(pow(_BASE, _WINDOW, 1 << 64), -1, 1 << 64)
            self._sums = sums
            self._back = np.array([pow(step, i, 1 << 64) for i in range(n // _WINDOW + 1)], np.uint64)
        h = self._sums[ends] - self._sums[starts]
        h *= _DOWN[starts & (_WINDOW - 1)]
        h *= self._back[starts >> 20]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def hashes(self) -> np.ndarray:
        """The hash of each word."""
        return self.spans(self.starts, self.ends)


def pieces(column: pa.Array, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column of texts into pieces of about ``size`` bytes, at text ends only.

    NULL counts as the empty text.  ``lower`` lower-cases A to Z.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(places, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield Piece(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], slice(a, b), lower)
        a = b
