"""Words of whole texts as 64-bit hashes, vectorised over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time; a longer text is cut between two words.
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_class(*separators: tuple[int, int]) -> np.ndarray:
    """True for each byte that belongs to words; the given inclusive ranges separate them."""
    keep = np.ones(256, bool)
    for a, b in separators:
        keep[a : b + 1] = False
    return keep


#: Words are what white space leaves: [^\x20\x09-\x0D]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are letters and digits, all of non-ASCII among them: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class WordHasher:
    """Hashes words of A-Z lower-cased UTF-8 text; equal words have equal hashes everywhere."""

    def __init__(self, keep: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.keep = keep
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        table[65:91] = table[97:123]
        self.table = table
        self._powers(PIECE)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.pow = np.cumprod(np.full(n, _P, np.uint64))
            self.inv = np.cumprod(np.full(n, pow(_P, -1, 1 << 64), np.uint64))

    def _piece(self, buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of buf; no word goes over one of breaks (sorted positions)."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pow_, inv = (self.pow, self.inv) if n <= len(self.pow) else WordHasher.long_powers(n)
        word = self.keep[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = breaks[(breaks > 0) & (breaks < n)]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        with np.errstate(over="ignore"):
            sums = np.cumsum(self.table[buf] * pow_[:n])
            h = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
            return mix(h * inv[starts]), starts, ends + 1

    @staticmethod
    def long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Only for a single word of over PIECE bytes."""
        return np.cumprod(np.full(n, _P, np.uint64)), np.cumprod(np.full(n, pow(_P, -1, 1 << 64), np.uint64))

    def _long(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, at, n = [], 0, len(buf)
        while at < n:
            to = min(n, at + PIECE)
            while to < n and self.keep[buf[to]]:
                gap = np.flatnonzero(~self.keep[buf[at:to]])
                if len(gap):
                    to = at + int(gap[-1]) + 1
                    break
                to = min(n, to + PIECE)
            h, starts, ends = self._piece(buf[at:to], np.zeros(0, np.int64))
            out.append((h, starts + at, ends + at))
            at = to
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def documents(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of rows: first row, word hashes, n + 1 bounds into them, and the words' starts and ends in raw.

        Memory doesn't grow with the batch.
        """
        i, n = 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
            j = min(j, n)
            if j == i + 1 and off[j] - off[i] > PIECE:
                h, starts, ends = self._long(raw[off[i] : off[j]])
                yield i, h, np.array([0, len(h)]), starts + off[i], ends + off[i]
            else:
                rel = off[i : j + 1] - off[i]
                h, starts, ends = self._piece(raw[off[i] : off[j]], rel)
                yield i, h, np.searchsorted(starts, rel), starts + off[i], ends + off[i]
            i = j
