"""Word-shingle sets of texts as 64-bit hashes, computed over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once; longer texts are cut at white space.
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_PLACE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U(32))


class Hasher:
    """Word and shingle hashes; A-Z count as a-z, words are separated by blank
    and the control characters 9-13."""

    def __init__(self, width: int = 5):
        if width > len(_PLACE):
            raise ValueError(f"at most {len(_PLACE)} words")
        self.width = width
        values = mix(np.arange(1, 257, dtype=np.uint64) * U(_ODD)) | U(1)
        values[65:91] = values[97:123]
        self.byte = values
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up, self.down = np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word of ``data``."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            buf = np.frombuffer(data, dtype=np.uint8, count=len(data) - at, offset=at)[: end - at]
            while end < len(data) and not self.space[data[end]]:  # to the end of a word
                end = next((i for i in range(end, min(len(data), end + BLOCK)) if self.space[data[i]]), min(len(data), end + BLOCK))
                buf = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
            up, down = self._powers(max(len(buf), BLOCK))
            blank = self.space[buf]
            edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
            first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            total = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(self.byte[buf] * up[: len(buf)], out=total[1:])
            hashes.append(mix((total[last] - total[first]) * down[first]))
            starts.append(first + at)
            at = end
        if not hashes:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, in order and with repeats, and the
        offsets of each text's own: ``width`` words, or a shorter text's words
        together."""
        h, start = self.words(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(start, np.concatenate(([0], ends)))
        n = np.diff(first)
        w = self.width
        runs = np.zeros(0, dtype=np.uint64)
        if len(h) >= w:
            runs = sum((h[i : len(h) - w + 1 + i] * U(_PLACE[i]) for i in range(1, w)), h[: len(h) - w + 1] * U(_PLACE[0]))
        counts = np.where(n >= w, n - w + 1, np.minimum(n, 1))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(offsets[-1], dtype=np.uint64)
        full = n >= w
        # positions of every full shingle's first word
        lead = np.repeat(first[:-1][full] - offsets[:-1][full], counts[full])
        slots = np.flatnonzero(np.repeat(full, counts))
        out[slots] = mix(runs[slots + lead]) if len(slots) else runs[:0]
        for i in np.flatnonzero(~full & (n > 0)):
            own = h[first[i] : first[i + 1]]
            out[offsets[i]] = mix(np.array([sum(int(x) * _PLACE[j] for j, x in enumerate(own)) + int(n[i]) & ((1 << 64) - 1)], dtype=np.uint64))[0]
        return out, offsets


def pieces(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``most`` bytes together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end
