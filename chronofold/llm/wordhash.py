"""Words of many texts at once, as numpy arrays, and hashes of runs of them.

Words are `[^\\x20\\x09-\\x0D]+`. Their hashes take the bytes eight at a time; a
run's hash is a polynomial in its words' hashes, built by doubling, so a run of k
words costs about log k steps for all starts together.
"""

from __future__ import annotations

import numpy as np

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = [np.uint64((1 << (8 * k)) - 1) for k in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
_MASKS = np.array(_LOW, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """starts and ends (bytes of `joined`), text (which one a word is of), first (a text's first word; one more at the end)."""

    def __init__(self, texts: list[bytes]):
        self.joined = b" " + b" ".join(texts) + b" " * 9
        raw = np.frombuffer(self.joined, np.uint8)
        gap = _GAP[raw]
        turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = turns[::2], turns[1::2]
        offsets = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)
        self.sizes = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.starts)) - self.first[:-1][self.text]

    def __len__(self) -> int:
        return len(self.starts)

    def left(self) -> np.ndarray:
        """Words from each one to its text's end, itself included."""
        return self.sizes[self.text] - self.place

    def hashes(self) -> np.ndarray:
        eight = np.ndarray((len(self.joined) - 7,), "<u8", self.joined, strides=(1,))
        sizes = self.ends - self.starts
        h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        on, k = np.arange(len(sizes)), 0
        while len(on):
            rest = sizes[on] - k
            h[on] = mix(h[on] ^ (eight[self.starts[on] + k] & _MASKS[np.minimum(rest, 8)]))
            k += 8
            on = on[rest > 8]
        return h

    def strings(self, keep: np.ndarray, k: int) -> list[bytes]:
        """The kept words of text k."""
        a, b = self.first[k], self.first[k + 1]
        at = np.flatnonzero(keep[a:b]) + a
        return [self.joined[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def runs(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """For each start with k hashes from there on: the hash of that run. Runs across texts are the caller's to leave out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    one = 1 << 64
    done, size, power, width = None, 0, h, 1  # done: runs of `size`, power: runs of `width`
    while k:
        if k & 1:
            if done is None:
                done, size = power, width
            else:
                n = len(h) - size - width + 1
                done = done[:n] * np.uint64(pow(base, width, one)) + power[size : size + n]
                size += width
        k >>= 1
        if k:
            n = len(h) - 2 * width + 1
            if n <= 0:
                break
            power = power[:n] * np.uint64(pow(base, width, one)) + power[width : width + n]
            width *= 2
    return mix(done)
