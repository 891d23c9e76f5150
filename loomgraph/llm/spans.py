"""Array helpers over words of many texts at once: hashes, k-grams and window minima."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that all bits depend on all bits (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < length:
        size = 1 << (length - 1).bit_length()
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:length], _powers[1][:length]


class Words:
    """The words of several texts as one buffer of bytes, a single space between words.

    ``starts`` and ``ends`` are byte positions, ``doc`` the text's number,
    ``at`` the word's place in its text and ``hash`` 64 bits of each word.
    """

    def __init__(self, texts: list[bytes]):
        parts = [b" ".join(text.split()) for text in texts]  # bytes split at 20 and 09-0D alone
        self.buffer = b"\n".join(parts) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        doc = np.concatenate(([0], np.cumsum(data[ends] == 10)[:-1]))
        full = ends > starts
        self.starts, self.ends, self.doc = starts[full], ends[full], doc[full]
        self.count = np.bincount(self.doc, minlength=len(texts))
        first = np.cumsum(self.count) - self.count
        self.at = np.arange(len(self.doc)) - first[self.doc]
        up, down = power_tables(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each place, texts' borders disregarded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _GRAM + hashes[j : n + j]
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n]) if span < width else least[:n]
