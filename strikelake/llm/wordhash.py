"""64-bit hashes of the words of a text, computed with numpy over its bytes.

A word's hash is a sum of random byte values times powers of an odd number, modulo 2^64, taken from prefix sums, so the cost
per byte is a few vector operations whatever the number of words. Blocks end between words and bound the memory.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Words end at these bytes: space and 0x09-0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words of letters and digits end at every other ASCII byte; bytes of longer characters are letters.
PUNCTUATION = ~np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(BASE)) | np.uint64(1)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 12, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, BASE, np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, inverse, np.uint64))), dtype=np.uint64)


_POWERS = _Powers()


def word_bounds(data: np.ndarray, ends_at: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], ~ends_at[data], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def _block(data: np.ndarray, ends_at: np.ndarray, prefix: int | None) -> np.ndarray:
    starts, ends = word_bounds(data, ends_at)
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    if not len(starts):
        return np.empty(0, np.uint64)
    _POWERS.grow(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _POWERS.up[: len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts])


def word_hashes(text: bytes, ends_at: np.ndarray = SPACE, prefix: int | None = None) -> np.ndarray:
    """Hashes of the words in order, or of their first ``prefix`` bytes."""
    data, out, start = np.frombuffer(text, np.uint8), [], 0
    while start < len(data):
        end = min(len(data), start + BLOCK)
        while end < len(data):  # a block ends where a word does
            gap = np.flatnonzero(ends_at[data[end : end + BLOCK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + BLOCK)
        out.append(_block(data[start:end], ends_at, prefix))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words the whole run; of none nothing."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + words[k : k + len(h)]
    return np.unique(mix(h))
