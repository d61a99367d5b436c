"""What the text classifiers see of a text: words hashed to rows of a table, and counts.

Only the text is looked at. Hashes are CRC-32, the same in every process.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"\w+")


class HashedWords:
    """Indices of hashed word features, remembered for a bounded number of words."""

    def __init__(self, bits: int, of_word, remembered: int = 300_000):
        self.mask, self.of_word, self.most = (1 << bits) - 1, of_word, remembered
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, words) -> set[int]:
        out: set[int] = set()
        known = self.known
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) >= self.most:
                    known.clear()
                found = known[w] = tuple({zlib.crc32(f.encode()) & self.mask for f in self.of_word(w)})
            out.update(found)
        return out


def spread(total: float, n: int) -> float:
    return total / n if n else 0.0


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
