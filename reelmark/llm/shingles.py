"""Sets of hashed word shingles, the common ground of near-duplicate detection and its tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reelmark.llm.common import distinct, mixed, runs, segment_hashes, steps, text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of `width` consecutive words.

    Words are runs of bytes other than blank and 9 to 13, with A-Z lower-cased. Fewer words than `width` make one shingle of all of
    them; no words (null, empty, blank) make an empty set.
    """
    data, offsets = text_bytes(column)
    sets: list[np.ndarray] = []
    for first, last in steps(np.diff(offsets)):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        bounds = offsets[first : last + 1] - offsets[first]
        word = ~_SPACE[part]
        starts, ends = runs(word)
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(part))]
        cut = distinct(inner[word[inner] & word[inner - 1]]) if len(inner) else inner
        if len(cut):  # two texts that meet without a blank are two words
            starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        words = segment_hashes(part, starts, ends)
        at = np.searchsorted(starts, bounds)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        rolled = mixed(rolled)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                sets.append(distinct(rolled[a : b - width + 1]))
            elif b > a:
                few = np.array([b - a], np.uint64)
                for k in range(a, b):
                    few = few * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1]
                sets.append(mixed(few))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets
