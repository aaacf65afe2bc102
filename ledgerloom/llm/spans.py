"""Terms (letters, digits and all bytes beyond ASCII) and exact comparison of byte spans."""

from __future__ import annotations

import numpy as np

from .base import LONG_WORD, LOW_BYTES, Words, eights

#: Lower-case letters for A-Z, a blank for every ASCII byte that is no letter or digit.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def terms(data: np.ndarray, at: np.ndarray) -> Words:
    """The maximal runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return Words(FOLD[data], at)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes are equal, eight bytes at a time."""
    out = np.ones(len(size), bool)
    left, right = eights(a), (eights(b) if b is not a else None)
    right = left if right is None else right
    going, at = np.arange(len(size)), 0
    while len(going) and at < LONG_WORD:
        mask = LOW_BYTES[np.minimum(size[going] - at, 8)]
        out[going] = ((left[a_start[going] + at] ^ right[b_start[going] + at]) & mask) == 0
        at += 8
        going = going[(size[going] > at) & out[going]]
    for i in going.tolist():
        out[i] = np.array_equal(a[a_start[i] + at : a_start[i] + size[i]], b[b_start[i] + at : b_start[i] + size[i]])
    return out


def counted(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span of ``counts`` numbers, one span after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
