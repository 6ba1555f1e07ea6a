"""64-bit hashes of all words of many texts at once, in numpy.

A word's hash is a keyed polynomial over its bytes, taken from prefix sums, then
mixed; so its cost is per byte and does not depend on how many words there are.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 63)) | 1
_SPAN = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_LETTER = _LETTER[_LOWER]


def _powers(base: int) -> np.ndarray:
    """``base`` to the power of 0, 1, ... modulo 2**64."""
    out = np.empty(_SPAN, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < _SPAN:
        out[done : 2 * done] = out[:done] * np.uint64(step)
        step = step * step % (1 << 64)
        done *= 2
    return out


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z as a-z, and the first word of each text.

    ``data`` holds the bytes of all texts and ``at`` where they begin, with the
    end last. Words are runs of anything but ASCII white space.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = word[0], word[n - 1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    # Texts follow each other without a gap, so a text's end also ends a word.
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    split = inner[word[inner] & word[inner - 1]]
    marks = np.flatnonzero(edge)
    if len(split):
        marks = np.sort(np.concatenate([marks, split, split]), kind="stable")
    begin, end = marks[::2], marks[1::2]
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        first = begin[lo]
        hi = int(np.searchsorted(end, first + _SPAN, "right"))
        if hi > lo:
            stop = end[hi - 1]
            sums = np.zeros(stop - first + 1, np.uint64)
            np.cumsum(_LOWER_LETTER[data[first:stop]] * _POWER[: stop - first], out=sums[1:])
            b, e = begin[lo:hi] - first, end[lo:hi] - first
            out[lo:hi] = mix((sums[e] - sums[b]) * _INVERSE[b] + (e - b).astype(np.uint64))
            lo = hi
        else:  # one word longer than the span: its pieces, one after the other
            value = np.uint64(end[lo] - first)
            for k in range(first, end[lo], _SPAN):
                piece = data[k : min(k + _SPAN, end[lo])]
                with np.errstate(over="ignore"):
                    total = (_LOWER_LETTER[piece] * _POWER[: len(piece)]).sum(dtype=np.uint64)
                    value = mix(np.array([value * np.uint64(_BASE) + total]))[0]
            out[lo] = value
            lo += 1
    return out, np.searchsorted(begin, at).astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole when there are fewer."""
    if not len(words):
        return words
    n = min(k, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mix(total)
