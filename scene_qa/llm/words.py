"""Hashes of the words of a text, all words at once."""

from __future__ import annotations

import numpy as np

_PLACES = 4096
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]  # A-Z are lower-cased
#: Bytes hashed together; a longer text is cut between words.
_CHUNK = 1 << 20

#: Bytes of words: ASCII letters and digits and all that isn't ASCII; or all but ASCII white space.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NOT_SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _chunk(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(inside[a])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    sizes = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, sizes)
    factor = _FACTORS[place & (_PLACES - 1)]
    if sizes.max() > _PLACES:
        factor = factor + (place // _PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
    return mixed(np.add.reduceat(_CODES[a[at]] * factor, first) + sizes.astype(np.uint64))


def word_hashes(data: bytes, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in order: a word is a run of the bytes that `inside` marks, A-Z lower-cased."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= 2 * _CHUNK:
        return _chunk(a, inside)
    out, start = [], 0
    while start < len(a):
        stop = start + _CHUNK
        while stop < len(a):  # to the end of a word
            gap = np.flatnonzero(~inside[a[stop : stop + _CHUNK]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += _CHUNK
        out.append(_chunk(a[start:stop], inside))
        start = stop
    return np.concatenate(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; of fewer words, one of them all; of none, none."""
    if not len(words):
        return words
    many = max(1, len(words) - n + 1)
    out = np.zeros(many, np.uint64)
    for j in range(min(n, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + many]
    return mixed(out)
