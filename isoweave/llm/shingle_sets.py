"""Sets of word shingles as sorted 64-bit hashes, computed on whole byte arrays."""

from __future__ import annotations

import functools

import numpy as np

_BLANK = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(_BLANK)] = True
#: Bytes of text that are hashed at once, up to the end of a word.
PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A fixed random value for each byte, A-Z as a-z.
_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, the parts between ASCII white space; A-Z count as a-z.

    Long texts are taken in pieces that end in white space or with the text.
    """
    if len(text) <= PIECE:
        return _piece_hashes(text)
    out, at = [], 0
    while at < len(text):
        cut = at + PIECE
        while cut < len(text) and text[cut] not in _BLANK:
            cut += 1
        out.append(_piece_hashes(text[at:cut]))
        at = cut
    return np.concatenate(out)


def _piece_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(12, len(b).bit_length()))
    gap = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    start, end = gap[::2], gap[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * up[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; with fewer words the whole sequence is one."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * _PLACE[0] + mix(words[i : i + n] + _PLACE[i % len(_PLACE)])
    return np.unique(mix(h))
