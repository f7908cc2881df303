"""Word hashes and shingle sets of texts, vectorized.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, A-Z lowered.
A word's hash is a polynomial over its bytes; a shingle's combines those of its
words in order.  All are 64 bits wide and fixed, alike on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.Generator(np.random.Philox(20240229))
_BYTE = _SEED.integers(1, 2**64, 256, np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
#: Bytes hashed at once; longer texts are cut between words.
_CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about a chunk that no word straddles."""
    at = 0
    while len(data) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(data):
            space = np.flatnonzero(_IS_SPACE[data[end:end + _CHUNK]])
            if len(space):
                end += int(space[0])
                break
            end = min(end + _CHUNK, len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def _hashed(data: np.ndarray) -> np.ndarray:
    space = _IS_SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = _powers(_STEP, len(data))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
    back = _powers(_BACK, int(starts[-1]) + 1)
    return mixed((upto[ends] - upto[starts]) * back[starts])


def word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    parts = [_hashed(p) for p in _cut(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``size`` words.

    With fewer words the whole sequence is one shingle; without words, none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    code = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        code = code * _STEP + mixed(words[i:len(words) - size + 1 + i] + np.uint64(i + 1))
    return np.unique(mixed(code + np.uint64(size)))
