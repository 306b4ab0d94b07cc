"""Words and word shingles as 64-bit hashes, by whole batches of texts.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums over the batch, so no
step is done word by word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; the tables of powers are as long.
CHUNK = 1 << 18

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False
_VALUES = np.where(_SOLID, np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)[_LOWER], np.uint64(0))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    return h ^ (h >> np.uint64(29))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a buffer."""
    a = np.frombuffer(data, np.uint8)
    solid = _SOLID[a]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    forth, back = _tables(len(a))[:2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUES[a] * forth[: len(a)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64) * _P1)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at + 1, at + CHUNK) for c in (b" ", b"\n", b"\t"))
        if cut < 0:
            cut = min((k for c in (b" ", b"\n", b"\t") if (k := text.find(c, at + CHUNK)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, a hash for each ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        starts, hashes = _hash_words(b"\n".join(group))
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
        cuts = np.searchsorted(starts, firsts)
        out.extend(hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    for text in texts:
        if group and size + len(text) >= CHUNK:
            flush()
            group, size = [], 0
        if len(text) > CHUNK:
            out.append(np.concatenate([_hash_words(p)[1] for p in _pieces(text)]))
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        flush()
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words, in order; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _P1
        out ^= out >> np.uint64(31)
    return mix(out)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer than ``k`` words are one shingle as a whole."""
    return [np.unique(runs(h, min(k, len(h)))) if len(h) else h for h in word_hashes(texts)]
