"""Sets of hashed word shingles, computed for many texts at once on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SEGMENT, _LONG = 1 << 20, 255
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))[_LOWER]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _PRIME, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word of concatenated texts. Words are what stands between ASCII white space;
    A to Z count as a to z.

    A word's hash is a polynomial of its bytes: a difference of running sums. Stretches of about
    _SEGMENT bytes, cut at white space or between documents, bound the memory. Words of over _LONG bytes are hashed by
    themselves: for words of a thousand and more, two can be made whose polynomials are equal for any base."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = _IS_SPACE[data]
    opens = np.empty(len(data), bool)
    opens[0], opens[1:] = True, gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = True
    starts = np.flatnonzero(opens & ~gap)
    closes = np.empty(len(data), bool)
    closes[-1], closes[:-1] = True, gap[1:]
    closes[inner - 1] = True
    ends = np.flatnonzero(closes & ~gap) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        size = int(ends[to - 1] - base)
        up, down = _powers(max(size, min(_SEGMENT, len(data))))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUE[data[base : base + size]] * up[:size], out=sums[1:], dtype=np.uint64)
        first, last = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        at = to
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[i] : ends[i]]].tobytes())
    return mix(out), np.searchsorted(offsets, starts, side="right") - 1


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts (no nulls) one after another, and where each begins, with the end."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(texts: pa.Array, words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (no nulls). With fewer words, the whole sequence is
    one shingle; without words the set is empty."""
    for at in range(0, len(texts), 2000):
        part = texts.slice(at, 2000)
        hashes, docs = word_hashes(*raw_bytes(part))
        n = len(hashes)
        joined = mix(hashes + np.uint64(1))
        for k in range(1, words):
            joined[: n - k] = mix(joined[: n - k] * np.uint64(3) + hashes[k:]) if n > k else joined[: n - k]
        firsts = np.searchsorted(docs, np.arange(len(part) + 1))
        for i in range(len(part)):
            a, b = int(firsts[i]), int(firsts[i + 1])
            if b - a >= words:
                own = np.sort(joined[a : b - words + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=words)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_digest(own: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def parity_bits(own: np.ndarray) -> np.ndarray:
    """Four longs: for each of 256 classes of hashes, whether the set has an odd number of them.

    Two sets' bits differ in no more places than their symmetric difference has elements."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
