"""Token ids in compressed blocks: context mixing of orders 0 to 2 drives an interleaved range coder.

A block is coded by itself: its model starts empty, and its header holds a checksum of its ids. Its
ids are dealt to lanes, stretches of consecutive ids with a range coder each; all lanes advance
together, one id at a time, share one adaptive model and put their words into one stream, so numpy
does a step for all lanes at once.

For each id the model has three predictions. Order 2 is the id that last followed the two before it. Order 1 is
the counts of all ids that followed the one before it, taken anew whenever the block has doubled. Order 0 is
the counts of ids that neither predicted. How much of the interval each one gets is learned as the
block goes on, for each kind of context: how often order 2 was right before, how many ids
order 1 has seen, and how many of them differ.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VTL2"
_HEADER = struct.Struct("<4sIIIII")  # magic, ids, lanes, alphabet, words, crc32 of the ids
_SCALE = 16  # bits of a share
_LOW = 1 << 32  # an interval's least size; it is less than 2**48
_CONFIDENT = 7  # largest confidence count of the order-2 prediction
_ORDER2_BITS = 20
_AHEAD = 3  # words of a lane that a decoder holds
_REFRESH = 8  # steps between two refreshes of the order-0 sums and the shares
_MIN0, _MIN1 = 1024, 256  # least shares of order 0 and order 1, in 1 / 2**16: each has room for all counts of a block
#: Ids of a block, at most: so many counts fit into the least share of the least interval.
MOST_IDS = 1 << 22
#: Ids are less than this: the model holds a few counts for each possible one.
MOST_ALPHABET = 1 << 20

_SURER = np.minimum(np.arange(_CONFIDENT + 1) + 1, _CONFIDENT).astype(np.int32)


def lanes_for(n: int) -> int:
    return max(1, min(8192, n // 256))


def _kinds(n: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The kind of each order-1 context, under 64: by its ids and how often they repeat. Kind 0 has none."""
    size = np.minimum(np.frexp(n.astype(float))[1], 15)
    repeats = np.clip(np.frexp(n / np.maximum(distinct, 1))[1] - 1, 0, 3)
    return np.where(n > 0, size * 4 + repeats, 0)


class _Model:
    """The shared predictions of one block; encoder and decoder update it alike."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.next2 = np.zeros(1 << _ORDER2_BITS, np.int32)  # id * 8 + confidence
        self.kind = np.zeros(alphabet, np.int64)
        self.base = np.zeros(alphabet + 1, np.int64)
        contexts = 64 * (_CONFIDENT + 1)
        self.seen, self.held2, self.held1 = np.full(contexts, 4.0), np.full(contexts, 1.0), np.full(contexts, 2.0)
        self.count = np.ones(alphabet, np.int64)
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.late = 0, []
        self.refresh()

    def refresh(self) -> None:
        top = (1 << _SCALE) - _MIN0 - _MIN1
        self.share2 = np.maximum(1, self.held2 / self.seen * top).astype(np.int64)
        left = (1 << _SCALE) - self.share2
        self.share1 = np.clip((self.held1 / np.maximum(self.seen - self.held2, 1e-9) * left).astype(np.int64), _MIN1, left - _MIN0)
        self.share1[np.arange(len(self.share1)) % 64 == 0] = 0  # order 1 has seen nothing
        self.sums = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(self.count, out=self.sums[1:])
        self.total = int(self.sums[-1])

    def predict(self, n: int):
        """Order 2's guess for the first n lanes, and the shares of orders 2 and 1."""
        a, b = self.a[:n], self.b[:n]
        self.at2 = (a * 40503 ^ b * 2654435) & ((1 << _ORDER2_BITS) - 1)
        told = self.next2[self.at2]
        self.sure = told & _CONFIDENT
        self.context = (self.sure << 6) + self.kind[b]
        return told >> 3, self.share2[self.context], self.share1[self.context]

    def count_now(self, ids: np.ndarray) -> np.ndarray:
        """Order-0 counts as they were when the sums were formed."""
        return self.sums[ids + 1] - self.sums[ids]

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, rest: np.ndarray) -> None:
        """Learn the ids of a step: those order 2 or order 1 predicted, and those of neither (`rest`, in lane order)."""
        n = len(ids)
        self.next2[self.at2] = (ids << 3) + _SURER[self.sure] * hit2
        self.a[:n], self.b[:n] = self.b[:n], ids
        self.late.append((self.context, self.context[hit2], self.context[hit1], rest))
        self.step += 1
        if self.step < 32 or self.step % _REFRESH == 0:
            seen, held2, held1, rest = map(np.concatenate, zip(*self.late))
            self.late = []
            size = len(self.seen)
            self.seen += np.bincount(seen, minlength=size)
            self.held2 += np.bincount(held2, minlength=size)
            self.held1 += np.bincount(held1, minlength=size)
            self.count += np.bincount(rest, minlength=self.alphabet)
            self.refresh()


def _snapshots(steps: int) -> list[int]:
    """Steps before which order 1 is counted anew."""
    out, at = [], 1
    while at < steps:
        out.append(at)
        at *= 2
    return out


def _dealt(n: int, lanes: int) -> tuple[int, int]:
    """Steps, and lanes that still have an id in the last step; lane i holds ids i*steps onwards."""
    steps = -(-n // lanes)
    return steps, -(-n // steps)


class _KnownPairs:
    """Order-1 counts for an encoder, which knows all pairs of a block beforehand."""

    def __init__(self, grid: np.ndarray, n_last: int, alphabet: int):
        steps, lanes = grid.shape
        pairs = np.empty((steps, lanes), np.int64)
        pairs[0], pairs[1:] = grid[0], grid[:-1] * alphabet + grid[1:]
        if n_last < steps:
            pairs[n_last:, -1] = -1  # the last lane has no ids there
        flat = pairs.ravel()
        bits = len(flat).bit_length()
        if (alphabet * alphabet).bit_length() + bits < 63:
            order = np.sort((flat << bits) + np.arange(len(flat)))
            place, found = order & ((1 << bits) - 1), order >> bits
        else:
            place = np.argsort(flat, kind="stable")
            found = flat[place]
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        self.number = np.empty(len(flat), np.int32)
        self.number[place] = np.cumsum(new) - 1
        self.number = self.number.reshape(steps, lanes)
        self.keys = found[new]
        self.firsts = np.searchsorted(self.keys, np.arange(alphabet + 1) * alphabet)
        self.count = np.zeros(len(self.keys), np.int64)
        self.sums = np.zeros(len(self.keys) + 1, np.int64)
        self.none = int(self.keys[0] < 0)
        self.at = 0

    def count_to(self, step: int, model: _Model) -> None:
        self.count += np.bincount(self.number[self.at : step].ravel(), minlength=len(self.count))
        if self.none:
            self.count[0] = 0
        np.cumsum(self.count, out=self.sums[1:])
        kinds = np.concatenate([[0], np.cumsum(self.count > 0)])
        model.base = self.sums[self.firsts]
        model.kind = _kinds(np.diff(model.base), np.diff(kinds[self.firsts]))
        self.at = step


def encode_block(ids: np.ndarray) -> bytes:
    """One block of ids (each under 2**20, as vocabularies are). No ids give a block without words; over MOST_IDS raise ValueError."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if n > MOST_IDS or (n and int(ids.max()) >= MOST_ALPHABET):
        raise ValueError("too many ids for one block, or too large ones")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _HEADER.pack(MAGIC, 0, 0, 0, 0, crc)
    alphabet = int(ids.max()) + 1
    steps, lanes = _dealt(n, lanes_for(n))
    grid = np.zeros(steps * lanes, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    full = n - (lanes - 1) * steps  # steps in which the last lane still has ids
    model, pairs = _Model(alphabet, lanes), _KnownPairs(grid, full, alphabet)
    snapshots = set(_snapshots(steps))
    low, size = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    words, owners = [], []
    for t in range(steps):
        if t in snapshots:
            pairs.count_to(t, model)
        k = lanes if t < full else lanes - 1
        x, pair = grid[t, :k], pairs.number[t, :k]
        guess, share2, share1 = model.predict(k)
        lo, sz = low[:k], size[:k]
        unit = sz >> _SCALE
        part2, part1 = share2 * unit, share1 * unit
        hit2 = guess == x
        freq = pairs.count[pair]
        hit1 = (freq > 0) & ~hit2
        one, rest = np.flatnonzero(hit1), np.flatnonzero(~(hit1 | hit2))
        whole, sz[:] = sz[rest], part2
        c = model.b[one]
        base = model.base[c]
        unit = _parts(part1[one], model.base[c + 1] - base)
        lo[one] += part2[one] + (pairs.sums[pair[one]] - base) * unit
        sz[one] = freq[one] * unit
        y = x[rest]
        skip = part2[rest] + part1[rest]
        unit = _parts(whole - skip, model.total)
        lo[rest] += skip + model.sums[y] * unit
        sz[rest] = model.count_now(y) * unit
        at = np.flatnonzero(sz < _LOW)
        while len(at):
            words.append((lo[at] >> 32).astype(np.uint32))
            owners.append(at.astype(np.int16))
            lo[at] = (lo[at] & (_LOW - 1)) << 16
            sz[at] <<= 16
            at = at[sz[at] < _LOW]
        model.update(x, hit2, hit1, y)
    for _ in range(_AHEAD):
        words.append((low >> 32).astype(np.uint32))
        owners.append(np.arange(lanes, dtype=np.int16))
        low = (low & (_LOW - 1)) << 16
    body = _as_read(np.concatenate(words), np.concatenate(owners), lanes)
    return _HEADER.pack(MAGIC, n, lanes, alphabet, len(body), crc) + body.tobytes()


def _parts(size: np.ndarray, total) -> np.ndarray:
    """size // total, exact in floating point: sizes are under 2**48."""
    return (size / total).astype(np.int64)


def _as_read(words: np.ndarray, owners: np.ndarray, lanes: int) -> np.ndarray:
    """Carry each word's 17th bit to the word before it in its lane, and put the words in the order in which a decoder asks
    for them: its lanes are _AHEAD words ahead."""
    by_lane = np.argsort(owners, kind="stable")
    sizes = np.bincount(owners, minlength=lanes)
    firsts = np.cumsum(sizes) - sizes
    place = np.empty(len(words), np.int64)
    place[by_lane] = np.arange(len(words))
    own = words[by_lane]
    while len(carry := np.flatnonzero(own >> 16)):
        own[carry] &= 0xFFFF
        own[carry - 1] += 1
    own = own.astype("<u2")
    events = place[: len(words) - _AHEAD * lanes]
    return np.concatenate([own[firsts[None, :] + np.arange(_AHEAD)[:, None]].ravel(), own[events + _AHEAD]])


class _FoundPairs:
    """Order-1 counts for a decoder: all pairs so far, sorted, so that a count's place in a context is an index."""

    def __init__(self, grid: np.ndarray, full: int, alphabet: int):
        self.grid, self.full, self.alphabet = grid, full, alphabet
        self.pairs, self.at = np.zeros(0, np.int64), 0

    def count_to(self, step: int, model: _Model) -> None:
        a, own = self.at, self.grid[self.at : step]
        before = np.zeros_like(own)
        before[int(a == 0) :] = self.grid[max(a - 1, 0) : step - 1]
        new = before * self.alphabet + own
        if step > self.full:
            new = np.concatenate([new[:, :-1].ravel(), new[: max(0, self.full - a), -1]])
        self.pairs = np.concatenate([self.pairs, new.ravel()])
        self.pairs.sort()
        opens = np.ones(len(self.pairs), bool)
        opens[1:] = self.pairs[1:] != self.pairs[:-1]
        self.starts = np.append(np.flatnonzero(opens), len(self.pairs))
        self.run = (np.cumsum(opens) - 1).astype(np.int32)
        model.base = np.searchsorted(self.pairs, np.arange(self.alphabet + 1) * self.alphabet)
        kinds = np.concatenate([[0], self.run + 1])
        model.kind = _kinds(np.diff(model.base), np.diff(kinds[model.base]))
        self.at = step


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if its magic, length or checksum is wrong."""
    if len(block) < _HEADER.size:
        raise ValueError("the block is cut short")
    magic, n, lanes, alphabet, words, crc = _HEADER.unpack_from(block)
    if magic != MAGIC or len(block) != _HEADER.size + 2 * words:
        raise ValueError("not a whole block")
    if not n:
        return np.zeros(0, np.int64)
    if n > MOST_IDS or not 0 < lanes <= n or not 0 < alphabet <= MOST_ALPHABET:
        raise ValueError("the block's header is damaged")
    stream = np.frombuffer(block, "<u2", words, _HEADER.size).astype(np.int64)
    steps = _dealt(n, lanes)[0]
    full = n - (lanes - 1) * steps
    grid = np.zeros((steps, lanes), np.int64)
    model, pairs = _Model(alphabet, lanes), _FoundPairs(grid, full, alphabet)
    snapshots = set(_snapshots(steps))
    size, value = np.full(lanes, (1 << 48) - 1, np.int64), np.zeros(lanes, np.int64)
    at_word = _AHEAD * lanes
    try:
        for i in range(_AHEAD):
            value = (value << 16) | stream[i * lanes : (i + 1) * lanes]
        for t in range(steps):
            if t in snapshots:
                pairs.count_to(t, model)
            k = lanes if t < full else lanes - 1
            guess, share2, share1 = model.predict(k)
            sz, v = size[:k], value[:k]
            unit = sz >> _SCALE
            part2, part1 = share2 * unit, share1 * unit
            skip = part2 + part1
            hit2 = v < part2
            hit1 = (v < skip) & ~hit2
            one, rest = np.flatnonzero(hit1), np.flatnonzero(v >= skip)
            whole, sz[:] = sz[rest], part2
            x = grid[t, :k]
            x[:] = guess
            if len(one):
                c = model.b[one]
                base = model.base[c]
                unit = _parts(part1[one], model.base[c + 1] - base)
                inside = v[one] - part2[one]
                place = base + inside // unit
                run = pairs.run[place]
                start = pairs.starts[run]
                x[one] = pairs.pairs[place] - c * alphabet
                v[one] = inside - (start - base) * unit
                sz[one] = (pairs.starts[run + 1] - start) * unit
            unit = _parts(whole - skip[rest], model.total)
            inside = v[rest] - skip[rest]
            y = np.searchsorted(model.sums, inside // unit, side="right") - 1
            v[rest] = inside - model.sums[y] * unit
            sz[rest] = model.count_now(y) * unit
            x[rest] = y
            at = np.flatnonzero(sz < _LOW)
            while len(at):
                v[at] = (v[at] << 16) | stream[at_word : at_word + len(at)]
                sz[at] <<= 16
                at_word += len(at)
                at = at[sz[at] < _LOW]
            model.update(x, hit2, hit1, y)
    except (IndexError, ValueError, ZeroDivisionError) as e:
        raise ValueError("the block is damaged") from e
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the block's checksum differs")
    return ids
