"""Token ids of whole texts, through a cache of space-separated pieces."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa

from .shingles import mix, raw_bytes

#: A space before other white space: only there (or before the end) can a token reach over a space.
_RUN = re.compile(r" \s")
#: White space beside a line end, which may join it to one token.
_EDGE = re.compile(r"\s")
#: Runs of letters, digits or marks, each one or more pre-tokens of its own; and what makes that unsure: contractions, control
#: strings, and what is neither ASCII nor a letter.
_RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_UNSURE = re.compile(r"[\s'<]|(?![^\W\d_])[^\x00-\x7f]")
#: Words in the young half of a worker's cache, and pieces in its young table; when one is full, it becomes the old one.
CACHE, TABLE = 200_000, 1 << 20

#: Byte-level models' characters for bytes: printable ones stand for themselves, the rest follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_CHARS = "".join(_REST.get(b, chr(b)) for b in range(256))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Tail(dict):
    """Ids (little-endian unsigned 32-bit) of pieces as they follow `lead`; encodes a piece when first asked."""

    def __init__(self, tokenizer, lead: str, first: _Tail | None = None):
        super().__init__()
        self.tokenizer, self.lead, self.old = tokenizer, lead, {}
        self.first = first if first is not None else self
        self.normalizer = tokenizer.normalizer
        self.tokenize = tokenizer.model.tokenize
        self.mark = tokenizer.pre_tokenizer.pre_tokenize_str(lead + "a")[0][0][:-1]

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.parts(piece)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def parts(self, piece: str) -> bytes:
        """Ids of a new piece: of its letters, digits and marks, or of the two sides of a line end, apart where that is certain."""
        if piece.isalpha():
            ids = self.word(piece)
            return self.encoded(piece) if ids is None else ids
        before, end, after = piece.partition("\n")
        if end and before and after and not _EDGE.search(before[-1] + after[0]) and "\n" not in after:
            return self[before] + self.first["\n"] + self.first[after]
        if not _UNSURE.search(piece):
            runs = _RUNS.findall(piece)
            if len(runs) > 1 and all(x.isascii() or self.stays_letters(x) for x in runs):
                return self[runs[0]] + b"".join(map(self.first.__getitem__, runs[1:]))
        return self.encoded(piece)

    def encoded(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids, "<u4").tobytes()

    def normalised(self, piece: str) -> str:
        if self.normalizer is None:
            return piece
        if piece.isascii() or (max(piece) < "\u0250" and "\u0130" not in piece):  # composed, and each letter has one lower-case letter
            return piece.lower()
        return self.normalizer.normalize_str(piece)

    def stays_letters(self, piece: str) -> bool:
        """Whether a piece is letters and nothing else after normalisation too (a dotted capital I isn't)."""
        return piece.isalpha() and self.normalised(piece).isalpha()

    def word(self, piece: str) -> bytes | None:
        """Ids of letters alone: one pre-token, so the tokenizer's model gets it without the steps before."""
        piece = self.normalised(piece)
        if not piece.isalpha():
            return None
        if not piece.isascii():
            piece = charmap_decode(piece.encode(), "strict", _CHARS)[0]
        return array("I", [t.id for t in self.tokenize(self.mark + piece)]).tobytes()


#: Bytes that may begin white space of more than one kind; after a space they are looked at again.
_MAYBE_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: Bytes of a piece that a table's key holds in full; longer pieces are encoded as they come.
KEY_BYTES = 16
#: Bytes of text that are cut into pieces at once.
STRETCH = 1 << 21
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Table:
    """Ids of pieces by their bytes: an open-addressing table that numpy probes for many pieces at once.

    Keys are three longs: a piece's bytes (at most KEY_BYTES), and its length and place; so no two pieces share one."""

    def __init__(self, entries: int):
        self.room, self.used, self.at = entries, 0, 0
        self.shift = np.uint64(64 - (2 * entries - 1).bit_length())
        self.slots = np.full(1 << (2 * entries - 1).bit_length(), -1, np.int32)
        self.keys, self.start, self.size = np.zeros((1024, 3), np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot, mask = (hashes >> self.shift).astype(np.int64), len(self.slots) - 1
        out = self.slots[slot]
        rest = np.flatnonzero(out >= 0)
        rest = rest[(self.keys[out[rest]] != keys[rest]).any(axis=1)]
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            got = self.slots[slot[rest]]
            out[rest] = got
            wrong = got >= 0
            wrong[wrong] = (self.keys[got[wrong]] != keys[rest[wrong]]).any(axis=1)
            rest = rest[wrong]
        return out

    def add(self, keys: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries for distinct keys that aren't in the table."""
        n, total = len(keys), len(ids)
        own = np.arange(self.used, self.used + n)
        self.keys, self.start, self.size = (_grown(x, self.used, self.used + n) for x in (self.keys, self.start, self.size))
        self.ids = _grown(self.ids, self.at, self.at + total)
        self.keys[own], self.size[own] = keys, sizes
        self.start[own] = self.at + np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids[self.at : self.at + total] = ids
        self.used, self.at = self.used + n, self.at + total
        slot, mask, todo = (hashes >> self.shift).astype(np.int64), len(self.slots) - 1, np.arange(n)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = own[free]
            todo = todo[self.slots[slot[todo]] != own[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        return own


def _grown(x: np.ndarray, used: int, need: int) -> np.ndarray:
    if need <= len(x):
        return x
    out = np.zeros((max(need, 2 * len(x)), *x.shape[1:]), x.dtype)
    out[:used] = x[:used]
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at `starts` and are `sizes` long, one after another."""
    sizes = np.asarray(sizes, np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class PieceEncoder:
    """Encodes like tokenizers' `encode(text, add_special_tokens=False)`, many times as fast.

    Both public tokenizers cut a text at white space before anything else. A single space between
    other characters always begins a new pre-token, so the pieces between spaces encode apart from
    each other, as do a word and its closing mark and, around a single line end, two lines; texts with a longer run of
    white space that holds a space are encoded whole. Each worker keeps the ids of pieces in two tables, a young and an old one,
    of TABLE pieces each, whatever the number of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first = _Tail(self.tokenizer, "")
        self.rest = _Tail(self.tokenizer, " ", self.first)
        self.young, self.old = _Table(TABLE), _Table(1)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        if _RUN.search(text) or text.endswith(" "):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (no nulls) one after another, each text's followed by end_id, and how many each text has."""
        data, offsets = raw_bytes(texts)
        ids, sizes, a = [], [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STRETCH, side="right")) - 1)
            own, n = self._stretch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if end_id is not None:
                with_end = np.full(len(own) + len(n), end_id, np.uint32)
                with_end[np.arange(len(own)) + np.repeat(np.arange(len(n)), n)] = own
                own, n = with_end, n + 1
            ids.append(own)
            sizes.append(n)
            a = b
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _stretch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spaces = np.flatnonzero(data == 32)
        starts = np.sort(np.concatenate([offsets[:-1], spaces + 1]), kind="stable")
        ends = np.sort(np.concatenate([spaces, offsets[1:]]), kind="stable")
        firsts = np.arange(len(offsets) - 1) + np.searchsorted(spaces, offsets[:-1])
        lengths = ends - starts
        opens = np.zeros(len(starts), np.uint64)
        opens[firsts] = 1
        padded = np.concatenate([data, np.zeros(KEY_BYTES + 8, np.uint8)])
        words = padded[: len(data) + KEY_BYTES].astype(np.uint64)
        for k in (1, 2, 4):  # eight bytes from each place on
            words[:-k] |= words[k:] << np.uint64(8 * k)
        keys = np.empty((len(starts), 3), np.uint64)
        for k in range(2):
            keys[:, k] = words[starts + 8 * k] & _MASK[np.clip(lengths - 8 * k, 0, 8)]
        del words
        keys[:, 2] = lengths.astype(np.uint64) * np.uint64(2) + opens
        hashes = mix(mix(keys[:, 0] + keys[:, 2] * np.uint64(0x9E3779B97F4A7C15)) ^ keys[:, 1])

        alone = lengths > KEY_BYTES
        docs = np.searchsorted(offsets, spaces[_MAYBE_SPACE[padded[spaces + 1]]], side="right") - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        docs = np.union1d(docs, filled[data[offsets[1:][filled] - 1] == 32])
        whole = {}
        for i in docs.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            if _RUN.search(text) or text.endswith(" "):
                whole[i] = text
        last = np.append(firsts[1:], len(starts))
        for i in whole:
            alone[firsts[i] : last[i]] = True

        start, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = np.flatnonzero(~alone)
        entry, odd = self._entries(data, starts, ends, keys, hashes, at)
        start[at], size[at] = self.young.start[entry], self.young.size[entry]
        for i in odd.tolist():
            alone[i], size[i] = True, 0
        extra, used = [], self.young.at
        for i in whole:
            alone[firsts[i] : last[i]] = False
        for i, own in [(firsts[i], self.whole(t)) for i, t in whole.items()] + [(i, (self.first if opens[i] else self.rest)[data[starts[i] : ends[i]].tobytes().decode()]) for i in np.flatnonzero(alone).tolist()]:
            extra.append(own)
            start[i], size[i] = used, len(own) // 4
            used += len(own) // 4
        ids = self.young.ids[: self.young.at]
        if extra:
            ids = np.concatenate([ids, np.frombuffer(b"".join(extra), "<u4")])
        return ids[spread(start, size)], np.add.reduceat(size, firsts)

    def _entries(self, data, starts, ends, keys, hashes, at) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the young table for the pieces `at`, which are put there if they are new; and pieces whose hash another new piece has."""
        keys, hashes = keys[at], hashes[at]
        entry = self.young.find(keys, hashes)
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return entry, missing
        _, one, group = np.unique(hashes[missing], return_index=True, return_inverse=True)
        one = missing[one]
        odd = missing[(keys[missing] != keys[one[group]]).any(axis=1)]
        if self.young.used + len(one) > self.young.room and self.young.used:
            self.old, self.young = self.young, _Table(max(TABLE, len(starts)))
            return self._entries(data, starts, ends, self._padded(keys, at, len(starts)), self._padded(hashes, at, len(starts)), at)
        kept = self.old.find(keys[one], hashes[one])
        fresh, known = np.flatnonzero(kept < 0), np.flatnonzero(kept >= 0)
        made, raw, tails, place = [], data.tobytes(), (self.rest.parts, self.first.parts), at[one[fresh]]
        for a, b, opens in zip(starts[place].tolist(), ends[place].tolist(), (keys[one[fresh], 2] & np.uint64(1)).tolist()):
            made.append(tails[opens](raw[a:b].decode()))
        new = np.empty(len(one), np.int64)
        new[fresh] = self.young.add(keys[one[fresh]], hashes[one[fresh]], np.array(list(map(len, made)), np.int64) // 4, np.frombuffer(b"".join(made), "<u4"))
        sizes = self.old.size[kept[known]]
        new[known] = self.young.add(keys[one[known]], hashes[one[known]], sizes, self.old.ids[spread(self.old.start[kept[known]], sizes)])
        entry[missing] = new[group]
        return entry, at[odd]

    @staticmethod
    def _padded(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, *x.shape[1:]), x.dtype)
        out[at] = x
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
