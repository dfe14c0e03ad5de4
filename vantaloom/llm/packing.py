"""Packing documents into fixed-length sequences by first-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import encoder, tokenizer_path

#: Characters of text in a group, on average: one group is packed in one task's memory. A group has under 2**20 sequences.
GROUP_CHARS = 8_000_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long, sequence long, offset long, tokens binary"


class BinTree:
    """Tournament tree over bin capacities: each inner node holds the larger of its children.

    The first bin with room for a piece is found by walking down from the root, to the left child
    whenever its best bin has room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, i, leaves = self.best, 1, self.leaves
        while i < leaves:
            i *= 2
            if best[i] < size:
                i += 1
        found = i - leaves
        best[i] -= size
        while i > 1:
            i //= 2
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size: sizes in falling order, each into the first bin with room."""
    tree = BinTree(max(1, len(sizes)), capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = tree.place(sizes[i])
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group.

    Full sequences are cut off each document's front; first-fit decreasing packs the rests; then the
    emptiest sequences are taken apart, and cut where that fills another to the brim, as long as the
    others have room for all of them. One sequence of a group at most is left with room. Sequences are numbered by
    the first document that has a piece in them, so they follow the order of the documents."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rests, sequence = [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((doc, n - n % capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for rest, b in zip(rests, first_fit_decreasing([x[2] for x in rests], capacity)):
        bins.setdefault(b, []).append(rest)
    used = {b: sum(x[2] for x in own) for b, own in bins.items()}
    order = sorted(bins, key=lambda b: (-used[b], b))
    fewest = -(-sum(used.values()) // capacity)
    holes = [b for b in order[:fewest] if used[b] < capacity]
    for b in order[fewest:]:
        for doc, start, n in bins.pop(b):
            while n:
                to = holes[0]
                take = min(n, capacity - used[to])
                bins[to].append((doc, start, take))
                used[to] += take
                start, n = start + take, n - take
                if used[to] == capacity:
                    holes.pop(0)
    for b in order[:fewest]:
        offset = 0
        for doc, start, n in bins[b]:
            pieces.append((doc, start, n, sequence, offset))
            offset += n
        sequence += 1
    first: dict[int, tuple[int, int]] = {}
    for doc, start, _, b, _ in pieces:
        first[b] = min(first.get(b, (doc, start)), (doc, start))
    number = {b: i for i, b in enumerate(sorted(first, key=first.__getitem__))}
    return [(doc, start, n, number[b], offset) for doc, start, n, b, offset in pieces]


def pack(df: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, group_chars: int = GROUP_CHARS, with_tokens: bool = True, place: tuple[Column, Column] | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, group, sequence, offset, tokens.

    A document is its ids and `end_id`; a null or empty text is its end id alone. Documents fall into
    groups by a seeded hash of id and text, about `group_chars` characters to a group (counted over
    the whole table), so that no source, key or id holds a group by itself; rows that repeat both id and text
    lie in one group. If the table is in a (random) order that is to last, `place` says where a row stands: the number of a part and the
    row's number there. Groups are then neighbouring rows of a part, and groups and sequences are numbered in that
    order. Each group is packed in a task of its own by pack_lengths; sequences of
    different groups are numbered apart. Every id lies in one piece; null ids stay null; an empty
    table gives no rows; other columns are ignored. A text of any length is cut into full sequences, in one task's
    memory. `tokens` are little-endian unsigned 32-bit ids (null if with_tokens is false)."""
    part, row = place or (F.lit(0), F.lit(0))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), part.cast("long").alias("part"), row.cast("long").alias("row"))
    chars, rows = docs.agg(F.sum(F.length("text") + 1), F.count("*")).first()
    groups = max(1, -(-(chars or 0) // group_chars))
    if place:
        group = F.shiftleft("part", 24) + F.floor(F.col("row") / max(1, rows // groups)).cast("long")
    else:
        group = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(groups))

    def one_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_file).encode_all
        ids, places, data = [], [], []
        for b in batches:
            own, n = encode_all(b["text"], end_id)
            ids += b["id"].to_pylist()
            places += b["row"].to_pylist()
            data += np.split(own, np.cumsum(n)[:-1])
        order = sorted(range(len(ids)), key=lambda i: (places[i], ids[i] is None, ids[i] or 0, data[i].tobytes()))  # the same whatever the order of arrival
        packed = pack_lengths([len(data[i]) for i in order], capacity)
        for at in range(0, len(packed), 4096):
            some = packed[at : at + 4096]
            cut = [data[order[d]][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[order[p[0]]] for p in some], pa.int64()),
                    pa.array([p[1] for p in some], pa.int64()),
                    pa.array([p[2] for p in some], pa.int64()),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    pa.array([len(data[order[p[0]]]) for p in some], pa.int64()),
                    pa.array([key[0].as_py()] * len(some), pa.int64()),
                    pa.array([p[3] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()),
                    pa.array(cut if with_tokens else [None] * len(some), pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group", "sequence", "offset", "tokens"],
            )

    return docs.withColumn("group", group).drop("part").groupBy("group").applyInArrow(one_group, _PIECES)


def with_sequence_ids(pieces: DataFrame) -> DataFrame:
    """One number for group and sequence, `sequence_id`; numbers are unique, rise with group and sequence, and have gaps between groups."""
    return pieces.withColumn("sequence_id", F.shiftleft(F.col("group"), 20) + F.col("sequence"))


def op2_pack_sequences(spark, sf_dir):
    out = with_sequence_ids(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), with_tokens=False))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
