"""Datasets of token ids in compressed, checksummed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import decode_block, encode_block
from .common import partitions, table_path, text_or_empty
from .tokens import encoder, tokenizer_path

#: Ids of a block at most; a longer document has blocks of its own.
BLOCK_IDS = 1 << 21
_BLOCKS = "part int, block int, ids_before long, doc_ids array<long>, n_tokens array<long>, whole int, data binary"


def write_token_files(df: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode texts and write their ids, in ascending id order, as a dataset of blocks at path.

    Any Hadoop path does: the container is Parquet, one row per block, and a block is codec.encode_block's
    byte string. Rows are range-partitioned and sorted by id (null ids last; rows that repeat an id
    by text), so that part and block follow the ids. A null or empty text has its end id alone. A
    block holds whole documents, or a stretch of one that is longer than a block: `whole` is then the number of
    its first block. So coding needs a block's memory, however long a text is."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        encode_all = encoder(tokenizer_file).encode_all
        ids, lengths, data, size = [], [], [], 0

        def row(ids, lengths, data, whole):
            nonlocal block, before
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([whole], pa.int32()), pa.array([encode_block(data)], pa.binary())]
            block, before = block + 1, before + len(data)
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "ids_before", "doc_ids", "n_tokens", "whole", "data"])

        for b in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            own, n = encode_all(b["text"], end_id)
            ends = np.cumsum(n)
            for i, length, end in zip(b["id"].to_pylist(), n.tolist(), ends.tolist()):
                if ids and size + length > block_ids:
                    yield row(ids, lengths, np.concatenate(data), None)
                    ids, lengths, data, size = [], [], [], 0
                if length > block_ids:
                    first = block
                    for at in range(end - length, end, block_ids):
                        yield row([i], [min(block_ids, end - at)], own[at : min(at + block_ids, end)], first)
                    continue
                ids.append(i)
                lengths.append(length)
                data.append(own[end - length : end])
                size += length
        if ids:
            yield row(ids, lengths, np.concatenate(data), None)

    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = [F.col("id").isNull(), F.col("id")]
    docs = docs.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order, "text")
    docs.mapInArrow(blocks, _BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dataset of blocks: doc_id, start (ids of all documents before it), n_tokens, tokens (little-endian
    unsigned 32-bit ids). A damaged block raises ValueError."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = decode_block(b["data"][i].as_py()).astype("<u4").tobytes()
                lengths = np.asarray(b["n_tokens"][i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                if 4 * int(ends[-1]) != len(data):
                    raise ValueError("a block holds other ids than its row says")
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                tokens = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                starts = b["ids_before"][i].as_py() + ends - lengths
                of = pa.array([b["whole"][i].as_py()] * len(ends), pa.int32())
                yield pa.RecordBatch.from_arrays([b["doc_ids"][i].values, pa.array(np.full(len(ends), b["part"][i].as_py(), np.int32)), of, pa.array(starts), pa.array(lengths), tokens], names=["doc_id", "part", "whole", "start", "n_tokens", "tokens"])

    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, part int, whole int, start long, n_tokens long, tokens binary"
    out = blocks.filter("whole IS NULL").mapInArrow(documents, schema)
    # stretches of long documents meet again; all others pass by
    long = blocks.filter("whole IS NOT NULL").mapInArrow(documents, schema)
    long = long.groupBy("part", "whole").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "tokens"))).alias("all"))
    long = long.withColumn("tokens", F.aggregate("all.tokens", F.lit(b""), lambda x, y: F.concat(x, y)))
    out = out.unionByName(long.select("doc_id", "part", "whole", "start", "n_tokens", "tokens"))
    out = out.join(F.broadcast(bases), "part")  # one row per written partition
    return out.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "tokens")


def op5_token_files(spark, sf_dir):
    path = table_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
