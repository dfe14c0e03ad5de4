"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, text_or_empty

#: Characters of the normalised text that enter the sampled splitters, so that these stay short.
PREFIX = 64
_RUNS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("leader", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("head", pa.bool_()), ("edge", pa.string())])


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Find runs of equal neighbours in one sorted partition by comparing whole texts.

    The ids of the run in hand are kept, not its texts. The texts of a partition's first and last run
    come out once each, to be compared with those of the next partition."""
    part = TaskContext.get().partitionId()
    run, ids, text, sha = 0, [], None, None

    def out(ids, run, leader, size, sha, head, edge):
        n = len(ids)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, part, np.int32)), pa.array(run), leader, pa.array(size), sha, pa.array(head), edge], schema=_RUNS)

    def close(last: bool):
        own = pa.concat_arrays(ids)
        n, head = len(own), np.arange(len(own)) == 0
        edge = pa.array([text if run == 0 or last else None] + [None] * (n - 1), pa.string())
        return out(own, np.full(n, run), own.take(pa.array(np.zeros(n, np.int64))), np.full(n, n), pa.array([sha] * n, pa.string()), head, edge)

    for b in batches:
        if not b.num_rows:
            continue
        got, texts = b["id"], b["norm"]
        same = np.zeros(len(got), bool)
        same[1:] = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        same[0] = text is not None and texts[0].as_py() == text
        starts = np.flatnonzero(~same)
        if not len(starts):
            ids.append(got)
            continue
        if text is not None:
            ids.append(got[: starts[0]])
            yield close(False)
            run += 1
        whole, last = starts[:-1], starts[-1]
        if len(whole):
            sizes = np.diff(starts)
            numbers = run + np.arange(len(whole))
            edges = np.zeros(last - starts[0], bool)
            edges[0] = run == 0
            rows = slice(int(starts[0]), int(last))
            edge = pc.if_else(pa.array(edges), texts[rows], pa.scalar(None, pa.string()))
            yield out(got[rows], np.repeat(numbers, sizes), got.take(pa.array(np.repeat(whole, sizes))), np.repeat(sizes, sizes), b["sha"][rows], ~same[rows], edge)
            run += len(whole)
        ids, text, sha = [got[last:]], texts[int(last)].as_py(), b["sha"][int(last)].as_py()
    if text is not None:
        yield close(True)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once each run of ASCII white space is one space; a null text
    counts as empty. The rows are range-partitioned at sampled splitters over (start of the
    normalised text, its digest, id) and sorted; the digest in the middle keeps a text's rows
    adjacent although splitters hold only its start, and the id lets a text that holds a third of
    all rows lie across many partitions. Neighbours are compared in full; runs that meet at a
    partition boundary are joined by one pass over two rows per partition, and a join of their texts where the digests are equal. Exactly one row of a group
    is kept: that of the smallest id; among rows that repeat the id, one of them. Null ids sort
    last and stay null. An empty table gives no rows; other columns are ignored."""
    spark = df.sparkSession
    keyed = df.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    keyed = keyed.select("id", "norm", F.sha2("norm", 256).alias("sha"), F.substring("norm", 1, PREFIX).alias("start"))
    order = [F.col("id").isNull(), F.col("id")]
    dealt = keyed.repartitionByRange(partitions(spark), "start", "sha", *order).sortWithinPartitions("start", "sha", "norm", *order)
    runs = dealt.select("id", "norm", "sha").mapInArrow(_runs, "id long, part int, run long, leader long, size long, sha string, head boolean, edge string")
    runs = materialise(runs, "content-runs")

    # two rows per partition, without their texts: runs at an edge, and the edge run before each with the same digest
    placed = Window.orderBy("part", "run")
    edges = runs.filter(F.col("edge").isNotNull()).select("part", "run", "leader", "size", "sha")
    edges = edges.select("*", F.lag("part").over(placed).alias("part0"), F.lag("run").over(placed).alias("run0"), F.lag("sha").over(placed).alias("sha0"))
    texts = runs.filter(F.col("edge").isNotNull()).select("part", "run", "edge")
    meet = edges.filter(F.col("sha") == F.col("sha0")).select("part", "run", "part0", "run0")
    meet = meet.join(texts, ["part", "run"]).join(texts.select(F.col("part").alias("part0"), F.col("run").alias("run0"), F.col("edge").alias("edge0")), ["part0", "run0"])
    meet = meet.filter(F.col("edge") == F.col("edge0")).select("part", "run", F.lit(True).alias("goes_on"))
    edges = edges.select("part", "run", "leader", "size").join(meet, ["part", "run"], "left")
    edges = edges.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(placed))
    chain = Window.partitionBy("chain")
    first = F.first("leader").over(chain.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = edges.select("part", "run", first.alias("first_id"), F.sum("size").over(chain).alias("whole"), (F.row_number().over(chain.orderBy("part")) == 1).alias("opens"))
    joined = runs.join(F.broadcast(edges), ["part", "run"], "left")  # at most two rows per partition, of numbers only
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("opens").isNull(), F.col("leader")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("head") & F.coalesce("opens", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
