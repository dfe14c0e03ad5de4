"""Shared helpers: durable intermediate tables, distributed ranks and fixed-size sketches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A private one is made only where none is configured and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vantaloom-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
        _OWN[spark.sparkContext.applicationId] = found
    return found


_OWN: dict[str, str] = {}


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    base = _OWN.get(spark.sparkContext.applicationId) or shared_dir(spark)
    return f"{base.rstrip('/')}/vantaloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def null_last(col: str) -> Column:
    """An id as a struct that sorts null ids after all others."""
    return F.struct(F.col(col).isNull().alias("none"), F.col(col).cast("long").alias("id"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `rank` (long, gapless from 0) in the given total order without a single-task sort.

    Sampled range partitions are sorted locally; a row's rank is its partition's base (a running
    sum over one row per partition) plus its place. The sorted table is written first, because range
    boundaries are sampled anew whenever a plan runs again."""
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = placed.join(F.broadcast(bases), "_part")  # one row of two longs per partition
    return ranked.withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).drop("_part", "_at", "_base")


def sum_sketches(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, slices: int = 64) -> np.ndarray:
    """Sum fixed-size count arrays over every row of df.

    `count(batch, array)` adds a batch to its task's array of `size` counters. Arrays travel in
    compressed slices and are summed by slice, so the driver gets `8 * size` bytes whatever the
    input."""
    step = size // slices

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(size, np.int64)
        for b in batches:
            count(b, mine)
        if mine.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "data": [zlib.compress(mine[i * step : (i + 1) * step].tobytes(), 1) for i in range(slices)]})

    return sum_slices(df.mapInArrow(local, "slice int, data binary"), size, np.int64)


def sum_slices(df: DataFrame, size: int, kind) -> np.ndarray:
    """Add up tasks' compressed slices (slice, data) of `size` counters, by slice; the sum reaches the driver."""

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: np.ndarray | int = 0
        for b in batches:
            for x in b["data"]:
                out = out + np.frombuffer(zlib.decompress(x.as_py()), kind).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "data": [zlib.compress(np.asarray(out).tobytes(), 1)]})

    out = np.zeros(size, np.int64)
    for r in df.groupBy("slice").applyInArrow(total, "slice int, data binary").collect():
        part = np.frombuffer(zlib.decompress(r["data"]), np.int64)
        out[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    return out
