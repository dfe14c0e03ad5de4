"""Indexes that are created, added to, saved, loaded and queried: words and descriptors."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.operators.neighbours import merge_neighbours

WEIGHTS, NORMS, DISTANCES = ("binary", "tf", "tfidf"), ("none", "l1", "l2"), ("dot", "l1", "l2")


def _checked(value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{value} is none of {known}")
    return value


class WordIndex:
    """Postings (id, word, tf) at a path, by choice of weight, norm and distance.

    Additions are files of their own, so any number of writers may add at once and queries see what is written."""

    def __init__(self, spark: SparkSession, path: str, weight: str = "tfidf", norm: str = "l2", distance: str = "dot"):
        self.spark, self.path = spark, path
        self.weight, self.norm, self.distance = _checked(weight, WEIGHTS), _checked(norm, NORMS), _checked(distance, DISTANCES)

    def add(self, postings: DataFrame) -> None:
        """Write postings, by word, so that a query reads the row groups of its words."""
        postings.select("id", "word", F.col("tf").cast("long").alias("tf")).repartition("word").sortWithinPartitions("word", "id").write.mode("append").parquet(self.path)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def save(self, path: str) -> None:
        self.postings().write.parquet(path)

    def _weighted(self, postings: DataFrame, frequencies: DataFrame | None, documents: int) -> DataFrame:
        """(id, word, w): raw weights over their norm."""
        w = F.lit(1.0) if self.weight == "binary" else F.col("tf").cast("double")
        if self.weight == "tfidf":
            postings = postings.join(frequencies, "word")
            w = w * F.log(F.lit(float(max(documents, 1))) / F.col("df"))
        rows = postings.select("id", "word", w.alias("w"))
        if self.norm == "none":
            return rows
        size = F.sum(F.abs("w")) if self.norm == "l1" else F.sqrt(F.sum(F.pow("w", 2)))
        return rows.join(rows.groupBy("id").agg(size.alias("size")), "id").select("id", "word", F.when(F.col("size") > 0, F.col("w") / F.col("size")).otherwise(0.0).alias("w"))

    def query(self, queries: DataFrame, top: int) -> DataFrame:
        """(query_id, id, score, rank): the `top` best documents that share a word, by the dot product or the smaller distance (shown as a
        negative score), ties by id. Queries are postings as well."""
        whole = self.postings()
        frequencies = whole.groupBy("word").agg(F.countDistinct("id").alias("df")) if self.weight == "tfidf" else None
        documents = whole.select("id").distinct().count() if self.weight == "tfidf" else 1
        index = self._weighted(whole, frequencies, documents)
        asked = self._weighted(queries.select("id", "word", "tf"), frequencies, documents).select(F.col("id").alias("query_id"), "word", F.col("w").alias("q"))
        both = asked.join(index, "word")
        if self.distance == "dot":
            scores = both.groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
        else:
            # |q - w| = |q| + |w| - what the shared words save
            power = F.abs if self.distance == "l1" else (lambda c: F.pow(c, 2))
            saved = power(F.col("q")) + power(F.col("w")) - power(F.col("q") - F.col("w"))
            scores = both.groupBy("query_id", "id").agg(F.sum(saved).alias("saved"))
            scores = scores.join(asked.groupBy("query_id").agg(F.sum(power(F.col("q"))).alias("a")), "query_id").join(index.groupBy("id").agg(F.sum(power(F.col("w"))).alias("b")), "id")
            gap = F.greatest(F.col("a") + F.col("b") - F.col("saved"), F.lit(0.0))
            scores = scores.select("query_id", "id", (-(gap if self.distance == "l1" else F.sqrt(gap))).alias("score"))
        found = scores.withColumn("dist", -F.round("score", 9)).withColumnRenamed("id", "base_id")
        return merge_neighbours(found, top).select("query_id", F.col("base_id").alias("id"), "score", "rank")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


class VectorIndex:
    """Vectors dealt to cells around centres: a query looks into its nearest `probes` cells only.

    The centres are fitted on at most `sample` vectors, which is what the driver holds; every vector is indexed.
    Measure recall with retrieval_precision against knn_join, and let probes_for raise `probes` to reach what is wanted; with
    all cells probed the search is exact."""

    def __init__(self, cells: DataFrame, centres: np.ndarray):
        self.cells, self.centres = cells, centres

    @staticmethod
    def create(df: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, rounds: int = 10, seed: int = 7) -> VectorIndex:
        """Fit centres by Lloyd rounds and assign each vector to its nearest. Null ids and vectors aren't indexed."""
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
        n = rows.count()
        cells = cells or max(1, min(4096, ceil(n**0.5)))
        taken = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("v").collect()], float)
        if not len(taken):
            return VectorIndex(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)))
        centres = taken[: min(cells, len(taken))].copy()
        for _ in range(rounds):
            near = _distances(taken, centres).argmin(1)
            sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
            np.add.at(sums, near, taken)
            filled = counts > 0
            centres[filled] = sums[filled] / counts[filled, None]
        return VectorIndex(_dealt(rows, centres, 1), centres)

    def save(self, path: str) -> None:
        """Vectors by cell, so that a probe reads its cells' files, and the centres beside them."""
        self.cells.write.partitionBy("cell").parquet(f"{path}/cells")
        self.cells.sparkSession.createDataFrame([(c.tolist(),) for c in self.centres], "centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").collect()], float)  # as many as cells
        return VectorIndex(spark.read.parquet(f"{path}/cells").select("id", "v", F.col("cell").cast("int").alias("cell")), centres)

    def probes_for(self, queries: DataFrame, truth: DataFrame, recall: float, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """The fewest probes whose cells hold the share `recall` of true neighbours (query_id, base_id), or all cells. The driver gets a
        number a cell."""
        cells = truth.join(self.cells.select(F.col("id").alias("base_id"), "cell"), "base_id").groupBy(F.col("query_id").alias("id")).agg(F.collect_list("cell").alias("cells"))
        rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL").join(cells, "id").select("v", "cells")
        centres = self.centres

        def run(batches):
            for b in batches:
                if b.num_rows:
                    order = np.argsort(_distances(np.array(b["v"].to_pylist(), float), centres), axis=1, kind="stable")
                    places = np.argsort(order, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([int(p) for own, at in zip(places, b["cells"].to_pylist()) for p in own[at]], pa.int32())], names=["place"])

        wanted, held = recall * truth.count(), 0
        for place, n in sorted(map(tuple, rows.mapInArrow(run, "place int").groupBy("place").count().collect())):
            held += n
            if held >= wanted:
                return place + 1
        return len(centres)

    def query(self, queries: DataFrame, k: int, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", same: bool = False, block: int = 2048) -> DataFrame:
        """(query_id, base_id, dist, rank): the k nearest of the probed cells, by squared L2, ties by id. A cell is cut into blocks of
        `block` vectors, so a crowded one is no single task."""
        asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
        asked = _dealt(asked, self.centres, probes)
        sizes = self.cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        base = self.cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("cell", "part", "id", "v")
        chunks = max(1, ceil(queries.count() / (64 * block)))  # each chunk of queries meets a block once
        asked = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        base = base.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        key = ["cell", "part", "chunk"]
        near = asked.select(*key, "id", "v").groupBy(*key).cogroup(base.select(*key, "id", "v").groupBy(*key)).applyInArrow(_cell_search(k, same), "query_id long, base_id long, dist double")
        return merge_neighbours(near, k)


def _dealt(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, v, cell): each vector once for each of its nearest `probes` centres."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b["v"].to_pylist(), float)
            near = np.argsort(_distances(v, centres), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(v)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b["id"].take(at), b["v"].take(at), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    kind = dict(rows.dtypes)["v"]
    return rows.select("id", "v").mapInArrow(run, f"id long, v {kind}, cell int")


def _cell_search(k: int, same: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, b = np.array(left["v"].to_pylist(), float), np.array(right["v"].to_pylist(), float)
            qi, bi = left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(q), 256):
                for i, row in zip(qi[at : at + 256], _distances(q[at : at + 256], b)):
                    row = np.where(bi == i, np.inf, row) if same else row
                    order = np.lexsort((bi, row))[:k]
                    out += [(i, bi[j], max(row[j], 0.0)) for j in order if np.isfinite(row[j])]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "base_id": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    return run


def weighted_distance(a: Column, b: Column, distance: str) -> Column:
    """Distance (or dot product) of two dense vectors of doubles, by name."""
    _checked(distance, DISTANCES)
    if distance == "dot":
        terms = F.zip_with(a, b, lambda x, y: x * y)
    else:
        terms = F.zip_with(a, b, lambda x, y: F.abs(x - y) if distance == "l1" else F.pow(x - y, 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.sqrt(total) if distance == "l2" else total
