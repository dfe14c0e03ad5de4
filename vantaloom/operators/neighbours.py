"""Nearest neighbours, mutual best matches, radius joins, quantisers."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block: two blocks and their distances are what a task holds.
BLOCK = 2048


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(k: int, metric_same: bool):
    """k nearest base vectors of each query of a pair of blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "base_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        q, b = _matrix(left["v"]), _matrix(right["v"])
        qi, bi = left["id"].to_numpy(), right["id"].to_numpy()
        out = []
        for at in range(0, len(q), 256):
            own = q[at : at + 256]
            d = (own**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * own @ b.T
            if metric_same:
                d[qi[at : at + 256][:, None] == bi[None, :]] = np.inf
            m = min(len(b), k + 8)  # a few more than k: exact distances and ids settle near ties
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            for i, places in enumerate(near):
                exact = ((own[i] - b[places]) ** 2).sum(1)
                exact[np.isinf(d[i, places])] = np.inf
                order = np.lexsort((bi[places], exact))[:k]
                out += [(qi[at + i], bi[places[j]], exact[j]) for j in order if np.isfinite(exact[j])]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "base_id": pa.array(cols[1], pa.int64()), "dist": pa.array(cols[2], pa.float64())})

    return run


def knn_join(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", same: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, base_id, dist, rank): the k nearest base vectors of each query, by squared L2, ties by id. Exact.

    Both sides are cut into blocks of about `block` vectors by a hash of the id; each pair of blocks is a task's
    matrix product, which passes on k rows a query. With `same`, a vector is not its own neighbour. A table of n
    queries and m vectors moves (n m / block) rows; use lsh_candidates where that is too many."""
    nq, nb = max(1, ceil(queries.count() / block)), max(1, ceil(base.count() / block))

    def blocks(df: DataFrame, own: str, other: str, mine: int, others: int) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    q = blocks(queries, "qb", "bb", nq, nb).select("qb", "bb", "id", "v")
    b = blocks(base, "bb", "qb", nb, nq).select("qb", "bb", "id", "v")
    near = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(_nearest(k, same), "query_id long, base_id long, dist double")
    return merge_neighbours(near, k)


def merge_neighbours(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial neighbour lists: the k best rows of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy("dist", "base_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mutual_best(a: DataFrame, b: DataFrame, **columns) -> DataFrame:
    """(a_id, b_id, dist) where each is the other's nearest."""
    there = knn_join(a, b, 1, **columns).select(F.col("query_id").alias("a_id"), F.col("base_id").alias("b_id"), "dist")
    back = knn_join(b, a, 1, **columns).select(F.col("query_id").alias("b_id"), F.col("base_id").alias("a_id"))
    return there.join(back, ["a_id", "b_id"])


def radius_join(a: DataFrame, b: DataFrame, radius: float, id_col: str = "id", same: bool = False) -> DataFrame:
    """(a_id, b_id, dist2) of points (x, y) within radius, by a grid of cells of that width.

    Each point of b goes to the nine cells around it, so the join is an equi-join; with `same`, pairs of one table come
    once (a_id < b_id). Both sides are dealt by cell: the planner's estimate leaves the nine copies out, so it would send
    them all through the driver."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(F.col(id_col).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    right = b.select(F.col(id_col).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(near).alias("d"), cell("x").alias("x0"), cell("y").alias("y0"))
    right = right.select("b_id", "bx", "by", (F.col("x0") + F.col("d.i")).alias("cx"), (F.col("y0") + F.col("d.j")).alias("cy"))
    d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    out = left.hint("merge").join(right.hint("merge"), ["cx", "cy"]).withColumn("dist2", d2).filter(F.col("dist2") <= radius * radius)
    return (out.filter("a_id < b_id") if same else out).select("a_id", "b_id", "dist2")


def _buckets(df: DataFrame, id_col: str, vector_col: str, tables: int, bits: int, seed: int) -> DataFrame:
    """(id, v, codes): each vector's bucket in each table."""
    size = len(df.select(vector_col).filter(F.col(vector_col).isNotNull()).first()[0])
    planes = np.random.default_rng(seed).standard_normal((tables * bits, size))

    def code(batches):
        for b in batches:
            v = np.array([x.as_py() for x in b["v"]], float)
            signs = (v @ planes.T > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(signs.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["id", "v", "codes"])

    rows = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(code, f"id long, v {dict(rows.dtypes)['v']}, codes array<long>")


def lsh_candidates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, bits: int = 12, seed: int = 7) -> DataFrame:
    """Distinct candidate pairs (a_id, b_id) that share a random-hyperplane bucket in any table; measure recall (A20) before use. The
    pairs grow with the square of a bucket: where neighbours are wanted, lsh_neighbours stores none."""
    rows = _buckets(df, id_col, vector_col, tables, bits, seed).select("id", F.posexplode("codes").alias("t", "code"))
    other = rows.select(F.col("id").alias("b_id"), "t", "code")
    return rows.withColumnRenamed("id", "a_id").join(other, ["t", "code"]).filter("a_id < b_id").select("a_id", "b_id").distinct()


def lsh_neighbours(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, bits: int = 12, seed: int = 7, block: int = 2 * BLOCK) -> DataFrame:
    """(query_id, base_id, dist, rank): each vector's k nearest among all that share a bucket with it, the pairs of lsh_candidates.

    Buckets are searched where they lie, and pass on k rows a vector and table; one of over `block` vectors is cut into parts, and each
    pair of parts is a task's. A row moves once a table and part."""
    rows = _buckets(df, id_col, vector_col, tables, bits, seed).filter("id IS NOT NULL").select("id", "v", F.posexplode("codes").alias("t", "code"))
    sizes = rows.groupBy("t", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(sizes, ["t", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("id", "v", "t", "code", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    search = _nearest(k, True)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (table.filter(pc.equal(table["part"], part)) for part in key[2:])
        return search(low, low) if key[2] == key[3] else pa.concat_tables([search(low, high), search(high, low)])

    near = rows.groupBy("t", "code", "low", "high").applyInArrow(run, "query_id long, base_id long, dist double")
    return merge_neighbours(near.groupBy("query_id", "base_id").agg(F.min("dist").alias("dist")), k)


def quantise(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 1) -> DataFrame:
    """(query_id, base_id, dist, rank): each vector's nearest words of a vocabulary."""
    words = centroids.select(F.col("word").alias(id_col), F.col("centroid").alias(vector_col))
    return knn_join(vectors, words, k, id_col, vector_col)


def merge_observations(obs: DataFrame, key: str, vector: str, count: str) -> DataFrame:
    """Weighted mean vector and total count of each key (A6): the fold of running means in closed form."""
    parts = obs.select(key, F.col(count).alias("_n"), F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_n")) / F.sum("_n")).alias("_x"), F.sum("_n").alias("_n"))
    out = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias(vector), F.max("_n").alias(count))
    return out


def centroid_step(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One Lloyd iteration: (word, centroid, count) after assignment."""
    near = quantise(vectors, centroids, id_col, vector_col).select(F.col("query_id").alias(id_col), F.col("base_id").alias("word"))
    obs = near.join(vectors.select(id_col, F.col(vector_col).alias("centroid")), id_col).select("word", "centroid", F.lit(1).cast("long").alias("count"))
    return merge_observations(obs, "word", "centroid", "count")


def retrieval_precision(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of true neighbours among those found, over all queries."""
    hits = truth.join(found.select("query_id", "base_id").withColumn("hit", F.lit(1)), ["query_id", "base_id"], "left")
    return hits.agg((F.sum(F.coalesce("hit", F.lit(0))) / (F.countDistinct("query_id") * F.lit(k))).alias("precision"))


def index_shards(df: DataFrame, shards: int, id_col: str) -> DataFrame:
    """One record per id, dealt to shards; an id that occurs twice is an error."""
    n = F.count("*").over(Window.partitionBy(id_col))
    one = df.withColumn("_ok", F.assert_true(n == 1, F.lit("an id has more than one record"))).filter(F.col("_ok").isNull()).drop("_ok")
    return one.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).repartition(shards, "shard")


def mean_shift(df: DataFrame, group: str, x: str, bandwidth: float, rounds: int = 50) -> DataFrame:
    """(group, x, mode): each number moved to its density's mode with a flat kernel, group by group.

    A group is one task's numbers; sorted running sums make a round n log n."""

    def run(table: pa.Table) -> pa.Table:
        v = np.sort(table[x].to_numpy().astype(float))
        sums = np.concatenate([[0.0], np.cumsum(v)])
        at = v.copy()
        for _ in range(rounds):
            lo, hi = np.searchsorted(v, at - bandwidth, "left"), np.searchsorted(v, at + bandwidth, "right")
            moved = (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
            if np.abs(moved - at).max(initial=0) < 1e-9:
                break
            at = moved
        return pa.table({group: pa.array([table[group][0].as_py()] * len(v)), x: v, "mode": at})

    kind = dict(df.dtypes)[group]
    return df.select(group, F.col(x).cast("double").alias(x)).groupBy(group).applyInArrow(run, f"{group} {kind}, {x} double, mode double")


def solve_linear(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """AX = B by LU decomposition (D31); matrices of driver size."""
    return np.linalg.solve(a, b)
