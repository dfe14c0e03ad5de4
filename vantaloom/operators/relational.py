"""Projections, filters, joins, grouping and set operations on keyed tables (P, J1-J6, A1-A5, W1-W3, U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a side table may be broadcast, by its plan's estimate.
BROADCAST_BYTES = 64 << 20


def identity(df: DataFrame) -> DataFrame:
    """The rows as they are."""
    return df


def map_or_fail(df: DataFrame, made: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `name` made, rows for which it came out null) of a map that may fail (P5)."""
    tried = df.withColumn(name, made)
    return tried.filter(F.col(name).isNotNull()), tried.filter(F.col(name).isNull()).drop(name)


def combine(df: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Sums by key, formed in each partition before the shuffle and again after it."""
    return df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])


def drop_value(df: DataFrame, *key: str) -> DataFrame:
    """Keys only (P2); the scan then reads no other column."""
    return df.select(*key)


def feature_count(df: DataFrame, id_col: str, descriptors: str, keypoints: str | None = None) -> DataFrame:
    """(id, count) of descriptors; an error if keypoints are another number."""
    n = F.size(descriptors).cast("long")
    if keypoints:
        n = F.when(F.size(descriptors) == F.size(keypoints), n).otherwise(F.raise_error(F.lit("descriptors and keypoints differ in number")).cast("long"))
    return df.select(id_col, n.alias("count"))


def parse_or_count(df: DataFrame, parsed: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value parses, and one row with the number that don't."""
    tried = df.withColumn(name, parsed)
    return tried.filter(F.col(name).isNotNull()), tried.agg(F.count_if(F.col(name).isNull()).alias("failed"))


def label_class(df: DataFrame, kind: str, label_col: str = "label") -> DataFrame:
    """Photos by class: primary (POSITIVE), auxiliary (NONE) or negative (NEGATIVE)."""
    return df.filter(F.col(label_col) == {"primary": "POSITIVE", "aux": "NONE", "neg": "NEGATIVE"}[kind])


def ignore_ids(df: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the ignored."""
    return df.join(ignored.select(key).distinct(), key, "left_anti")


def members(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the wanted: exact, with Spark's own bloom filter ahead of large scans."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def map_join(primary: DataFrame, secondary: DataFrame, key: list[str], unique_primary: bool = False) -> DataFrame:
    """Inner join on key (J1-J3). Tables bucketed by it join without a shuffle. With unique_primary, a primary key
    that occurs twice is an error."""
    if unique_primary:
        n = F.count("*").over(Window.partitionBy(*key))
        primary = primary.withColumn("_n", n)
        primary = primary.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("a primary key occurs twice"))).filter(F.col("_ok").isNull()).drop("_n", "_ok")
    return primary.join(secondary, key, "inner")


def save_bucketed(df: DataFrame, table: str, key: list[str], buckets: int) -> None:
    """A bucketed and sorted table: later joins of such tables on key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)


def plan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(df: DataFrame, side: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Join a side table (J4, J5, J12): broadcast if its estimated size is under BROADCAST_BYTES, else as Spark finds best."""
    return df.join(F.broadcast(side) if plan_bytes(side) <= BROADCAST_BYTES else side, key, how)


def replicate(df: DataFrame, parts: int) -> DataFrame:
    """Each row once for each of parts partitions, numbered `part`."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")


def find_duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with the count."""
    return df.groupBy(*key).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def at_most_once(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given total order (A2, U2). A minimum per key is formed before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ranks = [f"_r{i}" for i in range(len(order))]
    first = df.withColumns(dict(zip(ranks, order))).groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*ranks)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def group_sort(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order within partitions."""
    return df.repartition(*key).sortWithinPartitions(*key, *order)


def prefix_group(df: DataFrame, key: str, prefix: int, value: Column) -> DataFrame:
    """Groups by the first `prefix` characters or bytes of a key, values in key order (A5)."""
    return df.groupBy(F.substring(key, 1, prefix).alias("prefix")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]).alias("ordered_values"), F.count("*").alias("count"))


def order_by_score(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Global order by falling score (P4, W1, D14); ties by another column."""
    return df.orderBy(F.desc(score), tie)


def order_by_rank(df: DataFrame, rank: str, tie: str) -> DataFrame:
    """Global order by rising rank."""
    return df.orderBy(rank, tie)


def global_top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of an order (W4, W10): each partition passes on n at most."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def batches(df: DataFrame, size: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Work units of at most `size` rows, numbered `batch` within each group (W7). Without groups, range partitions are numbered
    through, so no task sees the whole table."""
    if within:
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        return df.withColumn("batch", F.floor((place - 1) / size).cast("long"))
    from .graph import cut_lineage

    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))  # two numbers a partition
    rank = F.col("_base") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return placed.join(bases, "_part").withColumn("batch", F.floor(rank / size).cast("long")).drop("_part", "_at", "_base")
