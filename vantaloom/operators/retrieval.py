"""Bags of words, inverted indexes and query scoring."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters a to z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bag_of_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings (id, word, tf)."""
    return df.select(F.col(id_col).alias("id"), F.explode(words_of(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))


def l1_vectors(postings: DataFrame, binarize: bool = True) -> DataFrame:
    """(id, word, weight): each document's words over their sum."""
    value = F.lit(1.0) if binarize else F.col("tf").cast("double")
    sums = postings.groupBy("id").agg(F.sum(value).alias("_sum"))
    return postings.join(sums, "id").select("id", "word", (value / F.col("_sum")).alias("weight"))


def tfidf(postings: DataFrame, documents: int) -> DataFrame:
    """(id, word, weight): tf * ln(N / df), over its L2 norm."""
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    w = postings.join(df, "word").select("id", "word", (F.col("tf") * F.log(F.lit(float(documents)) / F.col("df"))).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.pow("w", 2))).alias("norm"))
    return w.join(norm, "id").select("id", "word", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


def inverted_query(index: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, id, score, rank): the `top` documents of each query by the dot product of weights.

    Both sides are (id, word, weight); the join is on words, and scores are summed before they are ranked."""
    q = queries.select(F.col("id").alias("query_id"), "word", F.col("weight").alias("qw"))
    scores = q.join(index, "word").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def vote_scores(neighbours: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, id, score): votes of neighbour rows (query_id, id) over the candidate's feature count (D10; our formula)."""
    votes = neighbours.groupBy("query_id", "id").agg(F.count("*").alias("votes"))
    return votes.join(counts, "id").select("query_id", "id", (F.col("votes") / F.col("count")).alias("score"))


def bloom_bits(keys: int, error: float) -> int:
    """Bits of a bloom filter for so many keys at an error rate."""
    return int(-keys * log(error) / log(2) ** 2 + 0.999999)


def bloom_error(keys: int, bits: int, hashes: int) -> float:
    """Expected error rate of a bloom filter."""
    from math import exp

    return (1 - exp(-hashes * keys / bits)) ** hashes
