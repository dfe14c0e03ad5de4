"""Bloom filters as tables of 64-bit words: sizing, tuning, building, probing, measured error."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def required_bits(keys: int, error: float) -> int:
    """Bits of a filter for so many keys at an error rate, by the formula for the best number of hashes."""
    return max(64, ceil(-keys * log(error) / log(2) ** 2))


def best_hashes(keys: int, bits: int) -> int:
    return max(1, round(bits / max(keys, 1) * log(2)))


def expected_error(keys: int, bits: int, hashes: int) -> float:
    return (1 - exp(-hashes * keys / bits)) ** hashes


@dataclass(frozen=True)
class Bloom:
    """A filter: `words` has a row (word, bits) for each 64-bit word with a bit set. It grows with the keys, as a table does."""

    words: DataFrame
    bits: int
    hashes: int

    def save(self, path: str) -> None:
        self.words.withColumns({"size": F.lit(self.bits), "hashes": F.lit(self.hashes)}).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bloom:
        """A saved filter; ValueError if it was saved without keys."""
        table = spark.read.parquet(path)
        told = table.select("size", "hashes").first()
        if told is None:
            raise ValueError(f"{path} holds an empty filter")
        return Bloom(table.select("word", "bits"), told["size"], told["hashes"])


def _places(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: a hash of its text for each number."""
    text = key.cast("string")
    return F.array(*[F.pmod(F.xxhash64(text, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def build(keys: DataFrame, key: str, error: float = 0.01, capacity: int | None = None, bits: int | None = None) -> Bloom:
    """A filter of the keys (nulls aside) for `capacity` of them (default: their count). Words are combined before the shuffle."""
    known = keys.select(F.col(key).alias("key")).filter("key IS NOT NULL")
    n = capacity or max(1, known.distinct().count())
    bits = bits or required_bits(n, error)
    hashes = best_hashes(n, bits)
    at = known.select(F.explode(_places(F.col("key"), bits, hashes)).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return Bloom(at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")), bits, hashes)


def probably_contains(df: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """The rows whose key the filter may hold: all that it holds, and some others at the filter's error rate. Null keys go.

    Each distinct key asks for its words by an equi-join; keys of which all bits are set join the rows again."""
    asked = df.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    asked = asked.select("key", F.explode(F.array_distinct(_places(F.col("key"), bloom.bits, bloom.hashes))).alias("at"))
    asked = asked.select("key", F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("one"))
    found = asked.join(bloom.words, "word", "left").groupBy("key").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("one")) != 0, F.lit(False))).alias("hit"))
    return df.join(found.filter("hit").select(F.col("key").alias(key)), key, "left_semi")


def measured_error(absent: DataFrame, key: str, bloom: Bloom) -> float:
    """The share of keys that aren't in the filter which it says it may hold."""
    asked = absent.select(key).filter(F.col(key).isNotNull()).distinct()
    return probably_contains(asked, key, bloom).count() / max(1, asked.count())


def tuned_bits(keys: DataFrame, absent: DataFrame, key: str, error: float, most: int = 8) -> int:
    """The least number of bits, in steps of a tenth from the formula's on, whose measured error is no more than `error`; ValueError after `most` steps."""
    n = max(1, keys.select(key).distinct().count())
    bits = required_bits(n, error)
    for _ in range(most):
        if measured_error(absent, key, build(keys, key, error, n, bits)) <= error:
            return bits
        bits = ceil(bits * 1.1)
    raise ValueError("no size reached the error rate")
