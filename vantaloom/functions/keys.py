"""Keys, hashes and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint64_to_key(c: Column) -> Column:
    """A long as 8 big-endian bytes, whose order is the unsigned order of numbers (F1)."""
    return F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex"))


def key_to_uint64(c: Column) -> Column:
    """The unsigned number of an 8-byte key, as a decimal (F1)."""
    return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")


def double_to_key(c: Column) -> Column:
    """A text in the order of doubles, negative ones and infinities included (F2); NaN comes last, -0.0 equals 0.0.

    Sign, exponent and all digits of the shortest decimal, which tells any two doubles apart; those of a negative number are
    complemented, so that a smaller number has the smaller text."""
    x = c.cast("double")
    text = F.format_string("%.17e", F.abs(x))
    digits = F.rpad(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), 18, "0")
    exponent = F.lpad((F.substring_index(text, "e", -1).cast("int") + 400).cast("string"), 3, "0")
    size = F.when(x == 0, F.lit("0" * 21)).otherwise(F.concat(exponent, digits))
    finite = F.when(x < 0, F.concat(F.lit("1"), F.translate(size, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("2"), size))
    return F.when(F.isnan(x), "4").when(x == float("inf"), "3").when(x == float("-inf"), "0").otherwise(finite)


def edge_key(a: Column, b: Column) -> Column:
    """16 bytes of an undirected edge: the smaller id first, so both directions agree."""
    return F.concat(uint64_to_key(F.least(a, b)), uint64_to_key(F.greatest(a, b)))


def parse_edge_key(key: Column) -> Column:
    """(src, dst) of an edge key; a key that isn't 16 bytes long is an error."""
    whole = F.when(F.octet_length(key) == 16, key).otherwise(F.raise_error(F.lit("an edge key has 16 bytes")).cast("binary"))
    part = lambda at: key_to_uint64(F.substring(whole, at, 8)).cast("long")
    return F.struct(part(1).alias("src"), part(9).alias("dst"))


def shard_of(key: Column, shards: int, salt: str = "") -> Column:
    """A shard in 0..shards-1 by a salted digest of the key's text."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(shards))


def fast_shard_of(key: Column, shards: int, salt: str = "") -> Column:
    """As shard_of, by Spark's own 64-bit hash: the same contract, other shards."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(shards))


def digest(c: Column) -> Column:
    """MD5 in lower-case hexadecimal."""
    return F.md5(c)


def padded(c: Column, width: int = 5) -> Column:
    """A number with leading zeros."""
    return F.lpad(c.cast("string"), width, "0")


def leading_number(c: Column, default: int = 0) -> Column:
    """The unsigned number a text begins with, or a default."""
    return F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("long"), F.lit(default))
