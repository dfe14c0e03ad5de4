"""Vector expressions on arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance in double precision."""
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def normalised(v: Column, norm: str = "l2") -> Column:
    """A vector over its L1 or L2 norm, or as it is (F13); a zero vector stays zero."""
    if norm == "none":
        return v
    size = total(F.transform(v, lambda x: F.abs(x.cast("double")))) if norm == "l1" else F.sqrt(total(F.transform(v, lambda x: F.pow(x.cast("double"), 2))))
    # the norm beside each element, as a lambda would compute it anew for every one
    return F.zip_with(v, F.array_repeat(size, F.size(v)), lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def root_normalised(v: Column) -> Column:
    """L1 norm, then square roots of magnitudes, signs kept."""
    return F.transform(normalised(v, "l1"), lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def sparse_from_words(words: Column, binarize: bool = True) -> Column:
    """Array of (index, value) of a word list, by rising word, L1-normalised."""
    distinct = F.array_sort(F.array_distinct(words))
    whole = F.array_repeat(F.size(distinct if binarize else words), F.size(distinct))
    if binarize:
        return F.zip_with(distinct, whole, lambda w, n: F.struct(w.alias("index"), (F.lit(1.0) / n).alias("value")))
    return F.zip_with(distinct, whole, lambda w, n: F.struct(w.alias("index"), (F.size(F.filter(words, lambda x: x == w)) / n).alias("value")))


def sorted_sparse(indices: Column, values: Column) -> Column:
    """Parallel arrays as (index, value), by rising index."""
    return F.array_sort(F.zip_with(indices, values, lambda i, v: F.struct(i.alias("index"), v.alias("value"))))


def resized(values: Column, n: int, fill: Column) -> Column:
    """An array cut or filled to n."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), 1, n)


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
