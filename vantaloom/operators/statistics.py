"""Moments, quantiles, rolling statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Count, sum, extremes, population variance, skewness, kurtosis, third raw moment and error of the mean by group."""
    v = F.col(x)
    error = F.sqrt(F.var_pop(v) / F.nullif(F.count(v) - 1, F.lit(0)))
    return df.groupBy(*group).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.var_pop(v).alias("variance"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.avg(F.pow(v, 3)).alias("moment3"), error.alias("mean_error"))


def quantiles(df: DataFrame, group: list[str], x: str, at: list[float]) -> DataFrame:
    """Exact quantiles by group, linear between values (V22); use approx_quantiles on long groups."""
    return df.groupBy(*group).agg(*[F.percentile(x, q).alias(f"q{round(q * 100)}") for q in at])


def approx_quantiles(df: DataFrame, group: list[str], x: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles with bounded memory by group."""
    return df.groupBy(*group).agg(F.percentile_approx(x, at, accuracy).alias("quantiles"))


def rolling(df: DataFrame, group: list[str], order: list[Column], x: str, width: int = 3) -> DataFrame:
    """Rolling count, sum and mean over the last `width` rows."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(width - 1), 0)
    return df.withColumns({"rolling_count": F.count(x).over(w), "rolling_sum": F.sum(x).over(w), "rolling_mean": F.avg(x).over(w)})


def weighted(df: DataFrame, group: list[str], x: str, w: str) -> DataFrame:
    """Weighted sum, mean and second moment by group."""
    return df.groupBy(*group).agg(F.sum(F.col(w) * F.col(x)).alias("weighted_sum"), (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("weighted_mean"), (F.sum(F.col(w) * F.pow(x, 2)) / F.sum(w)).alias("weighted_moment2"))


def histogram(df: DataFrame, x: Column, width: float) -> DataFrame:
    """(bin, count) of equal bins."""
    return df.groupBy(F.floor(x / width).alias("bin")).agg(F.count("*").alias("count"))
