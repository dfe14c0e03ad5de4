"""Image matching over supplied features, correspondences, tuning, patterns, task pools."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vantaloom.functions.geometry import matcher_preset
from vantaloom.operators.graph import both_ways

_MATCH = "image_a long, image_b long, candidates long, matches long, scale double, dx double, dy double"


def _consensus(a: np.ndarray, b: np.ndarray, tolerance: float, most_scale: float) -> tuple[int, float, float, float]:
    """The scale and shift, taken from one pair of keypoints, that carries most of a's keypoints on to b's."""
    best = (0, 1.0, 0.0, 0.0)
    for i in range(len(a)):
        scale = b[i, 2] / a[i, 2] if a[i, 2] > 0 else 0.0
        if not 1 / most_scale <= scale <= most_scale:
            continue
        shift = b[i, :2] - scale * a[i, :2]
        off = np.hypot(*(scale * a[:, :2] + shift - b[:, :2]).T)
        n = int((off <= tolerance).sum())
        if n > best[0]:
            best = (n, float(scale), float(shift[0]), float(shift[1]))
    return best


def match_images(pairs: DataFrame, features: DataFrame, feature_type: str = "usift", tolerance: float = 4.0) -> DataFrame:
    """(image_a, image_b, candidates, matches, scale, dx, dy) of each pair (D11; our method, not AC-RANSAC).

    features: image_id, keypoints array<struct<x,y,radius>>, descriptors array<array<double>>. Candidates are mutual
    nearest descriptors; matches agree on one scale and shift within the feature type's scale limit. A pair is
    one row of two feature lists, so tasks hold a batch of pairs."""
    most = matcher_preset(feature_type)["max_scaling"]
    side = lambda s: features.select(F.col("image_id").alias(f"image_{s}"), F.col("keypoints").alias(f"k{s}"), F.col("descriptors").alias(f"d{s}"))
    rows = pairs.select(F.col("src").alias("image_a"), F.col("dst").alias("image_b")).join(side("a"), "image_a").join(side("b"), "image_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = (0, 0, 1.0, 0.0, 0.0)
                if r["da"] and r["db"]:
                    x, y = np.array(r["da"], float), np.array(r["db"], float)
                    d = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
                    there, back = d.argmin(1), d.argmin(0)
                    own = np.flatnonzero(back[there] == np.arange(len(x)))
                    k = lambda v, at: np.array([[v[i]["x"], v[i]["y"], v[i]["radius"]] for i in at], float)
                    found = (len(own), *_consensus(k(r["ka"], own), k(r["kb"], there[own]), tolerance, most))
                out.append((r["image_a"], r["image_b"], *found))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["image_a", "image_b", "candidates", "matches", "scale", "dx", "dy"])

    return rows.select("image_a", "image_b", "ka", "da", "kb", "db").mapInArrow(run, _MATCH)


def independent(matches: DataFrame, pair: list[str], score: str, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): of correspondences (xa, ya, xb, yb) of a pair that share a cell in either image, the best stays."""
    order = [F.desc(score), F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")]
    at = lambda s: [F.floor(F.col(f"x{s}") / cell), F.floor(F.col(f"y{s}") / cell)]
    ranked = matches.withColumn("_a", F.row_number().over(Window.partitionBy(*pair, *at("a")).orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy(*pair, *at("b")).orderBy(*order)))
    good = (F.col("_a") == 1) & (F.col("_b") == 1)
    return ranked.filter(good).select(*matches.columns), ranked.filter(~good).select(*matches.columns)


def tune_threshold(values: DataFrame, score: str, megapixels: Column, target: float, rounds: int = 30) -> float:
    """The threshold at which features per megapixel come nearest to target (D3): bisection over one aggregate a round."""
    low, high, area = values.agg(F.min(score), F.max(score), F.max(megapixels)).first()
    for _ in range(rounds):
        middle = (low + high) / 2
        if values.filter(F.col(score) >= middle).count() / area > target:
            low = middle
        else:
            high = middle
    return high


def subgraph_matches(edges: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """All ways to lay a connected pattern's vertices on distinct vertices, columns v0, v1, ... (V15), by one join an edge."""
    both, out, bound = both_ways(edges).filter("src <> dst"), None, []
    for i, j in pattern:
        if out is not None and i not in bound:
            i, j = j, i
        e = both.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{j}"))
        if out is None:
            out, bound = e, [i, j]
        elif j in bound:
            out = out.join(e, [f"v{i}", f"v{j}"], "left_semi")
        else:
            out = out.join(e, f"v{i}").filter(~F.col(f"v{j}").isin(*[F.col(f"v{k}") for k in bound]))
            bound.append(j)
    return out


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and named counters that are filled when they are read."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def run_tasks(tasks: Iterable[Callable[[], object]], threads: int = 4) -> Iterator[object]:
    """Results of driver-side tasks (Spark jobs, say) as they complete."""
    with ThreadPoolExecutor(threads) as pool:
        for done in as_completed([pool.submit(t) for t in tasks]):
            yield done.result()
