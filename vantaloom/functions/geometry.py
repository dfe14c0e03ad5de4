"""Boxes, crops, keypoint transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least side of a cropped image, and geometric limits by feature type.
LEAST_SIDE = 50
MATCHER_PRESETS = {
    "usift": {"max_iterations": 50000, "precision_ratio": 0.25, "max_scaling": 5.0, "max_scale_deviation": 0.75, "max_rotation": 0.7853981633974483},
    "sift": {"max_iterations": 50000, "precision_ratio": 0.25, "max_scaling": 5.0, "max_scale_deviation": 0.75, "max_rotation": 6.283185307179586},
    "ahess": {"max_iterations": 50000, "precision_ratio": 0.25, "max_scaling": 5.0, "max_scale_deviation": 0.75, "max_rotation": 6.283185307179586},
}


def matcher_preset(feature_type: str) -> dict:
    """The matcher's limits for a feature type (D12); KeyError for others."""
    return MATCHER_PRESETS[feature_type]


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def rect_intersection(a: Column, b: Column) -> Column:
    """(x, y, w, h) of two such rectangles' intersection, or null; touching edges don't intersect."""
    left, top = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right, bottom = F.least(a["x"] + a["w"], b["x"] + b["w"]), F.least(a["y"] + a["h"], b["y"] + b["h"])
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def crop_rect(width: Column, height: Column, fraction: float) -> Column:
    """The rectangle left when floor(fraction * longer side) is cut from each side; null if a side gets under 50."""
    if fraction < 0:
        raise ValueError("a margin is not negative")
    margin = F.floor(F.lit(fraction) * F.greatest(width, height))
    w, h = width - 2 * margin, height - 2 * margin
    return F.when((w >= LEAST_SIDE) & (h >= LEAST_SIDE), F.struct(margin.alias("x"), margin.alias("y"), w.alias("w"), h.alias("h")))


def crop_rect_or_die(width: Column, height: Column, fraction: float) -> Column:
    """As crop_rect, but a side under 50 is an error."""
    found = crop_rect(width, height, fraction)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("the crop leaves too little")).cast("struct<x:bigint,y:bigint,w:bigint,h:bigint>"))


def crop_box(crop: Column, box: Column) -> Column:
    """A box in a crop's coordinates: origin at least 0, size that of the overlap; null without overlap."""
    both = rect_intersection(crop, box)
    return F.when(both.isNotNull(), F.struct(F.greatest(box["x"] - crop["x"], F.lit(0)).alias("x"), F.greatest(box["y"] - crop["y"], F.lit(0)).alias("y"), both["w"].alias("w"), both["h"].alias("h")))


def envelope(points: Column) -> Column:
    """The bounding box of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon, corners as an array of (x, y) in either direction."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    terms = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def path_length(points: Column) -> Column:
    """Length of a line through an array of (x, y)."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, t: s + t)


def keypoint_transform(a: Column, b: Column) -> Column:
    """Scale and shift that take keypoint a (x, y, radius) to b."""
    scale = b["radius"] / a["radius"]
    return F.struct(scale.alias("scale"), (b["x"] - scale * a["x"]).alias("dx"), (b["y"] - scale * a["y"]).alias("dy"))


def transfer_error(t: Column, a: Column, b: Column) -> Column:
    """Distance between a keypoint moved by a transform and its partner."""
    return F.hypot(t["scale"] * a["x"] + t["dx"] - b["x"], t["scale"] * a["y"] + t["dy"] - b["y"])


def within_limits(scale: Column, feature_type: str, scale_deviation: Column | None = None, rotation: Column | None = None) -> Column:
    """Whether a match's scale change, the deviation of its points' scales and its in-plane rotation (radians, either way) are
    allowed for the feature type (P20)."""
    most = matcher_preset(feature_type)
    out = (scale <= most["max_scaling"]) & (scale >= 1 / most["max_scaling"])
    if scale_deviation is not None:
        out = out & (scale_deviation <= most["max_scale_deviation"])
    return out if rotation is None else out & (F.abs(rotation) <= most["max_rotation"])


def centroid(points: Column) -> Column:
    """Centre of gravity (x, y) of a simple polygon (V31); null for one without area."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda f: F.aggregate(F.zip_with(points, following, f), F.lit(0.0), lambda s, t: s + t)
    twice = total(cross)
    at = lambda c: total(lambda p, q: (p[c] + q[c]) * cross(p, q)) / (3 * twice)
    return F.when(twice != 0, F.struct(at("x").alias("x"), at("y").alias("y")))


def point_within(x: Column, y: Column, points: Column) -> Column:
    """Whether a point lies in a simple polygon, by how often a ray to the right crosses its sides (V31); a border is half inside."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    crosses = F.zip_with(points, following, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def point_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the straight line between two points."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.least(F.greatest(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(a["x"] + along * dx - p["x"], a["y"] + along * dy - p["y"])


def box_union_area(a: Column, b: Column) -> Column:
    """Area that two boxes (x, y, w, h) cover together."""
    both = rect_intersection(a, b)
    return a["w"] * a["h"] + b["w"] * b["h"] - F.coalesce(both["w"] * both["h"], F.lit(0))


def box_difference_area(a: Column, b: Column) -> Column:
    """Area of box a outside box b."""
    both = rect_intersection(a, b)
    return a["w"] * a["h"] - F.coalesce(both["w"] * both["h"], F.lit(0))


def density_per_megapixel(features: Column, width: Column, height: Column) -> Column:
    return features / (width * height / F.lit(1e6))


def interval_within(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether interval a lies in b."""
    return (a1 >= b1) & (a2 <= b2)
