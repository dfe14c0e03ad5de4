"""Labelled datasets, trials, decisions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def photos_of(objects: DataFrame) -> DataFrame:
    """(object_id, photo_id, label, regions), one row per photo of each object."""
    p = objects.select(F.col("id").alias("object_id"), F.explode("photos").alias("p"))
    return p.select("object_id", F.col("p.id").alias("photo_id"), F.col("p.label").alias("label"), F.col("p.regions").alias("regions"))


def object_of(photos: DataFrame, images: DataFrame) -> DataFrame:
    """Each image's object; auxiliary and negative photos have theirs too."""
    return images.join(photos.select("photo_id", "object_id"), "photo_id", "left")


def trial(positives: DataFrame, train: int, test: int = 100, class_col: str = "label", id_col: str = "id", seed: str = "0") -> DataFrame:
    """(id, label, split): per class `train` training and min(test, rest) test items by a seeded hash; others are left out."""
    order = Window.partitionBy(class_col).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), id_col)
    ranked = positives.withColumn("_n", F.row_number().over(order))
    split = F.when(F.col("_n") <= train, "train").when(F.col("_n") <= train + test, "test")
    return ranked.select(F.col(id_col).alias("id"), F.col(class_col).alias("label"), split.alias("split")).filter(F.col("split").isNotNull())


def write_dataset(objects: DataFrame, path: str) -> None:
    """Objects (id, name, photos) as a table; an id that occurs twice, or a photo in two objects, is an error."""
    from .relational import find_duplicates

    if not find_duplicates(objects, "id").isEmpty() or not find_duplicates(photos_of(objects).select("object_id", "photo_id").distinct(), "photo_id").isEmpty():
        raise ValueError("an object's or photo's id occurs twice")
    objects.write.mode("errorifexists").parquet(path)


def trial_with_aux(photos: DataFrame, train: int, frac_aux: float, test: int = 100, seed: str = "0") -> DataFrame:
    """(split, photo_id, object_id): per object `train` training photos and min(test, rest) test photos of its positives, and the
    fraction frac_aux of its auxiliary (unlabelled) photos, rounded, by a seeded hash (D26).

    photos: object_id, photo_id, label as of photos_of. ValueError unless 0 <= frac_aux <= 1."""
    if not 0 <= frac_aux <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    order = Window.partitionBy("object_id", "label").orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("photo_id").cast("string"))), "photo_id")
    ranked = photos.withColumns({"_n": F.row_number().over(order), "_of": F.count("*").over(Window.partitionBy("object_id", "label"))})
    split = F.when((F.col("label") == "POSITIVE") & (F.col("_n") <= train), "train").when((F.col("label") == "POSITIVE") & (F.col("_n") <= train + test), "test")
    split = split.when((F.col("label") == "NONE") & (F.col("_n") <= F.round(F.col("_of") * frac_aux)), "aux")
    return ranked.select(split.alias("split"), "photo_id", "object_id").filter(F.col("split").isNotNull())


def best_label(scores: DataFrame, threshold: float, uniqueness: float, default: object) -> DataFrame:
    """(id, label): the best label if its score is at least threshold and `uniqueness` orders of magnitude over the second,
    else the default (P12)."""
    ranked = scores.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("label")).alias("l"))), asc=False), 1, 2).alias("top"))
    best, second = F.col("top")[0], F.try_element_at("top", F.lit(2))
    unique = second.isNull() | (best["score"] >= second["score"] * F.pow(F.lit(10.0), F.lit(uniqueness)))
    return ranked.select("id", F.when((best["score"] >= threshold) & unique, -best["l"]).otherwise(F.lit(default)).alias("label"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(actual, predicted, count)."""
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("count"))


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """(1 + b^2) p r / (b^2 p + r + 1e-16)."""
    return (1 + beta**2) * precision * recall / (F.lit(beta**2) * precision + recall + 1e-16)


def precision_recall(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """(label, precision, recall, f) of each actual or predicted label (A10, A11); 0 where a label has no predictions or items."""
    cells = pairs.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("actual") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    sums = cells.groupBy("label").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    out = sums.select("label", F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(0.0).alias("precision"), F.when(F.col("a") > 0, F.col("hit") / F.col("a")).otherwise(0.0).alias("recall"))
    return out.withColumn("f", f_score(F.col("precision"), F.col("recall"), beta))


def mean_std(df: DataFrame, group: list[str], *values: str) -> DataFrame:
    """Mean and population standard deviation of columns by group."""
    aggs = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))]
    return df.groupBy(*group).agg(F.count("*").alias("count"), *aggs)


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """(label, count)."""
    return df.groupBy(label).agg(F.count("*").alias("count"))


def area_stats(boxes: DataFrame, class_col: str, image_area: int = 640 * 480) -> DataFrame:
    """Per class: boxes, mean and population deviation of areas, mean over image area; by rising mean."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    out = boxes.groupBy(class_col).agg(F.count("*").alias("count"), F.avg(area).alias("mean_area"), F.stddev_pop(area).alias("std_area"))
    return out.withColumn("mean_share", F.col("mean_area") / image_area).orderBy("mean_area")


def mean_image(pixels: DataFrame, group: list[str], place: list[str], value: str) -> DataFrame:
    """Mean of each pixel over images."""
    return pixels.groupBy(*group, *place).agg(F.avg(value).alias("mean"))


def image_predictions(region_scores: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, label, score): the best region's score of each label."""
    return region_scores.join(regions.select(F.col("region_id").alias("id"), "image_id"), "id").groupBy("image_id", "label").agg(F.max("score").alias("score"))


def region_seeds(regions: DataFrame, split: DataFrame, mode: str) -> DataFrame:
    """(id, label): training labels of regions (D23). In `detection` all regions of a training image have its label; in
    `localisation` only those marked as the object's (true_region), and the others are labelled as background, -1.

    regions: region_id, image_id, true_region; split: id (of images), label, split."""
    if mode not in ("detection", "localisation"):
        raise ValueError(f"no supervision mode: {mode}")
    known = regions.join(split.filter("split = 'train'").select(F.col("id").alias("image_id"), "label"), "image_id")
    label = F.col("label") if mode == "detection" else F.when(F.col("true_region"), F.col("label")).otherwise(-1)
    return known.select(F.col("region_id").alias("id"), label.alias("label"))


def region_overlap_edges(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(truth_id, region_id, overlap): pairs of one image whose boxes share an area, with it.

    Both: region_id, image_id, x, y, w, h. The join is on the image; boxes that only touch share nothing."""
    box = lambda s: {c: f"{c}_{s}" for c in ("region_id", "x", "y", "w", "h")}
    both = truth.withColumnsRenamed(box("t")).join(found.withColumnsRenamed(box("f")), "image_id")
    w = F.least(F.col("x_t") + F.col("w_t"), F.col("x_f") + F.col("w_f")) - F.greatest("x_t", "x_f")
    h = F.least(F.col("y_t") + F.col("h_t"), F.col("y_f") + F.col("h_f")) - F.greatest("y_t", "y_f")
    return both.withColumns({"_w": w, "_h": h}).filter("_w > 0 AND _h > 0").select(F.col("region_id_t").alias("truth_id"), F.col("region_id_f").alias("region_id"), (F.col("_w") * F.col("_h")).alias("overlap"))


def compare_results(a: DataFrame, b: DataFrame, beta: float = 1.0) -> DataFrame:
    """Two results (trial, precision, recall) side by side with their F-scores."""
    side = lambda df, s: df.select("trial", *[F.col(c).alias(f"{c}_{s}") for c in ("precision", "recall")], f_score(F.col("precision"), F.col("recall"), beta).alias(f"f_{s}"))
    return side(a, "a").join(side(b, "b"), "trial")


def evaluate_propagation(edges: DataFrame, split: DataFrame, rounds: int, threshold: float = 0.0, default: int = -1) -> DataFrame:
    """(id, actual, predicted) of test items after propagating the training labels."""
    from .graph import propagate_labels

    seeds = split.filter("split = 'train'").select("id", "label")
    found = best_label(propagate_labels(edges, seeds, rounds), threshold, 0.0, default)
    test = split.filter("split = 'test'").select("id", F.col("label").alias("actual"))
    return test.join(found.withColumnRenamed("label", "predicted"), "id", "left").select("id", "actual", F.coalesce("predicted", F.lit(default)).alias("predicted"))
