"""Matching, patterns and task pools on literal inputs."""

from pyspark.sql import functions as F

from vantaloom.operators import matching


def test_consensus_of_consistent_keypoints(spark):
    schema = "image_id long, keypoints array<struct<x:double,y:double,radius:double>>, descriptors array<array<double>>"
    a = (1, [(10.0, 10.0, 5.0), (20.0, 20.0, 15.0), (0.0, 5.0, 2.0)], [[1.0, 0.0], [0.0, 1.0], [5.0, 5.0]])
    b = (2, [(120.0, 70.0, 10.0), (140.0, 90.0, 30.0), (500.0, 5.0, 4.0)], [[1.0, 0.1], [0.1, 1.0], [5.0, 5.1]])
    c = (3, [], [])
    features = spark.createDataFrame([a, b, c], schema)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    got = {(r["image_a"], r["image_b"]): r for r in matching.match_images(pairs, features).collect()}
    r = got[1, 2]
    assert (r["candidates"], r["matches"], r["scale"], r["dx"], r["dy"]) == (3, 2, 2.0, 100.0, 50.0)
    assert got[1, 3]["matches"] == 0


def test_independent(spark):
    m = spark.createDataFrame([(1, 0.2, 0.2, 9.0, 9.0, 0.9), (1, 0.3, 0.4, 5.0, 5.0, 0.5), (1, 3.0, 3.0, 9.5, 9.5, 0.4), (1, 7.0, 7.0, 7.0, 7.0, 0.1)], "p long, xa double, ya double, xb double, yb double, s double")
    kept, gone = matching.independent(m, ["p"], "s")
    assert sorted(r["s"] for r in kept.collect()) == [0.1, 0.9] and gone.count() == 2


def test_patterns_counters_and_tasks(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long")
    assert matching.subgraph_matches(e, [(0, 1), (1, 2), (2, 0)]).count() == 6
    assert matching.subgraph_matches(e, [(0, 1), (1, 2)]).count() == 10
    df, seen = matching.counted(spark.range(10), odd=F.count_if(F.col("id") % 2 == 1))
    df.collect()
    assert seen.get["odd"] == 5
    assert sorted(matching.run_tasks([lambda i=i: i * i for i in range(5)])) == [0, 1, 4, 9, 16]
    assert 89 <= matching.tune_threshold(spark.range(100), "id", F.lit(1.0), 10.0) <= 90.5
