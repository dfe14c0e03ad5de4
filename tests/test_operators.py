"""Operators on literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantaloom.functions import geometry, keys, sequences, vectors
from vantaloom.operators import candidates, evaluate, graph, neighbours, relational, retrieval
from vantaloom.plans.flow import Flow, Step, ancestors, param, timing
from vantaloom.sources import tables
from vantaloom.streaming.duplicates import windowed_duplicates


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_keys(spark):
    lit = F.lit
    assert one(spark, keys.parse_edge_key(keys.edge_key(lit(7).cast("long"), lit(3).cast("long"))).alias("e"))["e"] == (3, 7)
    assert one(spark, keys.uint64_to_key(lit(258).cast("long")).alias("k"))["k"] == bytes([0] * 6 + [1, 2])
    assert one(spark, keys.leading_number(lit("12ab")), keys.leading_number(lit("x"), 5))[:] == (12, 5)
    with pytest.raises(Exception):
        one(spark, keys.parse_edge_key(F.to_binary(lit("00"), lit("hex"))))
    values = [-3.5, -1.0, 0.0, 2.25, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", keys.double_to_key(F.col("v")).alias("k"))
    assert [r["v"] for r in df.orderBy("k").collect()] == values


def test_paths(spark):
    lit = F.lit
    r = one(spark, tables.shard_number(lit("hdfs://host:7222/data/part-00012")), tables.clean_path(lit("hdfs://host:7222/data/x")), tables.split_file_list(lit("a, b,,c")), tables.shard_number(lit("x")))
    assert r[:] == (12, "/data/x", ["a", "b", "c"], None)


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "key long, value string")
    path = f"file://{tmp_path}/t"
    tables.write_table(rows, path, shards=4, key=["key"], bloom="key")
    back = tables.scan(spark, path)
    assert tables.entry_count(back) == 100 and len(tables.shard_paths(back)) == 4
    assert tables.find(back, 42) == (True, (42, "v42")) and tables.find(back, 1000) == (False, None)
    assert tables.lookup_batch(back, spark.createDataFrame([(1,), (1,), (500,)], "key long")).count() == 1
    assert tables.scan_shards(spark, tables.shard_paths(back)[:1]).count() < 100
    with pytest.raises(ValueError):
        tables.codec_checked("brotli9")
    told = tables.with_metadata(back, "key", **{tables.SORT_ORDER: "memcmp"})
    tables.write_table(told, f"{path}2")
    assert tables.metadata(tables.scan(spark, f"{path}2"), "key") == {tables.SORT_ORDER: "memcmp"}
    fs = tables.FileSystem(spark, path)
    assert fs.is_dir(path) and not fs.is_file(path) and fs.size(path) > 0 and fs.remove(f"{path}2")
    tables.save_result(rows.limit(1), f"{path}3")
    assert tables.load_result(spark, f"{path}3")["key"] == 0
    with pytest.raises(ValueError):
        tables.load_result(spark, path)


def test_images_and_features(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.jpg").write_bytes(b"\xff\xd8\xff\xe0x")
    (tmp_path / "i/b.txt").write_bytes(b"none")
    assert [r["name"] for r in tables.import_images(spark, str(tmp_path / "i")).collect()] == ["a.jpg"]
    (tmp_path / "f.txt").write_text("128\n2\n1 2 3 10 20\n4 5 6 7 8\n")
    rows = tables.read_ascii_features(spark, str(tmp_path / "f.txt")).orderBy("x").collect()
    assert [(r["x"], r["radius"], r["descriptor"]) for r in rows] == [(1, 3, [10, 20]), (4, 6, [7, 8])]


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(v, "xywh")])
    r = one(spark, geometry.rect_intersection(box(0, 0, 10, 10), box(10, 0, 5, 5)), geometry.crop_box(box(5, 5, 10, 10), box(0, 0, 8, 8)), geometry.crop_rect(F.lit(100), F.lit(80), 0.1), geometry.crop_rect(F.lit(60), F.lit(60), 0.2))
    assert r[0] is None and r[1][:] == (0, 0, 3, 3) and r[2][:] == (10, 10, 80, 60) and r[3] is None
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    r = one(spark, geometry.polygon_area(square), geometry.path_length(square), geometry.envelope(square))
    assert r[0] == 12 and r[1] == 11 and r[2][:] == (0, 0, 4, 3)


def test_sequences_and_vectors(spark):
    a = F.array(*map(F.lit, [1, 1, 2, 2, 1]))
    r = one(spark, sequences.unique_copy(a), sequences.rotated(a, 2), sequences.is_sorted(a), sequences.count_equal(a, F.lit(1)), vectors.sparse_from_words(a, False))
    assert r[0] == [1, 2, 1] and r[1] == [2, 2, 1, 1, 1] and r[2] is False and r[3] == 3
    assert [tuple(x) for x in r[4]] == [(1, 0.6), (2, 0.4)]
    r = one(spark, vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))), vectors.is_finite(F.lit(float("nan"))), sequences.nth_weekday(F.lit("2024-11-01").cast("date"), 5, 4).cast("string"))
    assert r[0] == [0.6, 0.8] and r[1] is False and r[2] == "2024-11-28"


def test_knn_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 5)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, None)], "vec_id long, embedding array<float>")
    got = neighbours.knn_join(df, df, 3, same=True, block=16).collect()
    f = v.astype(np.float32).astype(float)
    d = ((f[:, None] - f[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3]}
    assert {(r["query_id"], r["base_id"]) for r in got} == want


def test_running_mean_is_the_closed_form(spark):
    obs = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 3), ("b", [5.0, 5.0], 2)], "k string, v array<double>, n long")
    got = {r["k"]: (r["v"], r["n"]) for r in neighbours.merge_observations(obs, "k", "v", "n").collect()}
    assert got == {"a": ([2.5, 5.0], 4), "b": ([5.0, 5.0], 2)}


def test_components_match_golden(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame([(0, 1), (1, 4), (4, 0), (2, 5)], "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.connected_components(v, e).collect()} == {0: 0, 1: 0, 4: 0, 2: 2, 5: 2, 3: 3}


def test_graph_algorithms(spark):
    v = spark.createDataFrame([(i,) for i in range(4)], "id long")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert sorted((r["src"], r["dst"]) for r in graph.minimum_spanning_tree(v, e).collect()) == [(0, 1), (1, 2), (2, 3)]
    assert [tuple(r) for r in graph.triangles(e).collect()] == [(0, 1, 2)]
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3)]
    assert list(graph.bridges(pairs)) == [(2, 3)]
    assert sorted(graph.maximal_cliques(pairs)) == [(2, 2, 3), (3, 0, 2)]
    assert sorted(graph.clique_members([(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)])) == [([0, 1, 3],), ([0, 2, 3],)]
    assert list(graph.girth(pairs)) == [(3,)] and dict(graph.greedy_colouring(pairs)) == {0: 0, 1: 1, 2: 2, 3: 0}
    cyclic = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.strong_components(v, cyclic).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    with pytest.raises(ValueError):
        graph.topological_order(v, cyclic)


def test_edge_lists(spark, tmp_path):
    (tmp_path / "g").write_text("3 2\n2\n1 3\n2\n")
    assert sorted(tuple(r) for r in graph.read_edge_list(spark, str(tmp_path / "g")).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    (tmp_path / "d").write_text("c x\np sp 2 1\na 1 2 7\n")
    assert [tuple(r) for r in graph.read_edge_list(spark, str(tmp_path / "d"), "dimacs").collect()] == [(1, 2)]


def test_trial_sizes(spark):
    rows = [(i, 1 if i < 600 else 2, ("POSITIVE", "NEGATIVE", "NONE")[i % 3]) for i in range(1200)]
    photos = spark.createDataFrame(rows, "id long, label long, kind string")
    primary = relational.label_class(photos, "primary", "kind")
    got = {r["split"]: r["count"] for r in evaluate.trial(primary, 50).groupBy("split").count().collect()}
    assert got == {"train": 100, "test": 200}


def test_caps_and_merges(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (2, 3, 0.6)], "src long, dst long, score double")
    assert sorted((r["src"], r["dst"]) for r in candidates.replication_cap(e, 2).collect()) == [(1, 2), (1, 3), (2, 3)]
    merged = candidates.merge_matches([e, e.withColumn("score", F.lit(1.0))]).collect()
    assert len(merged) == 4 and {r["score"] for r in merged} == {1.0}


def test_unique_primary_is_checked(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    side = spark.createDataFrame([(1, "x")], "k long, w string")
    assert relational.map_join(twice, side, ["k"]).count() == 2
    with pytest.raises(Exception):
        relational.map_join(twice, side, ["k"], unique_primary=True).collect()


def test_bloom_sizes():
    assert retrieval.bloom_bits(100_000, 0.01) == math.ceil(100_000 * math.log(100) / math.log(2) ** 2)
    assert abs(retrieval.bloom_error(100_000, 958_506, 7) - 0.01) < 1e-3


def test_flow(spark, tmp_path):
    a = Step("a", lambda s, n: s.range(n), params={"n": 3})
    b = Step("b", lambda s, x: x.withColumn("y", F.col("id") + 1), [a])
    f = Flow(spark, f"file://{tmp_path}/flow")
    assert f.run(b).count() == 3 and f.run(b).count() == 3
    told = f.provenance()
    assert ancestors(told, b.fingerprint()).count() == 2 and timing(told).count() == 2
    with pytest.raises(TypeError):
        param({"n": "3"}, "n", int)


def test_stream_counts_duplicates(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:01'), (1, timestamp'2024-01-01 00:00:02'), (2, timestamp'2024-01-01 00:00:03'), (3, timestamp'2024-01-01 02:00:00') AS t(k, ts)").write.parquet(path)
    out = windowed_duplicates(spark.readStream.schema("k int, ts timestamp").parquet(path), ["k"], "ts", "1 minute", "10 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("dups").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["k"], r["count"]) for r in spark.table("dups").collect()] == [(1, 2)]
