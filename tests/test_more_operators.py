"""Graph algorithms against brute force; filters, indexes, texts, geometry and tables by worked examples."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vantaloom.functions import geometry as G
from vantaloom.functions import keys as K
from vantaloom.functions import texts as X
from vantaloom.operators import bloom as B
from vantaloom.operators import candidates as C
from vantaloom.operators import evaluate as E
from vantaloom.operators import graph as GR
from vantaloom.operators import index as I
from vantaloom.operators import neighbours as N
from vantaloom.operators import relational as R
from vantaloom.plans.catalogue import QUERIES, SQL
from vantaloom.sources import tables as T


def connected(vertices, edges):
    near = {v: set() for v in vertices}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, todo = set(), [next(iter(vertices))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    return seen == set(vertices)


def test_cuts_and_blocks_of_small_graphs():
    random.seed(1)
    tried = 0
    while tried < 120:
        n = random.randint(2, 7)
        edges = sorted({tuple(sorted(random.sample(range(n), 2))) for _ in range(random.randint(n - 1, 2 * n))})
        vertices = {v for e in edges for v in e}
        if not connected(vertices, edges):
            continue
        tried += 1
        fewest = next(k for k in range(1, len(edges) + 1) if any(not connected(vertices, [e for e in edges if e not in c]) for c in itertools.combinations(edges, k)))
        assert list(GR.edge_connectivity(edges)) == [(fewest,)]
        needed = sorted((v,) for v in vertices if len(vertices) > 2 and not connected(vertices - {v}, [e for e in edges if v not in e]))
        assert list(GR.articulation_points(edges)) == needed
        blocks = {}
        for i, a, b in GR.biconnected(edges):
            blocks.setdefault(i, []).append((a, b))
        assert sorted(e for b in blocks.values() for e in b) == edges
        assert sorted(b[0] for b in blocks.values() if len(b) == 1) == sorted(GR.bridges(edges))


def test_strong_components_of_random_graphs(spark):
    r = random.Random(5)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(22)}
    reach = {v: {v} for v in range(14)}
    for _ in range(14):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    vertices = spark.range(14).select("id")
    got = {x["id"]: x["component"] for x in GR.strong_components(vertices, spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == want


def test_longest_and_shortest_paths(spark):
    e = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.7), (1, 2, 0.2), (2, 3, 0.3), (1, 3, 5.0)], "src long, dst long, weight double")
    assert {r["id"]: round(r["dist"], 6) for r in GR.dag_paths(e, 0).collect()} == {0: 0.0, 1: 0.1, 2: 0.3, 3: 0.6}
    assert {r["id"]: round(r["dist"], 6) for r in GR.dag_paths(e, 0, longest=True).collect()} == {0: 0.0, 1: 0.1, 2: 0.7, 3: 5.1}
    with pytest.raises(ValueError):
        GR.dag_paths(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double"), 0, longest=True, most_rounds=4)


def test_double_keys_sort_as_doubles(spark):
    r = random.Random(2)
    values = [0.0, 1.5, -1.5, -900.25, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")] + [r.uniform(-1, 1) * 10 ** r.randrange(-300, 300) for _ in range(300)]
    values += [x * (1 + 2**-52) for x in values[10:60]]
    r.shuffle(values)
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", K.double_to_key(F.col("x")).alias("k")).collect()
    assert [x["x"] for x in sorted(got, key=lambda x: x["k"])] == sorted(values)
    assert len({x["k"] for x in got}) == len(set(values))


def test_bloom_filter(spark, tmp_path):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    bloom = B.build(keys, "key", 0.01)
    bloom.save(f"file://{tmp_path}/b")
    bloom = B.Bloom.load(spark, f"file://{tmp_path}/b")
    assert B.probably_contains(keys, "key", bloom).count() == 3000
    absent = spark.range(3000, 13000).select(F.col("id").cast("string").alias("key"))
    assert B.measured_error(absent, "key", bloom) < 0.02
    assert B.expected_error(3000, bloom.bits, bloom.hashes) < 0.0101
    assert B.required_bits(100_000, 0.01) == 958506
    assert B.probably_contains(absent, "key", B.build(keys.limit(0), "key")).count() == 0


def test_word_index_grows(spark, tmp_path):
    index = I.WordIndex(spark, f"file://{tmp_path}/w", "binary", "none")
    rows = lambda x: spark.createDataFrame(x, "id long, word string, tf long")
    index.add(rows([(1, "a", 2), (1, "b", 1)]))
    index.add(rows([(2, "a", 1), (2, "c", 4), (2, "b", 1)]))
    got = [(r["id"], r["score"]) for r in index.query(rows([(9, "b", 1), (9, "c", 1)]), 5).orderBy("rank").collect()]
    assert got == [(2, 2.0), (1, 1.0)]
    index.save(f"file://{tmp_path}/copy")
    assert I.WordIndex(spark, f"file://{tmp_path}/copy").postings().count() == 5
    with pytest.raises(ValueError):
        I.WordIndex(spark, "x", norm="l3")


def test_vector_index_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert I.VectorIndex.create(empty).cells.count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        X.from_yaml(F.lit("# c\na: 'it''s'\nb: 4\nc: null\n")).alias("yaml"),
        X.to_yaml({"a": F.lit("it's"), "b": F.lit(None).cast("long")}).alias("text"),
        X.from_base64(F.lit("no base64!")).alias("bad"),
        X.parse_uri(F.lit("s3a://bucket/x/y")).alias("uri"),
        X.parse_uri(F.lit("/plain")).alias("plain"),
        X.crc(F.lit(b"123456789")).alias("crc"),
        F.array(*[X.glob(F.lit(n), p) for n, p in (("ab.c", "a?.c"), ("abxc", "ab.c"), ("b", "[!a]"), ("x\ny", "x*"))]).alias("glob"),
    ).first()
    assert row["yaml"] == {"a": "it's", "b": "4", "c": None} and row["text"] == "a: 'it''s'\nb: null\n" and row["bad"] is None
    assert tuple(row["uri"]) == ("s3a", "bucket", "/x/y") and tuple(row["plain"]) == (None, None, "/plain")
    assert row["crc"] == 0xCBF43926 and row["glob"] == [True, False, True, True]


def test_geometry(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = F.array(p(0, 0), p(4, 0), p(4, 2), p(0, 2))
    row = spark.range(1).select(
        G.centroid(square).alias("c"), G.centroid(F.array(p(0, 0), p(1, 1), p(2, 2))).alias("flat"), G.point_within(F.lit(1.0), F.lit(1.0), square).alias("inside"),
        G.point_within(F.lit(5.0), F.lit(1.0), square).alias("outside"), G.segment_distance(p(2, 5), p(0, 0), p(4, 0)).alias("far"), G.segment_distance(p(-3, 4), p(0, 0), p(4, 0)).alias("end"), G.point_distance(p(0, 0), p(3, 4)).alias("d"),
        G.within_limits(F.lit(2.0), "usift", F.lit(0.8), F.lit(0.1)).alias("deviates"), G.within_limits(F.lit(2.0), "sift", F.lit(0.1), F.lit(-3.0)).alias("turned"),
    ).first()
    assert tuple(row["c"]) == (2.0, 1.0) and row["flat"] is None and row["inside"] and not row["outside"]
    assert row["far"] == 5.0 and row["end"] == 5.0 and row["d"] == 5.0 and not row["deviates"] and row["turned"]


def test_trial_with_auxiliary_fraction(spark):
    """200 positive, negative and unlabelled photos of each of two objects; 50 train, 100 test, all auxiliary ones."""
    kinds = ["POSITIVE", "NEGATIVE", "NONE"]
    rows = [(1 + i // 600, i, kinds[i % 3]) for i in range(1200)]
    photos = spark.createDataFrame(rows, "object_id long, photo_id long, label string")
    for share, aux in ((1.0, 400), (0.0, 0), (0.25, 100)):
        got = {r["split"]: r["count"] for r in E.trial_with_aux(photos, 50, share).groupBy("split").count().collect()}
        assert got.get("aux", 0) == aux and got["train"] == 100 and got["test"] == 200
    with pytest.raises(ValueError):
        E.trial_with_aux(photos, 50, 1.5)


def test_result_store(spark, tmp_path):
    store = T.ResultStore(spark, f"file://{tmp_path}/r", ["k"])
    rows = lambda x: spark.createDataFrame(x, "k long, score double")
    wanted = spark.range(1, 4).select(F.col("id").alias("k"))
    assert store.missing(wanted).count() == 3 and not store.contains(k=1)
    store.put(rows([(1, 0.5)]))
    store.put(rows([(1, 0.75), (2, 0.1)]))
    assert store.contains(k=1) and not store.contains(k=3) and [r["k"] for r in store.missing(wanted).collect()] == [3]
    assert {r["k"]: r["score"] for r in store.items().collect()} == {1: 0.75, 2: 0.1}


def test_files(spark, tmp_path):
    fs = T.FileSystem(spark, f"file://{tmp_path}")
    fs.write(f"file://{tmp_path}/a/b.bin", b"\x00\xff1234")
    assert fs.read(f"file://{tmp_path}/a/b.bin") == b"\x00\xff1234" and fs.read(f"file://{tmp_path}/a/b.bin", 2, 3) == b"123"
    images = spark.createDataFrame([(7, "x", bytearray(b"abc"))], "image_id long, kind string, data binary")
    assert T.export_files(images, f"file://{tmp_path}/out", class_col="kind") == 1 and fs.read(f"file://{tmp_path}/out/x/7.jpg") == b"abc"


def test_all_pairs_and_batches(spark):
    got = sorted((r["src"], r["dst"]) for r in C.all_pairs(spark.range(20), block=3).collect())
    assert got == list(itertools.combinations(range(20), 2))
    batches = R.batches(spark.range(100).select("id"), 16, [F.desc("id")]).collect()
    assert {r["id"]: r["batch"] for r in batches} == {i: (99 - i) // 16 for i in range(100)}


def test_dataset_writer_refuses_repeats(spark, tmp_path):
    photo = "array<struct<id:long,label:string,regions:array<long>>>"
    rows = lambda ids: spark.createDataFrame([(i, "n", [(p, "POSITIVE", [])]) for i, p in ids], f"id long, name string, photos {photo}")
    E.write_dataset(rows([(1, 10), (2, 11)]), f"file://{tmp_path}/ok")
    for bad in ([(1, 10), (1, 11)], [(1, 10), (2, 10)]):
        with pytest.raises(ValueError):
            E.write_dataset(rows(bad), f"file://{tmp_path}/bad")


@pytest.fixture
def on_tables(spark, tmp_path):
    """Rows of a catalogue query and of its SQL over the given tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        theirs = con.execute(SQL[name])
        ours = QUERIES[name](spark, f"file://{tmp_path}").select(*[c[0] for c in theirs.description])
        return [sorted((tuple(r) for r in x), key=str) for x in (ours.collect(), theirs.fetchall())]

    return run


def test_graph_files_keeps_loops(spark, on_tables):
    lines = spark.createDataFrame([(1_000_002, 2), (1_000_002, 2), (1_000_002, 3), (1_000_003, 2), (5, 2)], "l_partkey long, l_suppkey long")
    ours, theirs = on_tables("graph_files", lineitem=lines)
    assert ours == theirs and len(ours) == 3


def test_replication_cap_of_two_sides(spark, on_tables):
    """Parts 1000001 and 1000002 share their numbers with the suppliers' vertices 1 and 2."""
    lines = [(p, s, float(p * 7 % 11 + s * 5 % 13)) for p in (1, 2, 3, 4, 1_000_001, 1_000_002) for s in (1, 2, 3, 4, 5)]
    ours, theirs = on_tables("replication_cap", lineitem=spark.createDataFrame(lines + [(None, 6, 99.0)], "l_partkey long, l_suppkey long, l_extendedprice double"))
    assert ours == theirs and len(ours) > 5


def test_radius_join_broadcasts_neither_side(spark):
    points = spark.range(40).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 3 * 2).alias("y"))
    pairs = N.radius_join(points, points, 2.0, same=True)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    at = {i: (i % 7, i % 3 * 2) for i in range(40)}
    near = [(i, j) for i in at for j in at if i < j and (at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2 <= 4]
    assert sorted((r["a_id"], r["b_id"]) for r in pairs.collect()) == near


def test_spanning_tree_of_many_rounds(spark):
    """Kruskal's edges; tables that pass from round to round carry no constraints, whose number would multiply."""
    r = random.Random(11)
    edges = {tuple(sorted(r.sample(range(60), 2))): float(r.randrange(9)) for _ in range(130)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    tree = GR.minimum_spanning_tree(e.select(F.col("src").alias("id")), e.filter("src < 99"))
    root, kept = {v: v for v in range(60)}, []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        ends = [a, b]
        for i in (0, 1):
            while root[ends[i]] != ends[i]:
                ends[i] = root[ends[i]]
        if ends[0] != ends[1]:
            root[ends[0]] = ends[1]
            kept.append((a, b, w))
    assert sorted(tuple(x) for x in tree.collect()) == sorted(kept)
    assert GR.stored(e.filter("src < 99"))._jdf.queryExecution().analyzed().constraints().size() == 0
    assert tree._jdf.queryExecution().analyzed().constraints().size() == 0


def test_lsh_neighbours_are_the_nearest_of_all_pairs(spark):
    r = random.Random(3)
    at = {i: [r.gauss(0, 1) for _ in range(6)] for i in range(60)}
    df = spark.createDataFrame([(i, v) for i, v in at.items()] + [(99, None)], "vec_id long, embedding array<double>")
    near = {i: [] for i in at}
    for a, b in N.lsh_candidates(df, tables=4, bits=3).collect():
        dist = sum((x - y) ** 2 for x, y in zip(at[a], at[b]))
        near[a].append((dist, b))
        near[b].append((dist, a))
    for block in (5, 4096):
        got = N.lsh_neighbours(df, 3, tables=4, bits=3, block=block).collect()
        assert sorted((x["query_id"], x["rank"], x["base_id"]) for x in got) == sorted((i, n + 1, b) for i in at for n, (_, b) in enumerate(sorted(near[i])[:3]))


def test_vector_index_probes_reach_recall(spark, on_tables):
    """Vectors without clusters: ten of sixteen cells hold under 0.97 of the nearest."""
    r = random.Random(5)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(600)], "vec_id long, embedding array<double>").coalesce(2)
    truth = N.knn_join(df, df, 5, same=True).cache()
    index = I.VectorIndex.create(df, cells=16)
    recall = lambda probes: float(N.retrieval_precision(index.query(df, 5, probes=probes, same=True), truth, 5).first()[0])
    fewest = index.probes_for(df, truth, 0.97)
    assert recall(10) < 0.97 <= recall(fewest) and recall(fewest - 1) < 0.97
    assert index.probes_for(df, truth, 1.0) <= 16
    ours, theirs = on_tables("vector_index_recall", embeddings=df)
    assert ours == theirs == [(600, True)]
