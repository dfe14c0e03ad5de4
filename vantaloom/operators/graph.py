"""Graphs as vertex and edge tables: components, propagation, paths, motifs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in spark.checkpoint.dir; a folder of this process only where none is set and all runs on this machine (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="vantaloom-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back. A checkpoint passes on the constraints and size estimates of its plan, and those
    inferred from rounds of joins of such tables multiply until planning takes longer than the work; a stored table has none."""
    cut_lineage(df.sparkSession.range(1))
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def image_graph(matches: DataFrame, vertices: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): edges between known vertices, src < dst, the largest weight of each."""
    edges = matches.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight")).filter("src < dst")
    edges = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    known = vertices.select("id")
    edges = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return vertices, edges.select("src", "dst", "weight")


def nfa_weight(log10_nfa: Column) -> Column:
    """Edge weight of a match: how many orders of magnitude its number of false alarms is under 1 (F9; our formula)."""
    return F.greatest(F.lit(0.0), -log10_nfa)


def region_graph(regions: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between regions that hold matched points of an image pair.

    regions: region_id, image_id, x1, y1, x2, y2; matches: image_a, xa, ya, image_b, xb, yb."""

    def inside(side: str) -> DataFrame:
        return regions.select(F.col("region_id").alias(f"region_{side}"), F.col("image_id").alias(f"image_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("x1", "y1", "x2", "y2")])

    out = matches
    for s in ("a", "b"):
        out = out.join(inside(s), f"image_{s}").filter(f"x{s} >= x1_{s} and x{s} < x2_{s} and y{s} >= y1_{s} and y{s} < y2_{s}")
    out = out.select(F.least("region_a", "region_b").alias("src"), F.greatest("region_a", "region_b").alias("dst")).filter("src < dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable.

    Labels take their neighbours' minimum and then their label's label (pointer jumping), so rounds grow with
    the logarithm of a component's breadth."""
    step = cut_lineage(both_ways(edges))
    labels = cut_lineage(vertices.select("id", F.col("id").alias("component")))
    while True:
        near = step.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "id", "left").select("id", F.least("component", "m").alias("new"), "component")
        jumped = lower.join(labels.select(F.col("id").alias("new"), F.col("component").alias("far")), "new").select("id", F.least("new", "far").alias("new"), "component")
        jumped = cut_lineage(jumped)
        labels = jumped.select("id", F.col("new").alias("component"))
        if jumped.filter("new <> component").isEmpty():
            return labels


def propagate_labels(edges: DataFrame, seeds: DataFrame, rounds: int, alpha: float = 0.99) -> DataFrame:
    """(id, label, score) after rounds of F <- alpha D^-1/2 S D^-1/2 F + (1 - alpha) Y (D20, Zhou et al. 2004).

    edges: src, dst, weight, undirected; seeds: id, label. Entries stay sparse: only labels that reach a vertex have rows."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    deg = both.groupBy("src").agg(F.sum("weight").alias("d"))
    s = both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    s = cut_lineage(s.select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w")))
    y = seeds.select("id", "label", F.lit(1.0).alias("score"))
    f = y
    for i in range(rounds):
        moved = s.join(f.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", (F.col("w") * F.col("score") * alpha).alias("score"))
        f = moved.unionByName(y.withColumn("score", F.lit(1 - alpha))).groupBy("id", "label").agg(F.sum("score").alias("score"))
        if i % 3 == 2:
            f = cut_lineage(f)
    return f


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each once. Edges point to the end of higher degree, so hubs don't multiply."""
    deg = both_ways(edges).groupBy("src").agg(F.count("*").alias("d"))
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()
    e = e.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("f")), "dst")
    up = (F.col("d") < F.col("f")) | ((F.col("d") == F.col("f")) & (F.col("src") < F.col("dst")))
    e = cut_lineage(e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    two = e.select("u", F.col("v").alias("p")).join(e.select("u", F.col("v").alias("q")), "u").filter("p <> q")
    closed = two.join(e.select(F.col("u").alias("p"), F.col("v").alias("q")), ["p", "q"])
    s = F.array_sort(F.array("u", "p", "q"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient) of each vertex with an edge (V5)."""
    deg = both_ways(edges).filter("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    tri = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = deg.join(tri, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.withColumn("coefficient", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of directed edges: influence and prestige (V4)."""
    e = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return e.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def reverse(edges: DataFrame) -> DataFrame:
    """Edges turned round (V8)."""
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


def subgraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices (V8)."""
    known = vertices.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dag_paths(edges: DataFrame, source: int, longest: bool = False, most_rounds: int = 1000) -> DataFrame:
    """(id, dist) of vertices reachable from source in a weighted DAG: shortest or longest (V9), by relaxation. Only vertices
    whose distance changed in a round pass it on in the next; it ends when none did."""
    better = F.greatest if longest else F.least
    pick = F.max if longest else F.min
    edges = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    dist = fresh = cut_lineage(edges.sparkSession.createDataFrame([(source, 0.0)], "id long, dist double"))
    for _ in range(most_rounds):
        new = edges.join(fresh.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(pick(F.col("dist") + F.col("weight")).alias("new"))
        both = cut_lineage(dist.join(new, "id", "full").select("id", better("dist", "new").alias("best"), "dist"))
        dist = both.select("id", F.col("best").alias("dist"))
        fresh = both.filter(F.col("dist").isNull() | (F.col("dist") != F.col("best"))).select("id", F.col("best").alias("dist"))
        if fresh.isEmpty():
            return dist
    raise ValueError("the graph has a cycle or is deeper than most_rounds")


def topological_order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest path that leads to a vertex; order by level, then id (V11). A cycle is an error."""
    left, rest, level, done = cut_lineage(vertices.select("id")), edges.select("src", "dst"), 0, None
    while not left.isEmpty():
        free = cut_lineage(left.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        left = cut_lineage(left.join(free, "id", "left_anti"))
        rest = cut_lineage(rest.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else vertices.select("id", F.lit(0).alias("level"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for each path (V12), semi-naively: each round extends only what the last one found."""
    known = cut_lineage(edges.select("src", "dst").distinct())
    first = fresh = known
    while not fresh.isEmpty():
        longer = fresh.withColumnRenamed("dst", "mid").join(first.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = cut_lineage(longer.join(known, ["src", "dst"], "left_anti"))
        known = cut_lineage(known.unionByName(fresh))
    return known


def _least_before(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, least): the smallest id with a path to a vertex, its own included. Only what fell in a round is passed on."""
    known = cut_lineage(vertices.select("id", F.col("id").alias("least")))
    fresh = known
    while True:
        near = edges.join(fresh.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("m"))
        new = cut_lineage(known.join(near, "id", "left").select("id", F.least("least", "m").alias("new"), "least"))
        fresh = new.filter("new < least").select("id", F.col("new").alias("least"))
        if fresh.isEmpty():
            return known
        known = new.select("id", F.col("new").alias("least"))


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id that reaches a vertex and is reached by it (V2).

    Each vertex is told by the smallest id that reaches it and the smallest it reaches. Vertices of one component agree
    in both, so edges between vertices that differ go; when none does, the smallest id of what is left connected reaches all
    of it and is reached by all. Tables hold a row a vertex and edge, and no paths."""
    ids = cut_lineage(vertices.select("id").distinct())
    left = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    while True:
        told = _least_before(ids, left).withColumnRenamed("least", "before").join(_least_before(ids, reverse(left)).withColumnRenamed("least", "after"), "id")
        told = cut_lineage(told)
        ends = left.join(told.select(F.col("id").alias("src"), F.struct("before", "after").alias("a")), "src").join(told.select(F.col("id").alias("dst"), F.struct("before", "after").alias("b")), "dst")
        ends = cut_lineage(ends)
        if ends.filter("a <> b").isEmpty():
            return told.select("id", F.col("before").alias("component"))
        left = cut_lineage(ends.filter("a = b").select("src", "dst"))


def minimum_spanning_tree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of a minimum spanning forest (V10), by Boruvka rounds; ties by ends.

    Each component hooks on to the other end of its least edge; of two that choose the same edge the smaller is the root,
    and pointer jumping brings every component to its root."""
    left = stored(edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("e")))
    tree = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))).alias("x"), "e").select("x.c", "x.to", "e")
        best = stored(ends.groupBy("c").agg(F.min_by("to", "e").alias("to"), F.min("e").alias("e")))
        chosen = best.select("e.src", "e.dst", "e.weight").distinct()
        tree = stored(chosen if tree is None else tree.unionByName(chosen))
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        hooks = best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            hooks = stored(hooks.join(hooks.select(F.col("c").alias("to"), F.col("to").alias("far")), "to").select("c", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        root = hooks.select("c", "to")
        left = left.join(root.select(F.col("c").alias("a"), F.col("to").alias("ra")), "a").join(root.select(F.col("c").alias("b"), F.col("to").alias("rb")), "b")
        left = stored(left.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "e"))
    return tree if tree is not None else edges.limit(0).select("src", "dst", "weight")


def per_component(vertices: DataFrame, edges: DataFrame, solve: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run a driver-style algorithm on each component's edges in a task of its own: V3, V6, V7, V13 to V16.

    solve(list of (src, dst)) yields tuples of the schema, which begins with the component. A component has to fit in a task."""
    labels = connected_components(vertices, edges)
    e = edges.select("src", "dst").join(labels.withColumnRenamed("id", "src"), "src")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        c = table["component"][0].as_py()
        rows = [(c, *r) for r in solve(sorted(zip(table["src"].to_pylist(), table["dst"].to_pylist())))]
        cols = list(zip(*rows)) or [[] for _ in names]
        return pa.table({n: list(x) for n, x in zip(names, cols)}) if rows else pa.table({n: pa.array([], pa.list_(pa.int64()) if "array" in x else pa.int64()) for n, x in zip(names, schema.split(","))})

    return e.groupBy("component").applyInArrow(run, schema)


def _adjacent(edges: list[tuple]) -> dict:
    out: dict = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def bridges(edges: list[tuple]) -> Iterator[tuple]:
    """(src, dst) of edges without which the graph falls apart; they part its biconnected pieces (V3, V7)."""
    near = _adjacent(edges)
    order: dict = {}
    low: dict = {}
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(sorted(near[w]))))
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        yield (min(v, parent), max(v, parent))


def biconnected(edges: list[tuple]) -> Iterator[tuple]:
    """(block, src, dst): each edge's biconnected component, numbered by its smallest edge's place (V3). A bridge is a block of one edge."""
    near = _adjacent(edges)
    order: dict = {}
    low: dict = {}
    blocks: list[list[tuple]] = []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, open_edges = [(root, None, iter(sorted(near[root])))], []
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    open_edges.append((v, w))
                    stack.append((w, v, iter(sorted(near[w]))))
                    break
                if w != parent and order[w] < order[v]:
                    open_edges.append((v, w))
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        at = open_edges.index((parent, v))
                        blocks.append(sorted((min(e), max(e)) for e in open_edges[at:]))
                        del open_edges[at:]
    for i, block in enumerate(sorted(blocks)):
        for a, b in block:
            yield (i, a, b)


def articulation_points(edges: list[tuple]) -> Iterator[tuple]:
    """(vertex,) that several blocks share: without it the graph falls apart (V3)."""
    blocks: dict = {}
    for i, a, b in biconnected(edges):
        blocks.setdefault(a, set()).add(i)
        blocks.setdefault(b, set()).add(i)
    for v in sorted(blocks):
        if len(blocks[v]) > 1:
            yield (v,)


def edge_connectivity(edges: list[tuple]) -> Iterator[tuple]:
    """(number,): the fewest edges whose loss parts a connected graph (V7), by least cuts of merged vertices."""
    near = {v: {w: 1 for w in ws} for v, ws in _adjacent(edges).items()}
    if len(near) < 2:
        return
    best = None
    while len(near) > 1:
        start = min(near)
        weight, added, heap = dict(near[start]), [start], [(-n, w) for w, n in near[start].items()]
        left = set(near) - {start}
        heapify(heap)
        cut = 0
        while left:
            n, v = heappop(heap)
            if v not in left or -n != weight[v]:
                continue  # an entry from before its weight grew
            cut = -n
            left.remove(v)
            added.append(v)
            for w, m in near[v].items():
                if w in left:
                    weight[w] = weight.get(w, 0) + m
                    heappush(heap, (-weight[w], w))
        best = cut if best is None else min(best, cut)
        a, b = added[-2], added[-1]  # the last vertex joins the one before
        for w, n in near.pop(b).items():
            near[w].pop(b, None)
            if w != a:
                near[a][w] = near[a].get(w, 0) + n
                near[w][a] = near[a][w]
    yield (best,)


def simple_cycles(edges: DataFrame, most: int) -> DataFrame:
    """(members) of each simple cycle of up to `most` vertices, from its smallest vertex on towards the smaller neighbour, once.

    Paths grow by a join a step from their smallest vertex, over larger ones only."""
    both = cut_lineage(both_ways(edges).filter("src <> dst"))
    paths = both.filter("src < dst").select(F.array("src", "dst").alias("members"))
    found = None
    for n in range(3, most + 1):
        last = paths.withColumn("src", F.element_at("members", -1))
        paths = last.join(both, "src").filter((F.col("dst") > F.col("members")[0]) & ~F.array_contains("members", F.col("dst")))
        paths = cut_lineage(paths.select(F.array_append("members", F.col("dst")).alias("members")))
        closed = paths.filter(F.col("members")[1] < F.element_at("members", -1)).select("members", F.element_at("members", -1).alias("src"), F.col("members")[0].alias("dst"))
        closed = closed.join(both, ["src", "dst"], "left_semi").select("members")
        found = closed if found is None else found.unionByName(closed)
    return found if found is not None else paths.limit(0)


def maximal_cliques(edges: list[tuple]) -> Iterator[tuple]:
    """(size, smallest member, largest member) of each maximal clique (V6)."""
    for (members,) in clique_members(edges):
        yield (len(members), members[0], members[-1])


def clique_members(edges: list[tuple]) -> Iterator[tuple]:
    """(sorted members,) of each maximal clique (V6), by Bron and Kerbosch with pivots."""
    near = _adjacent(edges)
    stack = [(set(), set(near), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if r:
                yield (sorted(r),)
            continue
        pivot = max(p | x, key=lambda v: (len(near[v] & p), -v))
        for v in sorted(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}


def greedy_colouring(edges: list[tuple]) -> Iterator[tuple]:
    """(vertex, colour): vertices in id order, each the least colour its neighbours lack."""
    near, colour = _adjacent(edges), {}
    for v in sorted(near):
        used = {colour[w] for w in near[v] if w in colour}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
        yield (v, colour[v])


def depth_first(edges: list[tuple]) -> Iterator[tuple]:
    """(vertex, place) in depth-first order from the smallest vertex."""
    near, seen = _adjacent(edges), set()
    stack = sorted(near, reverse=True)[-1:]
    while stack:
        v = stack.pop()
        if v in seen:
            continue
        yield (v, len(seen))
        seen.add(v)
        stack += sorted(near[v] - seen, reverse=True)


def girth(edges: list[tuple]) -> Iterator[tuple]:
    """(length,) of the shortest cycle, if any."""
    near, best = _adjacent(edges), 0
    for root in near:
        dist, parent, queue = {root: 0}, {root: None}, [root]
        for v in queue:
            for w in near[v]:
                if w not in dist:
                    dist[w], parent[w] = dist[v] + 1, v
                    queue.append(w)
                elif parent[v] != w:
                    n = dist[v] + dist[w] + 1
                    best = n if not best else min(best, n)
    if best:
        yield (best,)


def read_edge_list(spark, path: str, kind: str = "metis") -> DataFrame:
    """(src, dst) from text: `metis` adjacency lines under a header, `dimacs` arc lines, or `dot` undirected edges."""
    lines = spark.read.text(path)
    if kind == "dimacs":
        f = F.split("value", r"\s+")
        return lines.filter(F.col("value").rlike("^[ae] ")).select(f[1].cast("long").alias("src"), f[2].cast("long").alias("dst"))
    if kind == "dot":
        got = lines.select(F.regexp_extract("value", r"(\d+)\s*-[->]\s*(\d+)", 1).alias("a"), F.regexp_extract("value", r"(\d+)\s*-[->]\s*(\d+)", 2).alias("b")).filter("a <> ''")
        return got.select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).filter("at > 0")
    return whole.select(F.col("at").cast("long").alias("src"), F.explode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("dst")).withColumn("dst", F.col("dst").cast("long"))


def write_dot(edges: DataFrame, path: str) -> None:
    """Edges as lines of a DOT graph."""
    edges.select(F.format_string("%d -- %d;", "src", "dst").alias("value")).write.text(path)
