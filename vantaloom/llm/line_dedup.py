"""Line deduplication by pairwise alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Words of an aligned common block that is deleted, at least.
MIN_WORDS = 10
_DOC = ["none", "id", "tie"]
_SPACES = r"[\x20\x09-\x0D]+"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both rising, by patience diff.

    Lines that occur once on either side are matched by their longest rising chain; matches grow to
    equal neighbours, and the gaps between them are aligned in the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_a = {a[i]: i for i in range(a0, a1) if times_a[a[i]] == 1 == times_b.get(a[i])}
        once = [(at_a[b[j]], j) for j in range(b0, b1) if b[j] in at_a]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(once):
            at = bisect_left(tails, i)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [i], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(once[k])
            k = back[k]
        if not chain:
            continue
        last = (a0, b0)
        for i, j in reversed(chain):  # each gap ends in its anchor, which then matches as an equal end
            todo.append((last[0], i + 1, last[1], j + 1))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def least_blocks(words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of lines that hold at least min_words words, from each line on and up to each line.

    Document k holds the lines from bounds[k] to bounds[k + 1], each of one word or more. Every run of min_words or more is covered by those inside it,
    and a run that is one of them in one document is one wherever it stands."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    sizes = np.diff(bounds)
    here = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words), here + 1)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, here)
    on, up = ends <= np.repeat(bounds[1:], sizes), starts >= np.repeat(bounds[:-1], sizes)
    both = np.unique(np.stack([np.concatenate([here[on], starts[up]]), np.concatenate([ends[on], here[up] + 1])], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Runs [from, to) of b: all lines that lie in a run of at least min_words words that a holds as well.

    The alignment finds them where no line repeats and none cross. What it leaves unaligned of the
    lines of a is looked up in a block by block, so repeats and crossings are found too."""
    cut, run = bytearray(len(b)), []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i != run[-1][0] + 1 or j != run[-1][1] + 1):
            if sum(words[k] for _, k in run) >= min_words:
                cut[run[0][1] : run[-1][1] + 1] = b"\1" * len(run)
            run = []
        run.append((i, j))
    inside = set(a)
    if any(not c and h in inside for c, h in zip(cut, b)):
        held: dict[int, set[tuple[int, ...]]] = {}
        for x, y in zip(*(v.tolist() for v in least_blocks(np.array(words, np.int64), np.array([0, len(b)]), min_words))):
            if all(cut[x:y]) or not all(h in inside for h in b[x:y]):
                continue
            if y - x not in held:
                held[y - x] = {tuple(a[i : i + y - x]) for i in range(len(a) - (y - x) + 1)}
            if tuple(b[x:y]) in held[y - x]:
                cut[x:y] = b"\1" * (y - x)
    out = []
    for j in range(len(b)):
        if cut[j]:
            if out and out[-1][1] == j:
                out[-1] = (out[-1][0], j + 1)
            else:
                out.append((j, j + 1))
    return out


def block_keys(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of each distinct least block of each document."""
    starts, ends = least_blocks(words, bounds, min_words)
    keys, sizes = np.zeros(len(starts), np.uint64), ends - starts
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        x = keys[own] * np.uint64(0x9E3779B97F4A7C15) + hashes[starts[own] + k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys[own] = x ^ (x >> np.uint64(27))
    docs = np.searchsorted(bounds, starts, side="right") - 1
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]


def _blocks(min_words: int):
    """Rows of (none, id, tie, lines) become one row (none, id, tie, key) for each distinct least block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b["lines"].flatten()
            bounds = np.concatenate([[0], np.cumsum(b["lines"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            docs, keys = block_keys(lines.field("hash").to_numpy().view(np.uint64), lines.field("words").to_numpy(), bounds, min_words)
            at = pa.array(docs)
            yield pa.RecordBatch.from_arrays([*[b[c].take(at) for c in _DOC], pa.array(keys.view(np.int64))], names=[*_DOC, "key"])

    return run


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of df with repeated blocks of lines cut from the text, and n_lines, removed_lines (longs).

    Lines count as equal without the white space at their ends; blank lines are no lines. A document is paired with the
    first document (smallest id) that holds any of its blocks, for each shortest run of lines with min_words words (from each
    line on and up to each line; a long line is one by itself); so there are no more pairs than twice its lines, however common a block is, the
    rarest and the commonest blocks are treated alike, and a block that any earlier document holds is found in its first holder. (Single rare
    lines would miss passages whose lines are common each.) Each
    pair is aligned over the hashes of all its lines, and all blocks of at least min_words words that both hold are
    deleted from the later document, however often they come and in whatever order. A line's first holder keeps it. A text that loses all its lines becomes empty.

    Null texts count as empty and come back as they were; null ids are later than all others; rows
    that repeat an id are ordered by a hash of their text, and rows that repeat both get the same
    result and are not compared. A text of any length is one outline, of 20 bytes a line. Columns of df may have any names; those named
    n_lines or removed_lines are replaced. An empty table gives no rows."""
    kept = [c for c in df.columns if c not in ("n_lines", "removed_lines")]
    text = text_or_empty(f"`{text_col}`")
    doc = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("tie"))

    def outline(text):
        lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(F.regexp_replace(x, _SPACES, " ")).alias("line"), i.alias("at")))
        return F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(F.xxhash64(x["line"]).alias("hash"), F.size(F.split(x["line"], " ")).alias("words"), x["at"].alias("at")))

    outlines = df.select(doc.alias("doc"), outline(text).alias("lines")).dropDuplicates(["doc"])
    outlines = materialise(outlines, "outlines")
    held = outlines.select("doc.*", "lines").mapInArrow(_blocks(min_words), "none boolean, id long, tie long, key long").select(F.struct(*_DOC).alias("doc"), "key")
    held = materialise(held, "blocks")
    firsts = held.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("holders")).filter("holders > 1")
    firsts = materialise(firsts, "first-holders")
    # blocks that many hold, 10,000 of them at most, meet their holders by broadcast and the others by a shuffle
    many = max(1000, held.count() // 10_000)
    common = F.broadcast(firsts.filter(F.col("holders") >= many).select("key", F.col("first").alias("common")))
    held = held.join(common, "key", "left")
    rare = held.filter(F.col("common").isNull()).select("doc", "key").join(firsts.filter(F.col("holders") < many).select("key", "first"), "key")
    pairs = rare.select("first", "doc").unionByName(held.filter(F.col("common").isNotNull()).select(F.col("common").alias("first"), "doc"))
    pairs = pairs.filter(F.col("doc") != F.col("first")).distinct()
    pairs = pairs.join(outlines, "doc").join(outlines.select(F.col("doc").alias("first"), F.col("lines.hash").alias("before")), "first")
    pairs = pairs.select(*[F.col(f"doc.{c}").alias(c) for c in _DOC], F.col("lines.hash").alias("hash"), F.col("lines.words").alias("words"), F.col("lines.at").alias("at"), "before")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for i in range(b.num_rows):
                own, words, at, before = (b[c][i].as_py() for c in ("hash", "words", "at", "before"))
                for x, y in common_blocks(before, own, words, min_words):
                    rows.append(i)
                    starts.append(at[x])
                    ends.append(at[y - 1])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c].take(rows) for c in _DOC], pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*_DOC, "from_line", "to_line"])

    cuts = pairs.mapInArrow(align, "none boolean, id long, tie long, from_line int, to_line int")
    cuts = cuts.groupBy(*_DOC).agg(F.collect_set(F.struct("from_line", "to_line")).alias("cuts")).select(F.struct(*_DOC).alias("doc"), "cuts")
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    out = df.select(doc.alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), own.alias("row")).join(cuts, "doc", "left")
    lines = F.split("text", "\n")

    def filled(lines):
        return F.size(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, _SPACES, " ")) != ""))

    rest = F.filter(lines, lambda x, i: ~F.exists("cuts", lambda c: (i >= c["from_line"]) & (i <= c["to_line"])))
    out = out.withColumn("n_lines", F.coalesce(filled(lines), F.lit(0)).cast("long"))
    out = out.withColumn("left", F.when(F.col("cuts").isNotNull(), rest))
    out = out.withColumn("removed_lines", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.col("n_lines") - filled(F.col("left"))).cast("long"))
    clean = F.when(F.col("cuts").isNull(), F.col(f"row.`{text_col}`")).when(F.col("removed_lines") == F.col("n_lines"), F.lit("")).otherwise(F.array_join("left", "\n"))
    return out.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in kept], "n_lines", "removed_lines")


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)


#: Compares the least blocks themselves; within a document it joins lines with lines.
OP10_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(own) AS line, unnest(range(len(own))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents)),
filled AS (
  SELECT doc_id, place, line, len(string_split(line, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS j
  FROM (SELECT doc_id, place, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw) WHERE line <> ''),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM filled),
runs AS (
  SELECT a.doc_id, a.j AS x, min(b.j) AS y FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.n >= 10 GROUP BY a.doc_id, a.j
  UNION SELECT b.doc_id, max(a.j), b.j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.n >= 10 GROUP BY b.doc_id, b.j),
blocks AS (
  SELECT r.doc_id, x, y, string_agg(line, chr(10) ORDER BY j) AS block FROM runs r JOIN filled f ON f.doc_id = r.doc_id AND f.j BETWEEN x AND y GROUP BY 1, 2, 3),
held AS (SELECT DISTINCT doc_id, block FROM blocks),
firsts AS (SELECT block, min(doc_id) AS first FROM held GROUP BY block HAVING count(*) > 1),
pairs AS (SELECT DISTINCT doc_id, first FROM held JOIN firsts USING (block) WHERE doc_id <> first),
cut AS (
  SELECT DISTINCT p.doc_id, p.first, f.j, f.place
  FROM pairs p JOIN blocks b ON b.doc_id = p.doc_id JOIN held h ON h.doc_id = p.first AND h.block = b.block JOIN filled f ON f.doc_id = b.doc_id AND f.j BETWEEN b.x AND b.y),
spans AS (
  SELECT doc_id, first, g, min(place) AS a, max(place) AS b FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, first ORDER BY j) AS g FROM cut) GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT raw.doc_id, place FROM raw JOIN spans ON spans.doc_id = raw.doc_id AND place BETWEEN a AND b),
told AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.place) FILTER (gone.place IS NULL) AS rest, count(gone.place) AS any_gone,
         count(filled.place) AS n_lines, count(filled.place) FILTER (gone.place IS NOT NULL) AS removed_lines
  FROM raw LEFT JOIN gone USING (doc_id, place) LEFT JOIN filled USING (doc_id, place) GROUP BY raw.doc_id)
SELECT doc_id, CASE WHEN any_gone = 0 THEN text WHEN removed_lines = n_lines THEN '' ELSE rest END AS text, n_lines, removed_lines
FROM documents JOIN told USING (doc_id)
"""
