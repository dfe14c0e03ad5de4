"""Operators for training data: edge cases and brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantaloom.llm import chat, codec, fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, quality, token_files
from vantaloom.llm.exact_dedup import exact_dedup
from vantaloom.llm.tokens import PieceEncoder, tokenizer_path

SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, rank long, _id string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"v{r.randrange(vocabulary)}" for _ in range(n))


BASE = words(1, 120)
TEXTS = [
    (1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " "), (6, BASE), (7, BASE), (8, BASE + " tail"), (9, words(2, 80)),
    (10, LONG), (11, LONG + " x"), (12, "été à la\nplage, ß 日本 \U0001f600"), (None, "no id here"), (None, None), (6, BASE), (13, "one two"), (14, "one two"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", ("s1" if (i or 0) % 3 else None), 0, "clash", "clash", 1, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x")]).limit(0)


def norm(t):
    return re.sub(SPACES, " ", t or "")


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup(docs).collect()
    assert len(got) == len(TEXTS) and exact_dedup(empty).count() == 0
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        real = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(real) if real else None)
    for sha, ids in by_sha.items():
        assert [r["doc_id"] for r in got if r["kept"] and r["text_sha256"] == sha] == [min((i for i in ids if i is not None), default=None)]


def test_exact_dedup_over_partition_bounds(spark):
    rows = spark.range(2000, numPartitions=3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = exact_dedup(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = {i: "hot" if i % 3 else f"t{i % 100}" for i in range(2000)}
    first, size = {}, {}
    for i, t in text.items():
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + 1
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {i: (first[t], size[t], first[t] == i) for i, t in text.items()}


def test_piece_encoder():
    from tokenizers import Tokenizer

    texts = ["a  b", "a   b", " a", "a ", "a  ", "a \n b", "\t a", "", " ", "it's 'tis\n\n\n  ok", "e ́f", "<|endoftext|> a", "a.\nB c.\n\nD", "don't, can't. x", "q.\r\nx", "é, ñ. ß:", "ΑΣ. İ, K", BASE, "日本, ok\nno"]
    for f in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, t = PieceEncoder(tokenizer_path(f)), Tokenizer.from_file(tokenizer_path(f))
        for x in texts:
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing_lengths():
    r = random.Random(5)
    for _ in range(50):
        lengths = [r.choice([1, 5, 100, 101, 250, r.randrange(1, 400)]) for _ in range(r.randrange(0, 40))]
        pieces = packing.pack_lengths(lengths, 100)
        for d, n in enumerate(lengths):
            at = 0
            for _, start, length, _, _ in sorted(p for p in pieces if p[0] == d):
                assert start == at and length > 0
                at += length
            assert at == n
        used = {}
        for p in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert p[4] == used.get(p[3], 0)
            used[p[3]] = p[4] + p[2]
        assert len(used) == -(-sum(lengths) // 100) and all(u <= 100 for u in used.values())


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(6)
    for _ in range(30):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(1, 60))]
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, u in enumerate(bins) if u + sizes[i] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            bins[b] += sizes[i]
            want[i] = b
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_pack(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0
    got = packing.pack(docs, path, capacity=64, group_chars=5000).collect()
    e = PieceEncoder(path)
    for r in got:
        assert zlib.crc32(bytes(r["tokens"])) == r["ids_crc32"] and len(r["tokens"]) == 4 * r["length"]
    for i, t in TEXTS:
        if i is not None and i != 6:
            data = b"".join(bytes(r["tokens"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
            assert data == e.encode(t or "") + (1).to_bytes(4, "little")
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 6)
    numbers = {(r["group"], r["sequence"]) for r in got}
    assert len({r["sequence_id"] for r in packing.with_sequence_ids(packing.pack(docs, path, capacity=64, group_chars=5000)).collect()}) == len(numbers)


def brute_sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, docs, empty):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(TEXTS) and fingerprints.fingerprints(empty).count() == 0
    by = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    assert by[6] == by[7] and by[3] == by[4] == by[5] == "" and by[13] == by[14] and len(by[9]) == fingerprints.BINS
    r = random.Random(8)
    pairs = []
    for n in (20, 200, 2000):
        a = [f"x{r.randrange(10**6)}" for _ in range(n)]
        for cut in (0.1, 0.5, 0.9):
            pairs.append((" ".join(a), " ".join(a[: int(n * cut)] + [f"y{r.randrange(10**6)}" for _ in range(n - int(n * cut))])))
    df = spark.createDataFrame(pairs, "a string, b string")
    out = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb").select("a", "b", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("j")).collect()
    for x in out:
        assert abs(x["j"] - jaccard(brute_sets(x["a"], 5), brute_sets(x["b"], 5))) < 0.16


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 5)
    ids = [3, 1, 4, 1_000, 59, 26, 53, 58, 97, 93, 23, 84, 62, 64, 33]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows, order = fingerprints.with_next(df, "doc_id", "text")
    got = {r["key"]["id"]: r["n"] for r in rows.withColumn("n", F.lead("text").over(order)).filter(~F.col("extra")).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}


def test_mixing(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(docs, block=2).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1}, {"a": 997, "b": 2, "c": 1}])
def test_pfair_lag(weights):
    period = mixing.pfair_period(weights)
    total, done = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, s in enumerate(period, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / total) < 1 for x, w in weights.items())


def test_mix_lag_and_wholeness(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 6 == 0, "mid").otherwise("small").alias("source"))
    got = mixing.mix(df, {"big": 0.5, "mid": 0.3, "small": 0.2}, block=10).collect()
    assert {r["doc_id"] for r in got} == set(range(3000))
    slots = {r["slot"]: r["source"] for r in got}
    assert sorted(slots) == list(range(len(slots)))
    done = {"big": 0, "mid": 0, "small": 0}
    first_end = min(max(s for s, x in slots.items() if x == k) for k in done)
    for t in range(first_end):
        done[slots[t]] += 1
        assert all(abs(done[k] - (t + 1) * w) < 1 for k, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))


def test_codec():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 64, 129, 5000):
        for ids in (r.integers(0, 50_000, n), np.zeros(n, int), r.zipf(1.5, n) % 50_000):
            block = codec.encode_block(ids)
            assert (codec.decode_block(block) == ids).all()
    repeated = np.tile(r.integers(0, 50_000, 500), 40)
    assert len(codec.encode_block(repeated)) < 2 * len(repeated)
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 255
    for bad in (bytes(damaged), block[:-2], b"x"):
        with pytest.raises(ValueError):
            codec.decode_block(bad)


def test_token_files(spark, docs, empty, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path, block_ids=2000)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()
    e, at = PieceEncoder(path), 0
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in order]
    for r, (i, t) in zip(rows, order):
        assert r["start"] == at
        at += r["n_tokens"]
        if i is not None:
            assert bytes(r["tokens"]) == e.encode(t or "") + (1).to_bytes(4, "little")
    token_files.write_token_files(empty, f"file://{tmp_path}/e", path)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_chat(spark):
    hard = ["</turn>", "### user:\n", "\\", "\\e\\m", ":\n", "</turn>\n### assistant:\nhi</turn>\n", "", None, "</turn", "\\### Assistant: </turn> ok", "é\U0001f600"]
    rows = [(c, t, ("user", "assistant")[t % 2], x) for c in range(3) for t, x in enumerate(random.Random(c).sample(hard, len(hard)))]
    rows += [(9, 0, "a:", "x"), (9, 1, "a:\nb", "y"), (9, 1, "a:\nb", "y"), (9, None, None, "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("escaped"), F.col("loss_mask")).alias("loss")).collect()
    assert len(out) == 5 and chat.format_chats(df.limit(0)).count() == 0
    for r in out:
        want = sorted(((-1 if t is None else t), role or "", x or "") for c, t, role, x in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["read"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        for m in r["loss_mask"]:
            assert r["formatted"][m["at"] - 1 + m["length"] :].startswith("</turn>")
    assert chat.parse(F.lit("junk")) is not None and spark.range(1).select(chat.parse(F.lit("junk")).alias("p")).first()["p"] is None


def brute_components(texts, k, percent, lower=True):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = [(i, frozenset(brute_sets((t or "").translate(low), k))) for i, t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if root(y) == root(x)] if s else [i]
        real = [j for j in ids if j is not None]
        out.append((i, len(s), min(real) if real else None))
    return out


def near_copies(n=40):
    out = []
    for c in range(6):
        base = words(c, 90, 10**6).split()
        for k in range(n // 6):
            r = random.Random(100 * c + k)
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            out.append((len(out), " ".join(own)))
    return out


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_jaccard_classes(spark, docs, empty, percent, size):
    assert jaccard_join.jaccard_classes(empty).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = near_copies()
        got = jaccard_join.jaccard_classes(table(spark, rows), words=size, percent=percent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, size, percent))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = jaccard_join.jaccard_classes(docs, words=size, percent=percent).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute_components(TEXTS, size, percent), key=key)


def test_shingle_counts_are_whole(monkeypatch):
    monkeypatch.setattr(jaccard_join, "_SEEN", 1)
    texts = [words(k, 30, 10**6) for k in range(4)]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([k], pa.int64()), "tie": pa.array([k], pa.int64()), "text": [t]}) for k, t in enumerate(texts)]
    data = [x.as_py() for b in jaccard_join._describe(3)(iter(batches)) for x in b["data"] if x.is_valid]
    assert sum(np.frombuffer(zlib.decompress(x), np.int32).sum() for x in data) == 4 * 28
    got = jaccard_join._in_order(np.array([80_000, 70_000, 3, 3, 65_535]))
    assert got.dtype == np.uint16 and got.tolist() == [3, 2, 0, 0, 1]
    assert jaccard_join._in_order(np.arange(70_000)).tolist() == list(range(70_000))


def test_one_of_each(spark, docs):
    out = jaccard_join.one_of_each(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 9, 10, 12, 13] and ids.count(None) == 2


def test_one_of_each_tells_components_with_one_id_apart(spark):
    rows = [(None, words(21, 40)), (None, words(22, 40)), (None, words(22, 40)), (5, words(23, 40)), (5, words(24, 40)), (6, words(24, 40)), (None, words(25, 40)), (7, words(25, 40))]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[7]], key=str)


def test_language_id(spark, docs, empty):
    pieces = ["▁a", "a", "b", "ab", "▁"]
    prob = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.01]])

    def brute(w):
        p = dict(zip(pieces, prob[:, 0]))
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                a[j] += a[i] * p.get(w[i:j], 0.01 if j - i == 1 else 0.0)
        return np.log(a[-1])

    for w in ("▁ab", "▁abba", "▁xab", "▁" + "ab" * 60):
        assert abs(language_id.word_scores([w], language_id.Lattice(pieces), prob)[0, 0] - brute(w)) < 1e-9
    model = language_id.train(["the cat and the dog", "le chat et le chien"], ["en", "fr"], language_id.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    got = language_id.identify(docs.withColumn("score", F.lit("clash")), model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(TEXTS) and by[3] == by[4] == by[5] == ("und", 0.0) and by[6][0] in ("en", "fr") and 0 <= by[12][1] <= 1
    assert language_id.identify(empty, model).count() == 0
    untaught = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, untaught).collect()} == {"und"}


def test_long_words_are_learned_from():
    pieces, prob = ["▁a", "a", "b", "ab", "▁"], np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.15, 0.2], [0.05, 0.05], [0.01, 0.02]])
    length = np.array([2, 1, 1, 2, 1, 1])
    for w in ("▁" + "abxba" * 14, "▁" + "ab" * 1000):
        got = language_id._expected([w, w[:-1] + "b"], np.array([[1.0, 2.0], [1.0, 0.0]]), language_id.Lattice(pieces), prob)
        assert np.allclose((got * length[:, None]).sum(axis=0), [2 * len(w), 2 * len(w)])
    word, want = "▁" + "ab" * 40, np.zeros(6)
    number = {x: i for i, x in enumerate(pieces)}
    fore, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
    spans = [(i, i + k, number[word[i : i + k]]) for i in range(len(word)) for k in (1, 2) if word[i : i + k] in number and i + k <= len(word)]
    for i, j, x in sorted(spans, key=lambda s: s[1]):
        fore[j] += fore[i] * prob[x, 0]
    for i, j, x in sorted(spans, key=lambda s: -s[0]):
        back[i] += back[j] * prob[x, 0]
    for i, j, x in spans:
        want[x] += fore[i] * prob[x, 0] * back[j] / fore[-1]
    assert np.allclose(language_id._expected([word], np.array([[1.0]]), language_id.Lattice(pieces), prob[:, :1])[:, 0], want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.op9_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_patience():
    r = random.Random(4)
    for _ in range(500):
        a, b = ([r.randrange(9) for _ in range(r.randrange(12))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_line_dedup(spark, docs, empty):
    shared = "this passage has many words and it is repeated in several documents here\nwith a second line of it"
    rows = [(1, f"own one\n{shared}\nend one"), (2, f"own two\n\n{shared}\nend two"), (3, "short\nlines"), (4, "short\nother"), (5, shared), (6, None), (7, ""), (None, shared), (8, "plain")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "own two\n\nend two" and got[2]["removed_lines"] == 2
    assert got[3]["text"] == "short\nlines" and got[4]["text"] == "short\nother" and got[5]["text"] == "" and got[None]["text"] == ""
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["removed_lines"] == 0
    assert line_dedup.line_dedup(empty).count() == 0
    out = line_dedup.line_dedup(docs.withColumn("n_lines", F.lit("clash")))
    assert out.count() == len(TEXTS) and out.columns == [*docs.columns, "n_lines", "removed_lines"]


def brute_shared(a, b, size, min_words):
    """Places of b in a run of min_words words or more that a holds too."""
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    out = set()
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            if sum(size[x] for x in b[i:j]) >= min_words and tuple(b[i:j]) in runs:
                out |= set(range(i, j))
    return out


def test_common_blocks_with_repeats_and_crossings():
    cases = [([1, 2], [3, 1, 4, 1, 5]), ([1, 2, 1], [3, 1, 4]), ([8, 1, 7, 2, 9], [6, 2, 5, 1, 4])]
    r = random.Random(11)
    cases += [tuple([r.randrange(6) for _ in range(r.randrange(14))] for _ in range(2)) for _ in range(1500)]
    for size in (dict.fromkeys(range(10), 12), {k: 1 + k % 7 for k in range(10)}):
        for a, b in cases:
            got = line_dedup.common_blocks(a, b, [size[x] for x in b], 10)
            assert {j for x, y in got for j in range(x, y)} == brute_shared(a, b, size, 10), (a, b)


def test_line_dedup_pairs_with_the_first_holder_of_a_block(spark):
    line = {k: " ".join(f"l{k}w{i}" for i in range(1 + k % 7)) for k in range(12)}
    own = {k: " ".join(f"l{k}w{i}" for i in range(7)) for k in range(20, 28)}  # each under 10 words, alone in documents 0 to 7
    r = random.Random(12)
    texts = [[k] for k in own] + [[*own], [*own]] + [[r.choice(range(12)) for _ in range(r.randrange(16))] for _ in range(120)]
    line |= own
    size = {k: len(t.split()) for k, t in line.items()}
    rows = [(i, "\n".join(line[k] for k in t)) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(table(spark, rows)).collect()}
    for d, t in enumerate(texts):
        cut = set().union(*(brute_shared(a, t, size, 10) for a in texts[:d]))
        assert got[d]["removed_lines"] == len(cut) and got[d]["text"] == "\n".join(line[k] for j, k in enumerate(t) if j not in cut), d
    assert got[8]["removed_lines"] == 0 and got[9]["removed_lines"] == 8


def test_quality(spark, docs, empty):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good, toxic = r.random() < 0.7, r.random() < 0.2
        own = [f"w{r.randrange(300)}" for _ in range(60)] + (["awful"] * 2 if toxic else [])
        r.shuffle(own)
        rows.append((i, " ".join(own) if good else " ".join(w.upper() + "!!" for w in own)))
        labels.append((i, int(good), int(toxic)))
    known = spark.createDataFrame(labels[:300] + labels[:5] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(table(spark, rows), known).collect()}
    assert len(got) == 400
    assert np.mean([(got[i]["quality"] >= 0.5) == q and (got[i]["toxicity"] >= 0.5) == t for i, q, t in labels[300:]]) > 0.95
    assert quality.classify(empty, known).count() == 0
    out = quality.classify(docs, known.limit(0)).collect()
    assert len(out) == len(TEXTS) and all(0 <= x["quality"] <= 1 for x in out)


def test_training_sample_is_not_cut_for_a_figure():
    assert quality.TRAIN_DOCS == 6000


def test_sites_shrink_to_their_parents(spark):
    rows = [("=big", "=x", 1.0)] * 90 + [("=big", "=y", 1.0)] + [("=bad", "=x", 0.0)] * 90 + [("=bad", "=y", 1.0)]
    df = spark.createDataFrame([(h, p, q, 0.0) for h, p, q in rows], "host string, path string, quality double, quality_llr double")
    got = {(r["host"], r["path"]): r["quality_prior"] for r in quality.posteriors(df, "quality").collect()}
    assert got["=big", "=y"] > 0.9 and got["=bad", "=x"] < 0.05 and got["=bad", "=y"] < got["=big", "=y"]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), left.schema)
        sizes.append(left.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0.8 * docs.count()
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()
    e, ids = PieceEncoder(tokenizer_path("byte_bpe_50k.json")), {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["tokens"])
    assert ids == {i: e.encode(t) + (1).to_bytes(4, "little") for i, t in kept.items()}
