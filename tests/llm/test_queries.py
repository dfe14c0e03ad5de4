"""The op queries against brute force over whole tables, and cases the supplied tables lack."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantaloom.llm import chat, codec, exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, quality, shingles, token_files, tokens
from vantaloom.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def plain_ids(name, texts):
    from tokenizers import Tokenizer

    return [x.ids + [1] for x in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(seed, n, vocabulary=10**6):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_op1_largest_id(spark):
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(table(spark, [(LAST, "a  b"), (None, "a b"), (-(2**63), "c")])).collect()}
    assert got == {LAST: (LAST, True, 2), None: (LAST, False, 2), -(2**63): (-(2**63), True, 1)}


def test_op2_covers_every_id_once(spark, documents):
    whole = dict(zip((r["doc_id"] for r in documents), plain_ids("byte_bpe_50k.json", (r["text"] for r in documents))))
    got = packing.op2_pack_sequences(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(whole)
    for i, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(whole[i])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, whole.values()))
    assert len(sequences) == math.ceil(total / 2048)


def test_op3_columns_and_likeness(spark, documents):
    def sets(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()

    def alike(a, b):
        a, b = sets(a), sets(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(documents, key=lambda r: -r["doc_id"])
    following = {r["doc_id"]: order[(k + 1) % len(order)]["text"] or "" for k, r in enumerate(order)}
    got = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(documents)
    off, by_text = [], {}
    for r in documents:
        text, x = r["text"] or "", got[r["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[r["doc_id"]][:half]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [abs(x["near_edited"] - alike(text, edited)), abs(x["near_next"] - alike(text, following[r["doc_id"]]))]
        assert by_text.setdefault(text, x["fingerprint"]) == x["fingerprint"]
    assert max(off) < 0.2 and np.mean(off) < 0.03


def test_op3_shared_and_extreme_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 3)
    rows = [(5, f"t{k}") for k in range(9)] + [(None, f"n{k}") for k in range(5)] + [(LAST, "last"), (-(2**63), "first")]
    df, order = fingerprints.with_next(table(spark, rows), "doc_id", "text")
    got = df.withColumn("n", F.lead("text").over(order)).filter(~F.col("extra")).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows) and sorted(r["n"] for r in got) == sorted(t for _, t in rows)
    following = {r["text"]: r["n"] for r in got}
    at, seen = "last", []
    while at not in seen:
        seen.append(at)
        at = following[at]
    assert len(seen) == len(rows) and seen[0] == "last" and seen[10] == "first" and all(t[0] == "n" for t in seen[11:])


def test_op5_equals_the_tokenizer(spark, documents):
    whole = plain_ids("word_bpe_49k.json", (r["text"] for r in documents))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op5_token_files(spark, SF).collect()}
    at, want = 0, {}
    for r, ids in zip(documents, whole):
        want[r["doc_id"]] = at, len(ids), crc(ids)
        at += len(ids)
    assert got == want


def test_codec_beats_order_0(spark):
    """Bits an id against those of the block's own frequencies, whose table isn't even counted."""
    import pyarrow as pa

    texts = pa.array([r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])
    ids = tokens.PieceEncoder(tokenizer_path("word_bpe_49k.json")).encode_all(texts, 1)[0].astype(np.int64)
    block = codec.encode_block(ids)
    assert len(block) * 8 < 0.87 * -np.log2(np.bincount(ids)[ids] / len(ids)).sum()
    assert (codec.decode_block(block) == ids).all()
    with pytest.raises(ValueError):
        codec.encode_block(np.array([codec.MOST_ALPHABET]))


def test_piece_table_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE", 50)
    monkeypatch.setattr(tokens, "STRETCH", 200)
    import pyarrow as pa

    texts = [words(k % 7, 40, 90) + ("" if k % 3 else " don't <|endoftext|> x") for k in range(40)] + ["", "a  b", "é" * 30 + " ok", "日本語、テスト。 12ab_c"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.PieceEncoder(tokenizer_path(name))
        ids, sizes = e.encode_all(pa.array(texts), 1)
        want = plain_ids(name, texts)
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_op6_many_turns(spark):
    n = 4000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("### "), F.col("id").cast("string")).alias("text"))
    chats = chat.format_chats(rows)
    got = chats.select(F.size("turns").alias("n"), F.size("loss_mask").alias("m"), chat.loss_text(F.col("formatted"), F.col("escaped"), F.col("loss_mask")).alias("loss")).first()
    assert got["n"] == got["m"] == n and got["loss"] == "".join(f"### {i}" for i in range(n))


def test_op7_posteriors_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, f"h{r.randrange(5)}", None if r.random() < 0.1 else f"p{r.randrange(4)}", float(r.random() < 0.5) if r.random() < 0.5 else None, r.uniform(-3, 3)) for i in range(150)]
    df = spark.createDataFrame([(i, h, "-" if p is None else "=" + p, q, q, s, s) for i, h, p, q, s in rows], "id long, host string, path string, quality double, toxic double, quality_llr double, toxic_llr double")
    paths, whole = quality.sites(df, ("quality",))
    out = df.select("id", "host", "path", "quality", "quality_llr").join(paths, ["host", "path"])
    w, p = quality._weight("quality"), quality._own("quality", whole["quality"]["base"])
    got = {x["id"]: x["r"] for x in out.select("id", quality.prior("quality", whole["quality"], w, p).alias("r")).collect()}
    known = [q for *_, q, _ in rows if q is not None]
    base = (sum(known) + 1) / (len(known) + 2)
    own = {i: (1.0, q) if q is not None else (quality.SOFT, 1 / (1 + math.exp(-(s + math.log(base / (1 - base)))))) for i, _, _, q, s in rows}
    facts = whole["quality"]
    assert abs(facts["base"] - base) < 1e-12
    for i, h, p, _, _ in rows:
        others = [x for x in rows if x[0] != i]
        at = lambda chosen: (sum(own[x[0]][0] for x in chosen), sum(own[x[0]][0] * own[x[0]][1] for x in chosen))
        n, k = at([x for x in others if x[1] == h])
        host = (k + facts["over_hosts"] * facts["mu"]) / (n + facts["over_hosts"])
        n, k = at([x for x in others if x[1:3] == (h, p)])
        assert abs(got[i] - (k + facts["over_paths"] * host) / (n + facts["over_paths"])) < 1e-9


def test_digits_count_wherever_they_stand():
    head, tail = "²³ 7 " + "a " * 3000, "a " * 3000 + "²³ 7 "
    assert quality.shape(head, [])[10] == quality.shape(tail, [])[10] == 1 / len(head)


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_op8_words_with_equal_polynomials(spark):
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048, True)), (3, thue_morse(4096)), (4, thue_morse(4096, True)), (5, thue_morse(2048))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_op8_large_regions_are_cut_again(spark, monkeypatch, percent):
    """Documents that share their rarest shingles, in several components: no region is small."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "LARGE", 1)
    rows = []
    for c in range(8):
        base = (words(1000, 12) + " " + words(c, 60)).split()
        for k in range(7):
            r = random.Random(31 * c + k)
            own = list(base)
            for _ in range(r.randrange(0, 5)):
                own[12 + r.randrange(60)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(words(1000, 12).split()[:9])) for k in range(4)]
    sets = [jaccard_join.word_shingles(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(table(spark, rows), percent=percent).collect()}
    assert got == {x: top(x) for x in range(len(rows))}


def test_shingles_of_words_and_hashes_agree():
    import pyarrow as pa

    texts = ["A b\tC d", "a b", "", " x\x0by ", thue_morse(300) + " b c", "é É   z"]
    for t, own in zip(texts, shingles.shingle_sets(pa.array(texts))):
        assert len(own) == len(jaccard_join.word_shingles(t, 3))


def test_components_alike_by_one_task_and_by_rounds(spark, monkeypatch):
    from vantaloom.llm import components

    r = random.Random(8)
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)], "u long, v long")
    one = sorted(map(tuple, components.connected_components(edges).collect()))
    monkeypatch.setattr(components, "SMALL", 0)
    rounds = sorted(x for x in map(tuple, components.connected_components(edges).collect()))
    loops = {u for u, _ in one} - {u for u, _ in rounds}  # a node with a loop alone is its own component either way
    assert [x for x in one if x[0] not in loops] == rounds and all((u, u) in one for u in loops)


def test_op9_text_without_spaces(spark):
    pieces = language_id.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(6)
    one, two = "天地玄黄宇宙洪荒日月盈昃", "いろはにほへとちりぬるを"
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    model = language_id.train([text(one, 300) for _ in range(12)] + [text(two, 300) for _ in range(12)], ["zh"] * 12 + ["ja"] * 12, pieces)
    assert model.scores([text(one, 50), text(two, 5000)])[0] == ["zh", "ja"]
    start = time.process_time()
    assert model.scores([text(two, 300_000)])[0] == ["ja"]
    assert time.process_time() - start < 30


def test_op9_sample_is_of_rows(spark):
    rows = [(7, f"the cat {k}", "en") for k in range(300)] + [(None, "le chat", "fr")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, train_docs=20)
    assert set(model.languages) <= {"en", "fr"} and abs(math.exp(model.prior[0]) - 0.5) < 0.01


def test_op10_recall_over_all_earlier_documents(spark):
    """Every block of 10 words or more that any earlier document holds goes, with null, repeated and extreme ids."""
    r = random.Random(9)
    lines = [f"line {k} of {r.randrange(10**6)} has words" for k in range(30)]  # 6 words each
    rows = []
    for i in range(40):
        own = []
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(28)
            own += lines[at : at + r.randrange(1, 4)] + [f"own {i} {r.randrange(10**6)}"]
        rows.append([i, "\n".join(own)])
    rows[3][0], rows[5][0], rows[7][0] = LAST, None, 6
    df = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], "doc_id long, text string, _doc string, _text string, row string, cuts long")
    got = {(x["doc_id"], x["was"]): x["text"].split("\n") if x["text"] else [] for x in line_dedup.line_dedup(df.withColumn("was", F.col("text"))).collect()}
    key = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for _, t in rows}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, key[x[1]]))
    held = set()
    for i, t in order:
        own = t.split("\n")
        cut = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[a:b]) >= 10 and tuple(own[a:b]) in held:
                    cut |= set(range(a, b))
        assert got[i, t] == [x for k, x in enumerate(own) if k not in cut], i
        held |= {tuple(own[a:b]) for a in range(len(own)) for b in range(a + 1, len(own) + 1)}


def test_op10_block_found_past_its_lines_first_holders(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, x), (2, y), (3, f"{x}\n{y}"), (4, f"a\n{x}\n{y}"), (5, f"{x}\n{y}\nb")]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: (x, 0), 2: (y, 0), 3: (f"{x}\n{y}", 0), 4: ("a", 2), 5: ("b", 2)}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _mix_id long, _id string, row string, tie long, lang_pred string, score double, slot long, cuts string"


def test_stages_keep_clean_rows_and_odd_columns(spark, tmp_path):
    """Null, empty, repeated and clashing rows go through every stage; six unrelated rows in, six out."""
    import corpus_pipeline as pipeline

    r = random.Random(3)
    voc = {"en": "the house on a hill and river under old stone bridge".split(), "fr": "le chat dans la maison et sur une petite colline avec".split()}
    prose = lambda lang, k: " ".join(r.choice(voc[lang]) + (f" n{r.randrange(10**5)}" if j % 3 == 0 else "") for j in range(k))
    rows = [(i, prose(lang, 60), lang, ("a", "b", None)[i % 3]) for i, lang in enumerate(["en", "fr"] * 12)]
    rows += [(None, prose("en", 50), "en", "a"), (None, prose("en", 50), "en", "a"), (5, prose("fr", 50), "fr", "b"), (LAST, prose("en", 40), "en", None)]
    bad = [(900, None, "en", "a"), (901, "", None, "a"), (902, "12 34", "en", None)]
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y", 2, "p", 0.5, 3, "q") for i, t, lang, s in rows + bad + rows[:2]], CLASH)
    left = pipeline.language_id(spark, df, SF)
    assert left.columns == df.columns and sorted(x["text"] for x in left.collect()) == sorted(t for _, t, *_ in rows + rows[:2])
    for stage in (pipeline.line_blocks, pipeline.near_duplicates, pipeline.mix_sources):
        path = f"file://{tmp_path}/{stage.__name__}"
        stage(spark, left, SF).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == df.columns
        got = left.select("text", "_mix_id", "row", "tie", "slot", "cuts").collect()
        assert {tuple(x[1:]) for x in got} == {(1, "y", 2, 3, "q")}
    assert sorted(x["text"] for x in left.collect() if x["text"]) == sorted(t for _, t, *_ in rows)
    assert pipeline.pack_sequences(spark, left, SF).select("doc_id").distinct().count() == len({i for i, *_ in rows})
    nothing = df.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_pack_keeps_the_mix(spark, tmp_path):
    """Groups are spans of the mix's slots, one after the other, and sequences are numbered along them."""
    import corpus_pipeline as pipeline

    rows = [(i, words(i, 30), "en", "abc"[min(i % 6, 2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = f"file://{tmp_path}/mixed"
    pipeline.mix_sources(spark, df, SF).write.parquet(path)
    mixed = spark.read.parquet(path)
    slots = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(df).collect()}
    at, place = pipeline.stored_place(mixed.select("doc_id", "text"))
    out = packing.with_sequence_ids(packing.pack(at, tokenizer_path("byte_bpe_50k.json"), group_chars=6_000, place=place)).collect()
    first = {}
    for r in out:
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], (LAST, 0)), slots[r["doc_id"]])
    order = [first[k] for k in sorted(first)]
    assert order == sorted(order) and len({r["group"] for r in out}) > 5
    ends = {}
    for r in out:
        ends.setdefault(r["group"], set()).add(slots[r["doc_id"]])
    spans = [(min(ends[g]), max(ends[g])) for g in sorted(ends)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
