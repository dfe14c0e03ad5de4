"""Quality and toxicity by hierarchical empirical Bayes: document evidence, host and path posteriors."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Labelled documents the document classifier is fitted on, at most (chosen by a hash of the id).
TRAIN_DOCS = 6000
#: Characters of these, at most.
TRAIN_CHARS = 100_000_000
#: A word enters the lexicon if it is in so many sample documents and its log odds are so many standard errors from 0.
LEXICON_DOCS, LEXICON_Z = 5, 5.0
#: Weight of a document's own probability as soft evidence about its site, where it has no label.
SOFT = 0.1
#: Parts that the documents of a site are dealt to.
SALTS = 16
#: Decisions: lowest quality and highest toxicity of a kept document.
MIN_QUALITY, MAX_TOXICITY = 0.5, 0.5
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


def shape(text: str, words: list[str]) -> list[float]:
    """What a text looks like, whatever its language."""
    n, m = max(1, len(text)), max(1, len(words))
    upper = sum(map(str.isupper, words))
    letters = sum(map(len, words))
    raw = text.split()
    r = max(1, len(raw))
    counts = Counter(raw)
    tails = sum(1 for x in raw if not x[-1].isalnum() and x[-1] not in ".,;:?'\")")
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log(n) / 10,
        upper / m,
        1 - letters / n,
        len(counts) / r,
        max(counts.values(), default=0) / r,
        tails / r,
        (text.count("|") + text.count("%") + text.count("#") + text.count("*")) / r,
        text.count("!") / r,
        len(set(lines)) / max(1, len(lines)),
        letters / m / 10,
        len(_DIGIT.findall(text)) / n,
    ]


def _logit(p):
    return np.log(p) - np.log1p(-p)


def lexicon(docs: list[set[str]], y: np.ndarray) -> dict[str, float]:
    """Log odds of the class in documents with a word over all documents, of words where it is far from 0."""
    with_word, hits = Counter(), Counter()
    for words, positive in zip(docs, y):
        with_word.update(words)
        if positive:
            hits.update(words)
    if not len(y) or y.all() or not y.any():
        return {}
    base = y.mean()
    out = {}
    for w, n in with_word.items():
        if n >= LEXICON_DOCS:
            k = hits[w]
            if abs(k - n * base) > LEXICON_Z * np.sqrt(n * base * (1 - base)):
                out[w] = float(np.clip(_logit((k + 2 * base) / (n + 2)) - _logit(base), -4, 4))
    return out


def _lexicon_features(words: set[str], lex: dict[str, float]) -> list[float]:
    values = [lex[w] for w in words if w in lex]
    return [sum(v for v in values if v > 0), sum(v for v in values if v < 0) / max(1, len(words)) * 10, max(values, default=0.0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) by Newton steps; the intercept is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Evidence:
    """A document classifier for one label: shape and a learned lexicon, combined by logistic regression.

    Its output is evidence: log odds less those of the sample, so that a site's prior may take their place."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.base = float((y.sum() + 1) / (len(y) + 2))
        sets, shapes = [], []
        for t in texts:  # one text's words at a time; a word that many texts hold is held once
            words = _WORD.findall(t)
            shapes.append(shape(t, words))
            sets.append({sys.intern(w.lower()) for w in words})
        self.lex = lexicon(sets, y)
        if len(texts) < 20 or y.all() or not y.any():
            self.w = None
            return
        shapes = np.array(shapes)
        # lexicon features of each half come from the other half's lexicon
        half = np.arange(len(texts)) % 2
        lexes = [lexicon([s for s, h in zip(sets, half) if h != k], y[half != k]) for k in (0, 1)]
        lexical = np.array([_lexicon_features(s, lexes[h]) for s, h in zip(sets, half)])
        x = np.hstack([shapes, lexical])
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.w = logistic((x - self.mean) / self.scale, y.astype(float))

    def llr(self, shapes: np.ndarray, sets: list[set[str]]) -> np.ndarray:
        if self.w is None:
            return np.zeros(len(sets))
        x = np.hstack([shapes, np.array([_lexicon_features(s, self.lex) for s in sets]).reshape(len(sets), 3)])
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.w[:-1] + self.w[-1] - _logit(self.base), -20, 20)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[str, ...] = ("quality", "toxic"), train_docs: int = TRAIN_DOCS) -> dict[str, Evidence]:
    """Fit a classifier per target on whole texts of at most train_docs labelled rows (smallest hash of id) that hold
    TRAIN_CHARS characters in all; rows that repeat an id count as rows."""
    out = {}
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.avg(t).alias(t) for t in targets])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most train_docs ids
    rows = rows.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id", F.xxhash64("text")).limit(train_docs)
    before = Window.orderBy("hash", "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)  # over train_docs rows
    rows = rows.withColumn("chars", F.sum(F.length("text")).over(before)).filter(F.col("chars") <= TRAIN_CHARS).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
    for t in targets:
        own = [r for r in rows if r[t] is not None]
        out[t] = Evidence([r["text"] for r in own], np.array([r[t] >= 0.5 for r in own], bool))
    return out


def evidence(df: DataFrame, models: dict[str, Evidence], text: str = "text") -> DataFrame:
    """The columns of df with the text replaced by each target's evidence, <target>_llr. No shuffle."""
    kept = [c for c in df.columns if c != text]
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{t}_llr double" for t in models])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                words = [_WORD.findall(t) for t in texts]
                sets = [{w.lower() for w in own} for own in words]
                shapes = np.array([shape(t, w) for t, w in zip(texts, words)])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *[pa.array(m.llr(shapes, sets)) for m in models.values()]], names=[*kept, *[f"{t}_llr" for t in models]])

    return df.mapInArrow(score, schema)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rate: Column, n: Column, mean: Column) -> Column:
    """Pseudo-counts of a prior, by moments: how little groups' rates differ beyond what their sizes explain."""
    spread = F.sum(n * F.pow(rate - mean, 2)) / F.sum(n)
    noise = F.sum(mean * (1 - mean)) / F.sum(n)  # expected spread if all groups had the same rate
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.least(F.greatest(F.sum(n * mean * (1 - mean)) / F.sum(n) / between - 1, F.lit(1.0)), F.lit(10_000.0))


def _weight(target: str) -> Column:
    return F.when(F.col(target).isNotNull(), 1.0).otherwise(SOFT)


def _own(target: str, base: float) -> Column:
    """A document's label or, without one, its own probability."""
    return F.coalesce(F.col(target), _sigmoid(F.col(f"{target}_llr") + F.lit(_logit(base))))


def sites(scored: DataFrame, targets: tuple[str, ...]) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Per site (host, path) and target its evidence <target>_n, <target>_k and that of its host, <target>_hn, <target>_hk; and per target
    the whole table's `base`, `mu` and the strengths `over_hosts`, `over_paths` of the priors.

    Evidence about a path is its labels and, at weight SOFT, its unlabelled documents' own probabilities, summed before they are
    shuffled. Both targets are taken in one pass; what the driver gets is one row."""
    row = scored.agg(*[((F.sum(t) + 1) / (F.count(t) + 2)).alias(t) for t in targets]).first()
    whole = {t: {"base": 0.5 if row[t] is None else row[t]} for t in targets}
    sums = []
    for t in targets:
        w = _weight(t)
        sums += [F.sum(w).alias(f"{t}_n"), F.sum(w * _own(t, whole[t]["base"])).alias(f"{t}_k")]
    paths = materialise(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(f"{t}_{c}").alias(f"{t}_h{c}") for t in targets for c in "nk"])
    hosts = materialise(hosts, "hosts")
    row = hosts.agg(*[(F.sum(f"{t}_hk") / F.sum(f"{t}_hn")).alias(t) for t in targets]).first()
    for t in targets:
        whole[t]["mu"] = 0.5 if row[t] is None else row[t]
    row = hosts.agg(*[_strength(F.col(f"{t}_hk") / F.col(f"{t}_hn"), F.col(f"{t}_hn"), F.lit(whole[t]["mu"])).alias(t) for t in targets]).first()
    for t in targets:
        whole[t]["over_hosts"] = 1.0 if row[t] is None else row[t]
    paths = paths.join(hosts, "host")
    rates = {t: (F.col(f"{t}_hk") + whole[t]["over_hosts"] * whole[t]["mu"]) / (F.col(f"{t}_hn") + whole[t]["over_hosts"]) for t in targets}
    row = paths.agg(*[_strength(F.col(f"{t}_k") / F.col(f"{t}_n"), F.col(f"{t}_n"), rates[t]).alias(t) for t in targets]).first()
    for t in targets:
        whole[t]["over_paths"] = 1.0 if row[t] is None else row[t]
    return paths, whole


def prior(target: str, whole: dict[str, float], w: Column | None = None, p: Column | None = None) -> Column:
    """A site's posterior mean rate, without a document of it that has weight w and rate p, if given.

    Paths are drawn towards their host and hosts towards the whole table, by beta priors; so a site with few documents has its
    parent's rate, and a document alone at its host has the whole table's."""
    w = F.lit(0.0) if w is None else w
    wp = F.lit(0.0) if p is None else w * p
    host = (F.greatest(F.col(f"{target}_hk") - wp, F.lit(0.0)) + whole["over_hosts"] * whole["mu"]) / (F.greatest(F.col(f"{target}_hn") - w, F.lit(0.0)) + whole["over_hosts"])
    return (F.greatest(F.col(f"{target}_k") - wp, F.lit(0.0)) + whole["over_paths"] * host) / (F.greatest(F.col(f"{target}_n") - w, F.lit(0.0)) + whole["over_paths"])


def posteriors(scored: DataFrame, target: str) -> DataFrame:
    """(host, path, <target>_n, <target>_prior): each site's evidence and posterior mean rate of `target`."""
    paths, whole = sites(scored, (target,))
    return paths.select("host", "path", f"{target}_n", prior(target, whole[target]).alias(f"{target}_prior"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of df: doc_id, host, path, quality, toxicity (posteriors, 0 to 1), kept, and per target its evidence
    (_llr) and its site's rate from all the other documents (_prior).

    A document's posterior log odds are its site's, of which its own label and evidence are no part, plus its own evidence. Null hosts and paths are sites of
    their own (shown as null); null texts count as empty; repeated labels are averaged; rows that repeat an id
    share its labels; null ids have none. Without labels all evidence is 0. An empty table gives no rows. Sites'
    sums are formed before the shuffle, and rows of a large site are dealt out by a salt, so one site may hold any share of the rows."""
    targets = ("quality", "toxic")
    models = fit(df, labels, id_col, text_col, train_docs=train_docs)

    def site(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))

    rows = df.select(F.col(id_col).cast("long").alias("id"), site(host_col).alias("host"), site(path_col).alias("path"), text_or_empty(text_col).alias("text"))
    scored = evidence(rows, models)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.avg(t).cast("double").alias(t) for t in targets])
    scored = materialise(scored.join(known, "id", "left"), "evidence")
    paths, whole = sites(scored, targets)
    # a site's row goes to each of SALTS places, its documents to one of them
    salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", *[f"{t}_llr" for t in targets]), F.lit(SALTS)).cast("int")
    out = scored.withColumn("salt", salt).join(salted, ["host", "path", "salt"])
    for t in targets:
        rate = prior(t, whole[t], _weight(t), _own(t, whole[t]["base"]))
        out = out.withColumn(f"{t}_prior", F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4)))
        out = out.withColumn(f"{t}_p", _sigmoid(F.col(f"{t}_llr") + F.log(F.col(f"{t}_prior") / (1 - F.col(f"{t}_prior")))))

    def shown(c: str) -> Column:
        return F.when(F.col(c) != "-", F.substring(c, 2, 1 << 30)).alias(c)

    kept = (F.col("quality_p") >= MIN_QUALITY) & (F.col("toxic_p") < MAX_TOXICITY)
    return out.select(F.col("id").alias("doc_id"), shown("host"), shown("path"), F.col("quality_p").alias("quality"), F.col("toxic_p").alias("toxicity"), kept.alias("kept"), "quality_llr", "toxic_llr", "quality_prior", "toxic_prior")


def op7_quality(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
