"""Language identification with segmentation-marginalised unigrams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import tokenizer_path

#: Labelled documents per language that the model is fitted on, at most (chosen by a hash of the id).
TRAIN_DOCS = 1000
#: Characters of these in each language, at most.
TRAIN_CHARS = 20_000_000
#: Least probability of a piece, so that sums over the longest stretch stay above zero.
LEAST = 1e-7
#: Rounds of expectation maximisation, and pseudo-counts drawn from all languages' mean.
ROUNDS, SMOOTHING = 3, 200.0
#: Word scores kept in the young half of a worker's cache.
CACHE = 100_000
#: Characters over which plain sums don't run: longer words go stretch by stretch.
STRETCH = 24
#: Characters that are learned from together; all of a longer word counts, but no piece over these bounds.
LEARNED = 4096
#: Marks that are no part of a word at its ends.
_MARKS = ".,;:!?\"'()[]{}<>|%*&$#@+=/\\~^_-"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = "▁"


def vocabulary(model_file: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces, in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


class Lattice:
    """Finds the vocabulary's pieces at all places of many words of one length."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        by_length: dict[int, list[tuple[int, int]]] = {}
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for c in p:
                    h = h * self._BASE + np.uint64(ord(c) + 1)
                by_length.setdefault(len(p), []).append((int(h), i))
        self.tables = {}
        for n, own in by_length.items():
            hashes, numbers = np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int32)
            bits = (8 * len(own)).bit_length()
            slot = self._slot(hashes, bits)
            order = np.argsort(slot, kind="stable")
            starts = np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32)
            pad = int(np.diff(starts).max())
            self.tables[n] = bits, starts[:-1], pad, np.append(hashes[order], np.zeros(pad, np.uint64)), np.append(numbers[order], np.full(pad, -1, np.int32))

    @staticmethod
    def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)

    def _find(self, length: int, hashes: np.ndarray) -> np.ndarray:
        if length not in self.tables:
            return np.full(hashes.shape, -1, np.int32)
        bits, starts, longest, known, numbers = self.tables[length]
        at = starts[self._slot(hashes, bits)]
        out = np.where(known[at] == hashes, numbers[at], -1)
        for k in range(1, longest):  # pieces that share a slot lie side by side
            more = np.flatnonzero(out.ravel() < 0)
            place = at.ravel()[more] + k
            hit = known[place] == hashes.ravel()[more]
            out.ravel()[more[hit]] = numbers[place[hit]]
        return out

    def pieces(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece at each start (row) of each word (column); self.size stands for an unknown
        character, self.size + 1 for padding (code 0), -1 for no piece. `codes` are code points + 1, a row a place."""
        out, hashes = {}, np.zeros(codes.shape, np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, min(len(codes), self.longest) + 1):
                hashes = hashes[: len(codes) - length + 1] * self._BASE + codes[length - 1 :]
                found = self._find(length, hashes)
                if length == 1:
                    found = np.where(codes == 0, self.size + 1, np.where(found < 0, self.size, found)).astype(np.int32)
                out[length] = found
        return out


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points + 1 of words, a column each; zeros before words of fewer than n characters."""
    raw = np.frombuffer("".join(w.rjust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = raw.reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
    out[out == 1] = 0
    return np.ascontiguousarray(out)


def _padded(prob: np.ndarray) -> np.ndarray:
    """prob, LEAST at least, with a row of ones for padding and, at the end, zeros for no piece."""
    return np.vstack([np.maximum(prob, LEAST), np.ones((1, prob.shape[1])), np.zeros((1, prob.shape[1]))])


def _add(alpha: np.ndarray, start: int, length: int, number: np.ndarray, padded: np.ndarray) -> None:
    """Go on from the sums at `start` by pieces of `length`, for the words that have one there."""
    at = np.flatnonzero(number >= 0)
    if len(at) == len(number):
        alpha[start + length] += alpha[start] * padded[number].reshape(len(number), *([1] * (alpha.ndim - 3)), -1)
    elif len(at):
        alpha[start + length, at] += alpha[start, at] * padded[number[at]].reshape(len(at), *([1] * (alpha.ndim - 3)), -1)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def word_scores(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language, over all its segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    padded, long = _padded(prob), []
    for n, places in _by_length(words).items():
        if n > STRETCH:
            long += places
            continue
        for at in range(0, len(places), 20_000):
            own = places[at : at + 20_000]
            found = lattice.pieces(_codes([words[i] for i in own], n))
            alpha = np.zeros((n + 1, len(own), prob.shape[1]))
            alpha[0] = 1
            for j in range(1, n + 1):
                for length in range(1, min(j, lattice.longest) + 1):
                    _add(alpha, j - length, length, found[length][j - length], padded)
            out[own] = np.log(alpha[n])
    if long:
        out[long] = _long_scores([words[i] for i in long], lattice, padded)
    return out


def _long_scores(words: list[str], lattice: Lattice, padded: np.ndarray) -> np.ndarray:
    """As word_scores, for words of any length: linear in their characters.

    Words are padded in front to whole stretches. The sums at the last `reach` places before a stretch determine those at its last
    `reach` places, linearly; so each stretch becomes a matrix per language, for many stretches at once, and a word's sum is the
    product of its own, scaled after each factor."""
    reach = lattice.longest
    size, languages = max(STRETCH, reach), padded.shape[1]
    lanes = []
    for i, w in enumerate(words):
        n = -(-len(w) // size)
        w = "\0" * (reach - 1) + w.rjust(n * size, "\0")
        lanes += [(i, w[k * size : k * size + size + reach - 1]) for k in range(n)]
    state, logs = np.zeros((len(words), reach, languages)), np.zeros((len(words), languages))
    state[:, -1] = 1
    for at in range(0, len(lanes), 500):
        own = lanes[at : at + 500]
        found = lattice.pieces(_codes([w for _, w in own], size + reach - 1))
        alpha = np.zeros((size + reach, len(own), reach, languages))  # place, stretch, place before it, language
        for r in range(reach):
            alpha[r, :, r] = 1
        for j in range(reach, size + reach):
            for length in range(1, reach + 1):
                _add(alpha, j - length, length, found[length][j - length], padded)
        matrices = alpha[-reach:].transpose(1, 0, 2, 3)
        for (i, _), m in zip(own, matrices):
            new = (m * state[i]).sum(axis=1)
            scale = new.max(axis=0)
            state[i], logs[i] = new / scale, logs[i] + np.log(scale)
    return np.log(state[:, -1]) + logs


def _expected(words: list[str], counts: np.ndarray, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of each language: forward and backward sums over all segmentations of words, or of the stretches
    of LEARNED characters of a longer one."""
    total = np.zeros_like(prob)
    cut = [(i, w[at : at + LEARNED]) for i, w in enumerate(words) for at in range(0, len(w), LEARNED)]
    words, counts = [w for _, w in cut], counts[[i for i, _ in cut]]
    padded = _padded(prob)
    long: dict[int, list[int]] = {}
    for n, places in _by_length(words).items():
        if n > STRETCH + 1:  # together with others up to an eighth longer
            step = 1 << max(0, n.bit_length() - 4)
            long.setdefault(-(-n // step) * step, []).extend(places)
            continue
        for at in range(0, len(places), 20_000):
            own = places[at : at + 20_000]
            found = lattice.pieces(_codes([words[i] for i in own], n))
            alpha = np.zeros((n + 1, len(own), prob.shape[1]))
            beta = np.zeros_like(alpha)
            alpha[0], beta[n] = 1, 1
            for j in range(1, n + 1):
                for length in range(1, min(j, lattice.longest) + 1):
                    _add(alpha, j - length, length, found[length][j - length], padded)
            weight = counts[own] / alpha[n]
            for i in range(n - 1, -1, -1):
                for length in range(1, min(n - i, lattice.longest) + 1):
                    number = found[length][i]
                    real = np.flatnonzero(number >= 0)
                    if not len(real):
                        continue
                    number = number[real]
                    step = padded[number] * beta[i + length, real]
                    beta[i, real] += step
                    gamma = alpha[i, real] * step * weight[real]
                    for k in range(prob.shape[1]):
                        total[:, k] += np.bincount(number, weights=gamma[:, k], minlength=len(prob))
    for n, places in long.items():
        for at in range(0, len(places), max(1, 400_000 // n)):
            own = places[at : at + max(1, 400_000 // n)]
            _add_long(total, _codes([words[i] for i in own], n), counts[own], lattice, padded)
    return total


def _add_long(total: np.ndarray, codes: np.ndarray, counts: np.ndarray, lattice: Lattice, padded: np.ndarray) -> None:
    """Add the expected piece counts of words too long for plain sums: the forward sums are logs,
    and the backward ones, divided by them, are the probabilities that a piece starts at each place."""
    with np.errstate(divide="ignore"):
        logs = np.log(padded)
    n, found = len(codes), lattice.pieces(codes)
    alpha = np.zeros((n + 1, codes.shape[1], padded.shape[1]))
    starts = np.zeros_like(alpha)
    starts[n] = 1
    reach = [[x for x in range(1, min(j, lattice.longest) + 1) if (found[x][j - x] >= 0).any()] for j in range(n + 1)]
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - x] + logs[found[x][j - x]] for x in reach[j]])
    for j in range(n, 0, -1):
        for x in reach[j]:
            number = found[x][j - x]
            gamma = np.exp(alpha[j - x] + logs[number] - alpha[j]) * starts[j]
            starts[j - x] += gamma
            real = (number >= 0) & (number < len(total))
            np.add.at(total, number[real], (gamma * counts)[real])


def words_of(text: str) -> list[str]:
    """What stands between white space, in lower case, without marks at its ends."""
    return [w for x in text.lower().split() if (w := x.strip(_MARKS))]


class Model:
    """Languages, their piece probabilities (last row: an unknown character) and log priors."""

    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray, prior: np.ndarray):
        self.languages, self.pieces, self.prob, self.prior = languages, pieces, prob, prior

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "pieces", "prob", "prior")}

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; `und` and 0 for a null text and one without letters."""
        if "lattice" not in self.__dict__:
            none = np.zeros((0, len(self.languages)))
            self.lattice, self.known, self.table, self.old = Lattice(self.pieces), {}, none, ({}, none)
        docs = [words_of(t) if self.languages and t and _LETTER.search(t) else [] for t in texts]
        fresh = list({w for d in docs for w in d} - self.known.keys())
        if len(self.known) + len(fresh) > CACHE and self.known:  # the words since the last change are kept at hand
            self.old = self.known, self.table
            self.known, self.table = {}, np.zeros((0, len(self.languages)))
            fresh = list({w for d in docs for w in d})
        if fresh:
            before, rows = self.old
            kept = [w for w in fresh if w in before]
            new = [w for w in fresh if w not in before]
            if len(self.known) + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(fresh), len(self.table)), len(self.languages)))])
            n = len(self.known)
            self.table[n : n + len(kept)] = rows[[before[w] for w in kept]]
            self.table[n + len(kept) : n + len(fresh)] = word_scores([_SPACE + w for w in new], self.lattice, self.prob)
            self.known.update(zip(kept + new, range(n, n + len(fresh))))
        languages, best = [], []
        for d in docs:
            if not d:
                languages.append("und")
                best.append(0.0)
                continue
            at = np.fromiter(map(self.known.__getitem__, d), np.int64, len(d))
            total = self.table[at].sum(axis=0) + self.prior
            k = int(total.argmax())
            languages.append(self.languages[k])
            best.append(float(1 / np.exp(total - total[k]).sum()))
        return languages, best


def train(texts: list[str], languages: list[str], pieces: list[str]) -> Model:
    """Fit piece probabilities to labelled texts by expectation maximisation over all segmentations. Words of over
    LEARNED characters are learned from stretch by stretch."""
    names = sorted(set(languages))
    counts: dict[str, Counter] = {n: Counter() for n in names}
    for t, lang in zip(texts, languages):
        counts[lang].update(words_of(t))
    words = sorted(set().union(*counts.values())) if names else []
    table = np.array([[counts[n][w] for n in names] for w in words], float).reshape(len(words), len(names))
    lattice = Lattice(pieces)
    marked = [_SPACE + w for w in words]
    prob = np.full((len(pieces) + 1, len(names)), 1 / (len(pieces) + 1))
    for _ in range(ROUNDS if words else 0):
        got = _expected(marked, table, lattice, prob)
        mean = got.sum(axis=1) + 0.05
        prob = (got + SMOOTHING * (mean / mean.sum())[:, None]) / (got.sum(axis=0) + SMOOTHING)
    docs = Counter(languages)
    return Model(names, pieces, prob, np.log([docs[n] / max(1, len(languages)) for n in names]) if names else np.zeros(0))


def fit(df: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Learn from rows with a language whose crc32(id as text) mod 3 is not 1: whole texts of at most
    `train_docs` rows of each language, those with the smallest hash of id, as far as they hold `train_chars` characters in all.
    That sample is what the driver holds; rows that repeat an id count as rows. A row that can't be among the sample, by its hash
    and its language's number of rows, isn't shuffled."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.crc32("id"), F.lit(0)) % 3 != 1)).withColumn("hash", F.xxhash64("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the model has a column for each
    near = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (2 * train_docs + 100) / n)  # of the range of hashes: twice the rows that are wanted, or all
        near = near | ((F.col("lang") == lang) & (F.col("hash") <= int(-(2**63) + share * (2**64 - 1025))))
    first = Window.partitionBy("lang").orderBy("hash", "id", F.xxhash64("text"))
    chosen = rows.filter(near).withColumn("n", F.row_number().over(first)).withColumn("chars", F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    got = chosen.filter((F.col("n") <= train_docs) & (F.col("chars") <= train_chars)).select("lang", "text").collect()
    return train([r["text"] for r in got], [r["lang"] for r in got], vocabulary(model_file or tokenizer_path("piece_bpe_32k.model")))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of df, and the language and score (its posterior, 0 to 1) of each row's whole text.

    Words are scored apart, since no piece reaches over white space; each distinct word is scored once per
    worker and cache; a word may be as long as its text (in scripts without spaces), which costs time and memory in
    proportion. Columns of df with the names of the new ones are replaced. Null texts and texts
    without letters are `und` with score 0; an empty table gives no rows. No shuffle."""
    kept = [c for c in df.columns if c not in (lang_out, score_out)]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                languages, scores = model.scores(part.column(kept.index(text_col)).cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*kept, lang_out, score_out])

    return df.mapInArrow(score, schema)


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
