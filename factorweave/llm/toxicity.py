"""Toxicity by compression distance.

Each word is mapped to two codes of eight bytes, one of its first five bytes and one of the whole, so
that a compressor can only match whole words and beginnings of words. Two zstandard
dictionaries are trained, one on toxic and one on ordinary texts: both hold the commonest ordinary
words; the toxic one adds the words that tell toxic texts, the other one more ordinary words. A text is
cut into windows of 16 words; what a window saves with the toxic dictionary against the ordinary one is
its distance. A logistic model, fitted to rows that the dictionaries weren't trained on, turns the
distances of a text's windows into a probability and so calibrates the threshold.

Training takes ``LABELLED`` labelled rows at most (drawn by a hash of the id, all if there are fewer),
one of each group of copies, which would make their own words telling: texts that agree in a min-hash
of their word trigrams. Word counts of two thirds of them train the dictionaries, the rest calibrates. Scores depend on
the text alone. Nulls and empty texts score by the model's intercept. Several labels of one id: the
highest counts; null labels are left out. Without labelled rows of both kinds every score is their
share (0 if there are none). Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Bound of the labelled rows that training reads.
LABELLED = 60_000
WINDOW = 16
STEM_BYTES = 5
#: Words that both dictionaries have, and those that tell toxic texts, at most.
COMMON_WORDS, TELLING_WORDS = 4096, 2048
#: Least G-squared of a telling word; among a million words about one reaches it by chance.
TELLING_FROM = 24.0
#: Times as frequent in toxic texts as in ordinary ones that a telling word must be.
TELLING_TIMES = 4
#: Signatures of a text by which copies are found.
SIGNATURES = 3
#: Bytes that a window must save to count as toxic.
SAVED = 4
THRESHOLD = 0.3

U64 = np.uint64


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    out = tx.LOWER[data]
    if len(out) > 1:
        after = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][after] += 0x20
    return out


def word_codes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in tx.pieces(batch, "text"):
        data, off = tx.flat(piece.column(piece.schema.get_field_index("text")))
        data = _folded(data)
        starts, ends, first = tx.words(data, off, tx.NON_ALNUM)
        codes = np.empty((len(starts), 2), U64)
        codes[:, 0] = tx.mix(tx.word_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES)))
        codes[:, 1] = tx.word_hashes(data, starts, ends)
        yield piece, codes.ravel(), 2 * first


class Dictionaries:
    """The two compressors, made anew in each process."""

    def __init__(self, common: np.ndarray, telling: np.ndarray):
        self.common, self.telling = common, telling
        self._pair: tuple | None = None

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.common, self.telling

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.common, self.telling = state
        self._pair = None

    def pair(self) -> tuple:
        if self._pair is None:
            made = []
            base, more = self.common[:COMMON_WORDS], self.common[COMMON_WORDS:]
            fill = np.resize(more if len(more) else base, len(self.telling)) if len(self.common) else self.telling
            for extra in (self.telling, fill):
                content = np.concatenate((extra[::-1], base[::-1])).tobytes()
                words = zstandard.ZstdCompressionDict(content.ljust(16, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=6, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
                words.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=words))
            self._pair = (made[0].compress, made[1].compress)
        return self._pair

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Of each window: bytes with the ordinary dictionary less those with the toxic one."""
        toxic, ordinary = self.pair()
        raw, step = codes.tobytes(), 16 * WINDOW
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in (raw[i : i + step] for i in range(0, len(raw), step))], np.float64)


FEATURES = 5


def features(distances: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES)
    if len(distances):
        hits = distances >= SAVED
        out[:] = (np.log1p(max(0.0, distances.max())), np.log1p(hits.sum()), hits.mean(), np.log1p(np.maximum(distances, 0).sum()), np.log1p(len(distances)))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, codes, first in word_codes(batch):
            sig = np.zeros((SIGNATURES, len(piece)), np.int64)
            full = np.flatnonzero(np.diff(first) > 0)
            grams = [tx.ngram_hashes(codes[first[i] + 1 : first[i + 1] : 2], 3) for i in full]
            begin = np.cumsum([0, *map(len, grams)])[:-1]
            for k in range(SIGNATURES if len(full) else 0):
                sig[k, full] = np.minimum.reduceat(tx.mix(np.concatenate(grams) ^ U64(0x5BD1E995 + k)), begin).view(np.int64)
            names = [n for n in piece.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(n)) for n in names), *map(pa.array, sig)], [*names, *(f"s{k}" for k in range(SIGNATURES))])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and ordinary texts of the task have each word; under word 0 how many there are."""
    totals: dict[bool, list] = {True: [], False: []}
    number = {True: 0, False: 0}

    def counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
        words, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(words, kind="stable")
        words, n = words[order], n[order]
        begin = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        return words[begin], np.add.reduceat(n, begin)

    for batch in batches:
        for piece, codes, first in word_codes(batch):
            toxic = piece.column(piece.schema.get_field_index("toxic")).to_pylist()
            for kind in (True, False):
                own = [np.unique(codes[first[i] : first[i + 1]]) for i, t in enumerate(toxic) if bool(t) == kind and first[i + 1] > first[i]]
                number[kind] += sum(bool(t) == kind for t in toxic)
                if own:
                    words = np.concatenate(own)
                    totals[kind] = [counts([*totals[kind], (words, np.ones(len(words), np.int64))])]
    for kind in (True, False):
        words, n = totals[kind][0] if totals[kind] else (np.zeros(0, U64), np.zeros(0, np.int64))
        words, n = np.append(words, U64(0)), np.append(n, number[kind])
        for i in range(0, len(words), 50_000):
            w, k = words[i : i + 50_000], n[i : i + 50_000]
            none = np.zeros(len(w), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k if kind else none), pa.array(none if kind else k)], ["word", "toxic", "ordinary"])


def _featured(dictionaries: Dictionaries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, codes, first in word_codes(batch):
                x = np.array([features(dictionaries.distances(codes[first[i] : first[i + 1]])) for i in range(len(first) - 1)])
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("toxic")), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    """Coefficients of a logistic model (the last is the intercept), by Newton's method with a ridge."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, dictionaries: Dictionaries, weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights

    def score(self, codes: np.ndarray) -> float:
        z = float(features(self.dictionaries.distances(codes)) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most so many labelled ids, each with its highest label."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > most:
        share = int((1 << 30) * (most - 6 * most**0.5) / n)
        labels = labels.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) < share).limit(most)
    return labels


def trained(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Learn from the documents of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) names."""
    fold = F.pmod(F.xxhash64(F.lit("toxicity fold"), "doc_id"), F.lit(3))
    docs = docs.select("doc_id", "text")
    drawn = docs.join(F.broadcast(_sample(labels.select("doc_id", "toxic"), most)), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    alone = drawn.select("doc_id", "toxic", "text").mapInArrow(_signed, f"doc_id {kind}, toxic int, " + ", ".join(f"s{k} bigint" for k in range(SIGNATURES)))
    for k in range(SIGNATURES):
        alone = alone.groupBy("toxic", f"s{k}").agg(F.min(F.struct("doc_id", *(f"s{i}" for i in range(SIGNATURES) if i != k))).alias("one")).select("toxic", f"s{k}", "one.*")
    known = docs.join(F.broadcast(alone.select("doc_id", "toxic").limit(most)), "doc_id")
    counts = known.where(fold > 0).select("text", "toxic").mapInArrow(_presence, "word bigint, toxic bigint, ordinary bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    both = [r for r in counts.where("word = 0").collect()]
    toxic, ordinary = (int(both[0].toxic), int(both[0].ordinary)) if both else (0, 0)
    if not toxic or not ordinary:
        share = toxic / max(1, toxic + ordinary)
        return Model(Dictionaries(np.zeros(0, U64), np.zeros(0, U64)), np.append(np.zeros(FEATURES), np.log(share / (1 - share)) if 0 < share < 1 else 30.0 * (2 * share - 1)))
    a, b, p = F.col("toxic") / toxic, F.col("ordinary") / ordinary, (F.col("toxic") + F.col("ordinary")) / (toxic + ordinary)
    part = lambda k, n, q: k * F.ln(F.greatest(q, F.lit(1e-12))) + (n - k) * F.ln(F.greatest(1 - q, F.lit(1e-12)))
    g2 = 2 * (part(F.col("toxic"), toxic, a) + part(F.col("ordinary"), ordinary, b) - part(F.col("toxic"), toxic, p) - part(F.col("ordinary"), ordinary, p))
    words = counts.where("word <> 0")
    telling = words.where(a >= TELLING_TIMES * b).withColumn("g2", g2).where(F.col("g2") >= TELLING_FROM).orderBy(F.desc("g2"), "word").limit(TELLING_WORDS)
    telling = np.array([r.word for r in telling.select("word").collect()], np.int64).view(U64)
    common = words.where("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(COMMON_WORDS + 2 * TELLING_WORDS)
    common = np.array([r.word for r in common.select("word").collect()], np.int64).view(U64)
    dictionaries = Dictionaries(common[~np.isin(common, telling)][: COMMON_WORDS + TELLING_WORDS], telling)
    rows = known.where(fold == 0).select("text", "toxic").mapInArrow(_featured(dictionaries), "toxic int, x array<double>").collect()
    x, y = np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.toxic for r in rows], np.float64)
    return Model(dictionaries, fitted(x, y) if 0 < y.sum() < len(y) else np.append(np.zeros(FEATURES), np.log(toxic / ordinary)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, codes, first in word_codes(batch):
                scores = [model.score(codes[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i, n in enumerate(piece.schema.names) if n != "text"), pa.array(scores, pa.float64())], [*(n for n in piece.schema.names if n != "text"), "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, codes, first in word_codes(batch):
                keep = [model.score(codes[first[i] : first[i + 1]]) < threshold for i in range(len(first) - 1)]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
