"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of word characters and runs of symbols. A word that repeats the one before it becomes
one fixed word, and each word also has a form (capitals, small letters, title, digits, the symbols
themselves); features are words, pairs of words, forms, and pairs and triples of forms, hashed into 2**18
places, with the share of the text's words that they have as value. Training is FTRL-proximal, a row
at a time, over a few epochs; scoring is a sparse dot product and a logistic.

Labels are learnt from a bounded sample (``SAMPLE_ROWS`` labelled rows by a hash of their id, none where
there are fewer): features are taken on the executors, the model is fitted in one task, and the
weights (a table whose size is fixed) go to every task in the closure. All rows are scored.

Defined results: a null or empty text scores what the intercept alone gives; repeated rows and ids are scored
alike; a null doc_id is kept and never learnt from; of rows that share an id one is learnt from; with no usable label every score is 0.5; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, id_and_text, kept, table, written

PLACES = 1 << 18
SAMPLE_ROWS = 6000
EPOCHS = 4
SCALE = 10.0
THRESHOLD = 0.3
MEMO_WORDS = 600_000
#: Seeds of the kinds of n-gram.
WORD, PAIR, FORM, FORM_PAIR, FORM_TRIPLE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _form(word: str) -> str:
    if not word[0].isalnum() and word[0] != "_":
        return word[:4]
    if word.isdigit():
        return "0"
    if len(word) > 1 and word.isupper():
        return "AA"
    return "Aa" if word[0].isupper() else "aa"


class _Hashes(dict):
    """(hash of the lower-cased word, hash of its form) of each word, remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word.lower().encode()), xxhash.xxh64_intdigest(_form(word).encode())
        return value


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each n-gram, text it is of, words of each text)."""
    memo = kept(("ngrams",), _Hashes)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = [_TOKEN.findall(x) for x in texts]
    counts = np.array([len(w) for w in words], np.int64)
    n = int(counts.sum())
    get = memo.__getitem__
    both = np.fromiter(chain.from_iterable(map(get, chain.from_iterable(words))), np.uint64, 2 * n).reshape(-1, 2)
    of = np.repeat(np.arange(len(texts)), counts)
    h, form = both[:, 0].copy(), both[:, 1].copy()
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    h[same] = form[same] = np.uint64(1)
    near = of[1:] == of[:-1]
    next_but_one = of[2:] == of[:-2]
    kinds = [
        (h * WORD, of),
        ((h[:-1] * PAIR + h[1:])[near] * PAIR, of[1:][near]),
        (form * FORM, of),
        ((form[:-1] * FORM_PAIR + form[1:])[near] * FORM_PAIR, of[1:][near]),
        (((form[:-2] * FORM_TRIPLE + form[1:-1]) * FORM_TRIPLE + form[2:])[next_but_one] * FORM_TRIPLE, of[2:][next_but_one]),
    ]
    return np.concatenate([(x >> np.uint64(46)).astype(np.int64) for x, _ in kinds]), np.concatenate([o for _, o in kinds]), counts


def examples(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct places, values) of each text, for training."""
    places, of, counts = ngrams(texts)
    keys, times = np.unique(of * PLACES + places, return_counts=True)
    edges = np.searchsorted(keys, np.arange(len(texts) + 1) * PLACES)
    return [(keys[a:b] % PLACES, times[a:b] * (SCALE / max(1, c))) for a, b, c in zip(edges, edges[1:], counts)]


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal for logistic loss; place ``PLACES`` is the intercept."""

    def __init__(self, places: int = PLACES, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ values)) - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    model = Ftrl()
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[i])
    return model.weights().astype(np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    places, of, counts = ngrams(texts)
    dots = np.bincount(of, weights[places], len(texts)) * SCALE / np.maximum(1, counts)
    return sigmoid(dots + weights[-1])


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that nothing is learnt from: crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label``: about ``most_rows`` labelled rows outside the held-out fold, by a hash of the id.

    One row for each id, that of the smallest hash of its text: an id that very many rows share stays one example.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = usable.count()
    # the hash as a number from 0 to 2**63 - 1, so that the share is exact at any size
    picked = usable if n <= most_rows else usable.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < (most_rows << 63) // n)
    # ``most_rows`` bounds this side
    met = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, fold: int = 0, most_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights (float32, the intercept last), fitted in one task on the sample's features."""
    sample = labelled_sample(docs, labels, label_col, folds, fold, most_rows, id_col, text_col)

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches):
            found = examples(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), b.column(2), pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "label", "places", "shares"])

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4"), y) for b in batches for i, y, p, v in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
        weights = fit([(p, v.astype(np.float64), y) for _, p, v, y in rows])
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    features = written(sample.mapInArrow(featured, "doc_id long, label int, places binary, shares binary"), "features")
    found = features.repartition(1).mapInArrow(fitted, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros(PLACES + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, most_bytes=2 << 20):
            yield pa.record_batch([b.column(0), pa.array(scores(b.column(1).to_pylist(), shared.value))], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), "quality", 5, 0))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
