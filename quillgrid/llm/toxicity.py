"""Toxicity by multiple-instance learning: sentences scored, joined by noisy-or, located.

A document is a bag of sentences; a sentence ends after a word with ``.``, ``!`` or ``?``, at a line feed, or after
``LONGEST`` words. A word that repeats the one before it counts once. A word (lower-cased, edges stripped of what
is no letter or digit) has hashed features: itself and
its first four to eight letters. A sentence's logit is the intercept plus the weights of its words'
features, its probability p the logistic of that, and the document's probability 1 - prod(1 - p). Only
documents have labels; the likelihood's gradient is shared out among the sentences by the noisy-or, which
finds out which of them are to blame. Weights move by AdaGrad with an L1 shrinkage. Three fits on two thirds each score
the last third; the score that parts the labels best there becomes ``THRESHOLD`` by a shift of all logits.

Labels are learnt from a bounded sample (``SAMPLE_ROWS`` labelled rows by a hash of their id, both labels alike). Features are
taken on the executors, each of the four fits is one task over the sample, and weights (a
table of fixed size) go to every task. All rows are scored, and ``locate`` gives the offending sentences.

Defined results: a null or empty text has no sentence and scores 0; repeated rows and ids are scored alike; a null
doc_id is kept and never learnt from; with no usable label every document scores near 0; an empty table gives no
rows; other columns are ignored by ``score`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, forget, id_and_text, kept, rows_a_batch, table, written
from quillgrid.llm.quality import held_out, labelled_sample, sigmoid

PLACES = 1 << 20
SAMPLE_ROWS = 12_000
#: Training passes over the sample until so many documents have been seen: two passes at least, 40 at most.
STEPS = 72_000
#: Fits for the shift.
FOLDS = 3
#: Bags that go to a fit at once: one takes some kilobytes, and Spark's own batches of 10,000 rows would fill buffers outside the heap.
BAGS_A_BATCH = 256
LONGEST = 40
THRESHOLD = 0.3
#: A sentence offends from this probability on.
OFFENDING = 0.3
INTERCEPT = -9.0
RATE = 0.5
SHRINK = 0.0005
PREFIXES = range(4, 9)
MEMO_WORDS = 400_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"\S+")


def places_of(word: str) -> tuple[int, ...]:
    """Places of a word's features; a bare mark has none."""
    import xxhash

    word = _EDGES.sub("", word).lower()
    if not word:
        return ()
    names = [f"={word}", *(f"<{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return tuple(xxhash.xxh64_intdigest(x.encode()) % PLACES for x in names)


def shifted(none: np.ndarray, shift: float) -> np.ndarray:
    """Probability that some sentence is toxic, its logit moved, by the log of the probability that none is."""
    some = -np.expm1(np.minimum(none, 0))
    return np.where(some > 0, sigmoid(np.log(np.maximum(some, 1e-300)) - none + shift), 0.0)


class Vocabulary:
    """A number for each distinct word, with its features' places (and weight) and whether it ends a sentence."""

    def __init__(self, weights: np.ndarray | None = None):
        self.given = weights
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.places: list[tuple[int, ...]] = []
        self.weights, self.ends = np.empty(0), np.empty(0, bool)

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.numbers))
        if not new:
            return
        if len(self.numbers) > MEMO_WORDS:
            self.clear()
            new = sorted(words)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        found = [places_of(w) for w in new]
        self.ends = np.concatenate([self.ends, np.fromiter((w[-1] in ".!?" for w in new), bool, len(new))])
        if self.given is None:
            self.places += found
            return
        counts = np.array([len(x) for x in found], np.int64)
        flat = self.given[np.fromiter((p for x in found for p in x), np.int64, int(counts.sum()))]
        sums = np.concatenate([[0.0], np.cumsum(flat, dtype=np.float64)])
        stops = np.cumsum(counts)
        # rounded, so that a word weighs the same whatever words are learnt with it
        self.weights = np.concatenate([self.weights, np.round(sums[stops] - sums[stops - counts], 6)])

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, whether it repeats the one before, first word of each sentence, first sentence of each text and the end)."""
        lines = [[own for line in x.split("\n") if (own := line.split())] for x in texts]
        counts = np.array([len(own) for x in lines for own in x], np.int64)
        self.learn({w for x in lines for own in x for w in own})
        n = int(counts.sum())
        numbers = np.fromiter(map(self.numbers.__getitem__, (w for x in lines for own in x for w in own)), np.int64, n)
        opens = np.zeros(n, bool)
        opens[np.cumsum(counts) - counts] = True
        opens[1:] |= self.ends[numbers[:-1]]
        at = np.arange(n)
        opens |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % LONGEST == 0
        again = np.zeros(n, bool)
        again[1:] = (numbers[1:] == numbers[:-1]) & ~opens[1:]
        starts = np.flatnonzero(opens)
        words = np.array([sum(map(len, x)) for x in lines], np.int64)
        edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(words)]))
        return numbers, again, starts, edges


class Scorer:
    """Probabilities of sentences and texts under given weights (the intercept and the shift last)."""

    def __init__(self, weights: np.ndarray):
        self.intercept, self.shift = float(weights[-2]), float(weights[-1])
        self.vocabulary = Vocabulary(weights)

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(logit and first word of each sentence, first sentence of each text and the end, words)."""
        numbers, again, starts, edges = self.vocabulary.cut(texts)
        values = np.where(again, 0.0, self.vocabulary.weights[numbers]) if len(numbers) else np.empty(0)
        sums = np.add.reduceat(values, starts) if len(starts) else values
        return sums + self.intercept, starts, edges, len(numbers)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(noisy-or of the sentences, number of offending ones) of each text."""
        logits, _, edges, _ = self.sentences(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(edges))
        none = np.bincount(of, np.log1p(-sigmoid(logits)), len(texts))
        return shifted(none, self.shift), np.bincount(of, sigmoid(logits + self.shift) >= OFFENDING, len(texts)).astype(np.int64)

    def offending(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each offending sentence, in code points."""
        logits, starts, _, n = self.sentences([text])
        p = sigmoid(logits + self.shift)
        bad = np.flatnonzero(p >= OFFENDING)
        if not len(bad):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        ends = np.append(starts[1:], n)
        return [(spans[starts[i]][0], spans[ends[i] - 1][1], float(p[i])) for i in bad]


def bags(texts: list[str], vocabulary: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, number of places of each sentence) of each text, for training."""
    numbers, again, starts, edges = vocabulary.cut(texts)
    found = [() if r else vocabulary.places[i] for i, r in zip(numbers, again)]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    sizes = np.add.reduceat(counts, starts) if len(starts) else counts
    places = np.fromiter((p for x in found for p in x), np.int32, int(counts.sum()))
    stops = np.concatenate([[0], np.cumsum(sizes)])[edges]
    return [(places[s:e], sizes[a:b]) for s, e, a, b in zip(stops, stops[1:], edges, edges[1:])]


class Bags:
    """The bags of a sample inside their Arrow buffers: (places, places of each sentence, label) by number."""

    def __init__(self, batches: list[pa.RecordBatch]):
        order = [(i, y, n, k, r) for k, b in enumerate(batches) for r, (i, y, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(2)).to_pylist()))]
        self.batches, self.order = batches, sorted(order)

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        _, label, _, k, row = self.order[at]
        own = self.batches[k]
        return np.frombuffer(own.column(2)[row].as_buffer(), "<i4"), np.frombuffer(own.column(3)[row].as_buffer(), "<i4"), label


def gradient(at: np.ndarray, sizes: np.ndarray, label: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(distinct places, slopes of the log-likelihood by their weights, slope by the intercept) of one bag."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    p = sigmoid(np.bincount(of, w[at], len(sizes)) + w[-1])
    none = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()  # log of no sentence being toxic
    some = -np.expm1(none)
    # slope by each sentence's logit
    slope = np.exp(none) * p / max(some, 1e-9) if label else -p
    move = slope[of]
    order = np.argsort(at, kind="stable")
    own, first = np.unique(at[order], return_index=True)
    return own, np.add.reduceat(move[order], first), float(slope.sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]] | Bags, steps: int = STEPS, places: int = PLACES) -> np.ndarray:
    """Weights, the intercept last."""
    w, g2 = np.zeros(places + 1), np.full(places + 1, 1e-3)
    w[-1] = INTERCEPT
    for epoch in range(min(40, max(2, steps // max(1, len(rows))))):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, sizes, label = rows[i]
            if not len(at):
                continue
            own, g, of_intercept = gradient(at, sizes, label, w)
            g2[own] += g * g
            step = RATE / np.sqrt(g2[own])
            new = w[own] + step * g
            w[own] = np.sign(new) * np.maximum(np.abs(new) - step * SHRINK, 0)
            g2[-1] += of_intercept * of_intercept
            w[-1] += 0.1 * RATE / np.sqrt(g2[-1]) * of_intercept
    return w


def nothing_toxic(bag: tuple[np.ndarray, np.ndarray, int], w: np.ndarray) -> float:
    """Log of the probability that no sentence of a bag is toxic."""
    at, sizes, _ = bag
    if not len(sizes):
        return 0.0
    return float(np.log1p(-sigmoid(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[at], len(sizes)) + w[-1])).sum())


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The score that parts the labels best by F1, in the middle of equally good ones; None without both labels."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    last = np.append(s[1:] != s[:-1], True) & (s > 0)
    if not last.any() or not 0 < y.sum() < len(y):
        return None
    f1 = 2 * np.cumsum(y)[last] / (np.arange(1, len(s) + 1)[last] + y.sum())
    good = s[last][f1 >= f1.max() - 1e-9]
    # a cut is anywhere down to the next lower score
    below = s[last][s[last] < good.min()]
    return float(np.sqrt(good.max() * good.min())) if len(good) > 1 else float(np.sqrt(good[0] * (below[0] if len(below) else good[0])))


def fit_part(rows: list[tuple[np.ndarray, np.ndarray, int]] | Bags, k: int, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, log of no toxic sentence, labels): part ``folds`` is the fit on all rows, part k < ``folds`` scores every ``folds``th row by a fit on the others."""
    if k == folds:
        return fit(rows).astype(np.float32), np.empty(0), np.empty(0, np.int64)
    part = fit([rows[i] for i in range(len(rows)) if i % folds != k], STEPS // folds)
    held = [rows[i] for i in range(k, len(rows), folds)]
    return np.empty(0, np.float32), np.array([nothing_toxic(x, part) for x in held]), np.array([y for *_, y in held], np.int64)


def shift_of(none: np.ndarray, labels: np.ndarray) -> float:
    """What moves the best cut of held-out scores to ``THRESHOLD``."""
    cut = best_cut(-np.expm1(none), labels)
    return 0.0 if cut is None else float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - min(cut, 1 - 1e-9))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, most_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted on the sample's features: three fits for the shift and one for the weights, a task each."""
    sample = labelled_sample(docs, labels, label_col, folds, fold, most_rows, id_col, text_col)

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vocabulary = Vocabulary()
        for b in arrow_batches(batches):
            found = bags(b.column(1).to_pylist(), vocabulary)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())], ["doc_id", "label", "places", "sentences"])

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            part, own = b.column(0).to_numpy(), pa.record_batch(b.columns[1:], b.schema.names[1:])
            for k in np.unique(part).tolist():
                held.setdefault(k, []).append(own if (part == k).all() else own.filter(pa.array(part == k)))
        for k, own in held.items():
            found = fit_part(Bags(own), k)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in found], ["weights", "none", "labels"])

    features = written(sample.mapInArrow(featured, "doc_id long, label int, places binary, sentences binary"), "bags")
    parts = features.select(F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part"), "doc_id", "label", "places", "sentences")
    # the driver gets weights of a fixed size, and a number and a label for each row of the sample
    with rows_a_batch(docs.sparkSession, BAGS_A_BATCH):
        found = parts.repartitionByRange(FOLDS + 1, "part").mapInArrow(fitted, "weights binary, none binary, labels binary").collect()
    weights = [w for r in found if len(w := np.frombuffer(r["weights"], np.float32))]
    if not weights:
        return np.concatenate([np.zeros(PLACES), [INTERCEPT, 0.0]]).astype(np.float32)
    none, known = (np.concatenate([np.frombuffer(r[name], kind) for r in found]) for name, kind in (("none", np.float64), ("labels", np.int64)))
    return np.append(weights[0], shift_of(none, known)).astype(np.float32)


def _scorer(shared: _Shared) -> Scorer:
    """One scorer per worker process and broadcast."""
    return kept(("toxicity", shared.id), lambda: Scorer(shared.value))


class _Shared:
    """A broadcast and a name for it that worker processes can compare."""

    def __init__(self, spark: SparkSession, weights: np.ndarray):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(weights)

    @property
    def value(self) -> np.ndarray:
        return self.broadcast.value


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_offending`` for every row."""
    shared = _Shared(docs.sparkSession, weights)  # 4 MB, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in arrow_batches(batches):
            found, offending = scorer.documents(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(found), pa.array(offending)], ["doc_id", "score", "n_offending"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_offending long")


def locate(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, stop, score, sentence``: a row for each offending sentence."""
    shared = _Shared(docs.sparkSession, weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in arrow_batches(batches):
            rows = [(i, a, z, p, x[a:z]) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for a, z, p in scorer.offending(x)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "start", "stop", "score", "sentence"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, stop long, score double, sentence string")


def clean(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    shared = _Shared(docs.sparkSession, weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in arrow_batches(batches, column=at):
            found, _ = scorer.documents([x or "" for x in b.column(at).to_pylist()])
            yield b.filter(pa.array(found < threshold))

    # columns go by number meanwhile: names may have dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")
