"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed against it greedily: a phrase is the longest
match with the labelled text from where the last phrase ended, which is one walk through the automaton from its start
state. The fewer phrases a text needs, the better the language explains it; phrases are normalised by the text's length and by the logarithm of the
language's sample. The language with the fewest normalised phrases wins; equal ones are told apart by the phrases' description length
(the logarithm of how often each phrase occurs in the sample), then by name.

Texts are read as lower-cased UTF-8 whose runs of ASCII bytes other than letters count as one space, with a space at both ends. An automaton is one table
(state by byte class: next state, and the phrases that end), so a batch of texts is parsed in lockstep: texts are cut in blocks of ``BLOCK`` bytes,
each parsed from the start state, and a step of NumPy takes one byte of every block. A phrase therefore ends with its block.

Learning takes about ``SAMPLE_ROWS`` rows a language by a hash of their id (fewer where there are over 40 languages), and of each a span of at most ``SPAN``
characters at a place drawn from its text's hash; the spans go to the tasks, which build the automata once per worker. All rows are predicted, from whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learnt; letters that no sample has are phrases
of their own in every language; rows without an id or language are not learnt from; of rows that share id and language one is; repeated rows are
predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, id_and_text, kept, table
from quillgrid.llm.quality import held_out

SAMPLE_ROWS = 150
#: Over all languages together.
MOST_ROWS = 6000
SPAN = 600
BLOCK = 512
UNKNOWN = "und"
#: Byte classes: what parts spans of a sample, a space; letters follow, and last what no sample has.
BREAK, SPACE = 0, 1

#: language: the normalised spans of its sample.
Samples = dict[str, list[bytes]]

_KIND = np.arange(256, dtype=np.uint8)
_KIND[:128] = 0x20
_KIND[0x61:0x7B] = np.arange(0x61, 0x7B)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as parsed, and where each begins and the last one ends."""
    raw = [b" %b " % t.lower().encode("utf-8", "replace") for t in texts]
    data = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    stays = np.ones(len(data), bool)
    space = data == 0x20
    stays[1:] = ~(space[1:] & space[:-1])
    stays[edges[:-1][edges[:-1] < len(data)]] = True
    before = np.concatenate([[0], np.cumsum(stays)])
    return data[stays], before[edges]


class Automaton:
    """A language's suffix automaton as a table: what each state makes of each byte class."""

    def __init__(self, spans: list[bytes], classes: np.ndarray):
        self.n_classes = k = int(classes.max()) + 1
        text = [c for s in spans for c in (BREAK, *classes[np.frombuffer(s, np.uint8)].tolist())]
        follows, link, length, seen = self._states(text)
        self.size = max(2, len(text))
        # occurrences of a state are those of the states that its link tree has below it
        for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            seen[max(0, link[s])] += seen[s]
        # states by how often they occur, the start first: those that are met most lie together
        order = np.lexsort((-np.array(seen), np.arange(len(seen)) > 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.bits = np.log2(self.size / np.maximum(1, np.array(seen, np.float64)))[order]
        self.bits[0] = 0
        self.unseen_bits = math.log2(self.size) + 1
        first = np.full(k, -1, np.int64)
        first[list(follows[0])] = rank[list(follows[0].values())]
        first[BREAK] = -1
        # next state times classes, above two bits: the phrase so far ends here; the byte is a phrase of its own
        start = np.where(first < 0, 0, first) * k * 4
        self.table = np.empty((len(order), k), np.int64)
        self.table[:] = start + np.where(first < 0, 3, 1)
        self.table[0] = start + np.where(first < 0, 2, 0)
        keys = np.fromiter((s * k + c for s, own in enumerate(follows) for c in own), np.int64)
        self.table[rank[keys // k], keys % k] = rank[np.fromiter((t for own in follows for t in own.values()), np.int64, len(keys))] * k * 4
        self.table[:, BREAK] = 0
        self.table = self.table.astype(np.int32 if self.table.max() < 2**31 else np.int64).ravel()

    @staticmethod
    def _states(text: list[int]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
        """Transitions, suffix links, longest lengths and own end positions of the states; state 0 is the start."""
        follows: list[dict[int, int]] = [{}]
        link, length, seen, last = [-1], [0], [0], 0
        for c in text:
            new = len(length)
            follows.append({})
            length.append(length[last] + 1)
            link.append(0)
            seen.append(1)
            p = last
            while p >= 0 and c not in follows[p]:
                follows[p][c] = new
                p = link[p]
            if p >= 0:
                q = follows[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(length)
                    follows.append(dict(follows[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    seen.append(0)
                    while p >= 0 and follows[p].get(c) == q:
                        follows[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        return follows, link, length, seen

    def parse(self, lanes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and their bits of blocks in lockstep: ``lanes`` has a block a column, the longest first, and ``active`` blocks at each step."""
        state = np.zeros(lanes.shape[1], self.table.dtype)
        every = np.arange(lanes.shape[1])
        at, left, kinds = [], [], []
        for step, n in enumerate(active.tolist()):
            now = state[:n]
            found = self.table[now + lanes[step, :n]]
            over = np.flatnonzero(found & 3)
            at.append(over)
            left.append(now[over])
            kinds.append(found[over] & 3)
            state[:n] = found >> 2
        # each block's last phrase ends with it
        ended, states, kind = np.concatenate([*at, every]), np.concatenate([*left, state]), np.concatenate([*kinds, (state > 0).astype(state.dtype)])
        phrases = np.bincount(ended, (kind & 1) + (kind >> 1), len(every)).astype(np.int64)
        return phrases, np.bincount(ended, self.bits[states // self.n_classes] + (kind >> 1) * self.unseen_bits, len(every))


class Parser:
    """The automata of all languages, in order of their names."""

    def __init__(self, samples: Samples):
        self.languages = sorted(samples)
        used = np.unique(np.frombuffer(b"".join(s for spans in samples.values() for s in spans), np.uint8))
        letters = used[used != 0x20]
        self.classes = np.full(256, len(letters) + 2, np.uint8)
        self.classes[letters] = np.arange(len(letters)) + 2
        self.classes[0x20] = SPACE
        self.automata = [Automaton(samples[x], self.classes) for x in self.languages]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, their bits, bytes of each text)."""
        data, edges = normalised(texts)
        sizes = np.diff(edges)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        of = np.repeat(np.arange(len(texts)), blocks)
        rows = np.zeros((len(of), BLOCK), np.uint8)
        codes, flat = self.classes[data], rows.ravel()
        for at, a, b in zip((first * BLOCK).tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            flat[at : at + b - a] = codes[a:b]
        lengths = np.minimum(BLOCK, sizes[of] - BLOCK * (np.arange(len(of)) - first[of]))
        order = np.argsort(-lengths, kind="stable")
        of, lengths = of[order], lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        lanes = np.ascontiguousarray(rows[order, :longest].T)
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        phrases, bits = np.zeros((len(self.automata), len(texts)), np.int64), np.zeros((len(self.automata), len(texts)))
        for row, a in enumerate(self.automata):
            p, b = a.parse(lanes, active)
            phrases[row] = np.bincount(of, p, len(texts)).astype(np.int64)
            bits[row] = np.bincount(of, b, len(texts))
        return phrases, bits, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, phrases of the language) of each text."""
        lettered = np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
        if not self.automata or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        phrases, bits, sizes = self.parse([t or "" for t in texts])
        logs = np.array([math.log2(a.size) for a in self.automata])
        rates = phrases * logs[:, None] / sizes
        order = np.lexsort((np.broadcast_to(np.arange(len(logs))[:, None], rates.shape), np.round(bits, 6), np.round(rates, 12)), axis=0)
        every = np.arange(len(texts))
        best, second = rates[order[0], every], rates[order[min(1, len(logs) - 1)], every]
        score = 1 - best / second if len(logs) > 1 else np.ones(len(texts))
        return [self.languages[x] if y else UNKNOWN for x, y in zip(order[0], lettered)], np.where(lettered, np.clip(score, 0, 1), 0.0), np.where(lettered, phrases[order[0], every], 0)


def learn(docs: DataFrame, folds: int = 4, fold: int = 2, most_rows: int = SAMPLE_ROWS, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Samples:
    """Each language's sample from the rows outside the held-out fold: at most about ``MOST_ROWS`` spans in all."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    usable = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    # ids and languages only; one row a language, and an id of very many rows counts once
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not rows:
        return {}
    share = max(1, min(most_rows, MOST_ROWS // len(rows)))
    limits = docs.sparkSession.createDataFrame([(x, (share << 63) // n if n > share else (1 << 63) - 1) for x, n in rows.items()], "lang string, below long")
    picked = usable.join(F.broadcast(limits), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.col("below"))
    long = F.length("text") > span
    # the place is drawn from the text's own hash
    at = F.when(long, F.pmod(F.xxhash64("text"), F.length("text") - span + 1)).otherwise(0) + 1
    cut = picked.select("lang", "doc_id", F.xxhash64("text").alias("hash"), F.substring("text", at, F.lit(span)).alias("span"))
    one = cut.where(F.col("span") != "").groupBy("lang", "doc_id").agg(F.min_by("span", "hash").alias("span")).collect()
    out: Samples = {}
    for r in sorted(one, key=lambda r: (r["lang"], r["doc_id"])):
        data, _ = normalised([r["span"]])
        if data.tobytes().strip():
            out.setdefault(r["lang"], []).append(data.tobytes())
    return out


def predict(docs: DataFrame, samples: Samples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, phrases`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most MOST_ROWS spans
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = kept(("language", key), lambda: Parser(shared.value))
        for b in arrow_batches(batches, most_bytes=4 << 20):
            languages, score, phrases = parser.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(languages, pa.string()), pa.array(score), pa.array(phrases)], ["doc_id", "lang_pred", "score", "phrases"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, phrases long")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "phrases")
