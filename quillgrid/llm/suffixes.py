"""Repeated passages by sparse suffix arrays.

Words are what stands between ASCII white space, ASCII letters lower-cased. Of the suffixes of a
document only those are kept whose first ``base`` words hash to the smallest value among ``least -
base + 1`` neighbours (content-selected minimiser positions): every passage of ``least`` words
then keeps at least one suffix that begins with ``base`` of its words, wherever the passage
stands. The kept suffixes are sorted, each by a 64-bit hash of its first ``base`` words, the
words to the right of these and, nearest first, those to the left of it; each is compared with
the nearest suffix of another document on either side and the match is extended right and left.
The nearest suffix agrees furthest to the right; where another one may agree less to the right but
more to the left, so that ``least`` words are reached all the same, the windows in question are
looked up by their hash. Matches of ``least`` words or more are merged into passages. Words in extensions are compared by
16-bit hashes (a passage one word too short passes about once in 30,000 cases); as far as
``least - base`` words on each side, which is enough, as a longer passage keeps further suffixes.

Scale: suffixes with one hash meet in one partition, sorted and compared as a stream that holds
no more than one document's equal suffixes. Suffixes of one Arrow batch that agree in every
compared word settle each other before the shuffle and only one of them goes on for comparison,
so what thousands of documents share reaches a partition once a batch; the settled ones are dealt out
by a hash of their own.

Defined results: a null text is empty; texts of fewer than ``least`` words have no passage; a
passage must occur in two documents. A document is told by its doc_id and text, null ids too: rows with equal ids and other texts are
documents of their own (their passages are returned side by side under the one doc_id), rows that repeat both are one. Repeats
inside one document alone aren't reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, id_and_text, kept, table

LEAST = 50
BASE = 34
#: Odd, so that it has an inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
MEMO_WORDS = 600_000


class _Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n or more."""
    if len(_TABLES.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        _TABLES["up"] = _powers(size, MULTIPLIER)
        _TABLES["down"] = _powers(size, pow(MULTIPLIER, -1, 1 << 64))
    return _TABLES["up"], _TABLES["down"]


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` neighbours, by doubling; as long as ``values``, the tail repeats."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out, np.concatenate([out[step:], out[-1:].repeat(step)])[: len(out)])
        done += step
    return out


def minimisers(texts: list[str], least: int = LEAST, base: int = BASE) -> tuple[np.ndarray, ...]:
    """(text, word, hash, right, left) of the kept suffixes: indices, 64-bit hashes and 16-bit hashes of neighbours.

    Neighbours beyond the text are zero, which equals nothing.
    """
    span = least - base
    memo = kept(("suffixes",), _Hashes)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
    counts = np.array([len(w) if len(w) >= least else 0 for w in words], np.int64)
    total = int(counts.sum())
    if not total:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty((0, span), np.uint16), np.empty((0, span), np.uint16)
    get = memo.__getitem__
    h = np.fromiter((v for w, n in zip(words, counts) if n for v in map(get, w)), np.uint64, total)
    up, down = _tables(total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(h * up[:total], out=sums[1:])
    stops = np.cumsum(counts)
    # the last word index (exclusive) of each word's text
    stop = np.repeat(stops, counts)
    at = np.arange(total - base + 1)
    window = (sums[base:] - sums[:-base]) * down[: len(at)]
    window ^= window >> np.uint64(29)
    window *= np.uint64(0xBF58476D1CE4E5B9)
    window ^= window >> np.uint64(32)
    order = np.where(at + base <= stop[: len(at)], window, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = _sliding(order, span + 1, np.minimum)
    low = np.where(at + least <= stop[: len(at)], low, np.uint64(0))
    reached = _sliding(low[::-1], span + 1, np.maximum)[::-1]
    chosen = np.flatnonzero((reached == order) & (at + base <= stop[: len(at)]))
    short = np.maximum((h >> np.uint64(48)).astype(np.uint16), np.uint16(1))
    start = np.repeat(stops - counts, counts)
    right = chosen[:, None] + base + np.arange(span)
    left = chosen[:, None] - 1 - np.arange(span)
    right = np.where(right < stop[chosen][:, None], short[np.minimum(right, total - 1)], 0).astype(np.uint16)
    left = np.where(left >= start[chosen][:, None], short[np.maximum(left, 0)], 0).astype(np.uint16)
    return np.repeat(np.arange(len(texts)), counts)[chosen], chosen - start[chosen], window[chosen], right, left


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading neighbours that agree, row by row."""
    equal = (a == b) & (a != 0)
    return np.where(equal.all(1), a.shape[1], np.argmin(equal, 1))


def document_key() -> Column:
    """What tells a document inside: its id and text as one number."""
    return F.xxhash64("doc_id", F.xxhash64("text")).alias("doc_id")


def suffixes(docs: DataFrame, least: int, base: int, id_col: str, text_col: str) -> DataFrame:
    """``hash, key, doc_id (the document's key), word``: kept suffixes, and (key of 2 bytes: words left and right) settled ones."""
    span = least - base

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches):
            ids = b.column(0).to_numpy()
            text, word, hashed, right, left = minimisers(b.column(1).to_pylist(), least, base)
            doc = ids[text]
            key = np.concatenate([hashed.astype(">u8").view(np.uint8).reshape(-1, 8), right.astype(">u2").view(np.uint8).reshape(-1, 2 * span), left.astype(">u2").view(np.uint8).reshape(-1, 2 * span)], axis=1)
            # suffixes of this batch that agree in full, in two documents or more
            mixed = hashed.copy()
            for column in (*right.T, *left.T):
                mixed = (mixed ^ column) * np.uint64(MULTIPLIER)
            order = np.lexsort((doc, mixed))
            m, d = mixed[order], doc[order]
            first = np.ones(len(order), bool)
            first[1:] = m[1:] != m[:-1]
            group = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            tails = np.append(heads[1:], len(order)) - 1
            shared = (d[heads] != d[tails])[group] if len(order) else first
            both = _same(left, left)[order] + _same(right, right)[order] >= span
            settled = order[shared & both]
            sent = order[~(shared & both) | first]
            yield pa.record_batch([pa.array(hashed[sent].view(np.int64)), pa.array([x.tobytes() for x in key[sent]], pa.binary()), pa.array(doc[sent], pa.int64()), pa.array(word[sent], pa.int32())], ["hash", "key", "doc_id", "word"])
            if len(settled):
                ends = np.stack([_same(left, left), _same(right, right)], 1).astype(np.uint8)[settled]
                own = (doc[settled].view(np.uint64) * np.uint64(MULTIPLIER) + word[settled].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array([x.tobytes() for x in ends], pa.binary()), pa.array(doc[settled], pa.int64()), pa.array(word[settled], pa.int32())], ["hash", "key", "doc_id", "word"])

    source = id_and_text(docs, id_col, text_col)
    return source.select(document_key(), "text").mapInArrow(run, "hash long, key binary, doc_id long, word int")


def _mix(hashed: np.ndarray, columns: Iterable[np.ndarray]) -> np.ndarray:
    out = hashed.astype(np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(MULTIPLIER)
        out ^= out >> np.uint64(31)
    return out


def matches(sorted_suffixes: DataFrame, least: int, base: int) -> DataFrame:
    """``doc_id, start, stop, probe``: matches of ``least`` words or more (probe null), and windows to look up."""
    span = least - base
    width = 8 + 4 * span
    offsets = np.arange(span + 1)

    def given(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, probe: np.ndarray | None = None) -> pa.RecordBatch:
        probes = pa.nulls(len(doc), pa.int64()) if probe is None else pa.array(probe.view(np.int64))
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), probes], ["doc_id", "start", "stop", "probe"])

    def shares(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For each number of words to the left whether the window with these is shared."""
        return (offsets <= before[:, None]) & (span - offsets <= after[:, None])

    def compare(key: np.ndarray, doc: np.ndarray, word: np.ndarray, skip: bool, last: bool) -> tuple[list[pa.RecordBatch], int]:
        """Matches and probes of all runs (one hash, one document) but the first with ``skip`` and, unless ``last``, the last.

        Also the row from which on rows are needed again.
        """
        hashed = key[:, :8].copy().view(">u8")[:, 0]
        right, left = (key[:, a : a + 2 * span].copy().view(">u2") for a in (8, 8 + 2 * span))
        fresh = np.concatenate([[True], hashed[1:] != hashed[:-1]])
        begin = np.flatnonzero(fresh | np.concatenate([[True], doc[1:] != doc[:-1]]))
        run = np.zeros(len(doc), np.int64)
        run[begin[1:]] = 1
        run = np.cumsum(run)
        low = np.full(len(doc), np.iinfo(np.int64).max)
        high = np.full(len(doc), -1, np.int64)
        furthest = np.full(len(doc), -1, np.int64)
        known = np.zeros((len(doc), span + 1), bool)
        for other, there in ((begin[run] - 1, run > 0), (np.append(begin, len(doc) - 1)[run + 1], run + 1 < len(begin))):
            rows = np.flatnonzero(there)
            rows = rows[hashed[rows] == hashed[other[rows]]]
            to = other[rows]
            before, after = _same(left[rows], left[to]), _same(right[rows], right[to])
            furthest[rows] = np.maximum(furthest[rows], after)
            known[rows] |= shares(before, after)
            enough = base + before + after >= least
            rows = rows[enough]
            low[rows] = np.minimum(low[rows], word[rows] - before[enough])
            high[rows] = np.maximum(high[rows], word[rows] + base + after[enough])
        final = run < len(begin) - 1 if not last else np.ones(len(doc), bool)
        if skip:
            final &= run > 0
        found = np.flatnonzero(final & (high >= 0))
        out = [given(doc[found], low[found], high[found])] if len(found) else []
        # windows that a suffix further away may share: those of this one must be known to all of its hash
        rows = np.flatnonzero(furthest >= 0)
        if len(rows):
            own = shares(_same(left[rows], left[rows]), np.minimum(_same(right[rows], right[rows]), furthest[rows]))
            asked = own & ~known[rows]
            group = np.cumsum(fresh)[rows]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            wanted = np.logical_or.reduceat(asked, starts)
            # the first and the last hash may go on beyond these rows
            edge = np.isin(group[starts], (group[0] if fresh.sum() == 1 or skip else -1, int(fresh.sum()) if not last else -1, 1 if skip else -1))
            wanted |= edge[:, None]
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
            before = np.maximum(rows - 1, 0)
            first = (rows == 0) | (hashed[before] != hashed[rows])
            again = shares(_same(left[rows], left[before]), _same(right[rows], right[before])) & ~first[:, None]
            sent = (asked | own & known[rows] & ~again & wanted[of]) & final[rows][:, None]
            for s in offsets:
                at = rows[sent[:, s]]
                if len(at):
                    window = _mix(hashed[at], [np.full(len(at), s), *left[at, :s].T, *right[at, : span - s].T])
                    out.append(given(doc[at], word[at] - s, word[at] - s + least, window))
        return out, max(0, int(begin[-1]) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        skip = False
        for b in batches:
            doc, word = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            keys = b.column(0).to_pylist()
            short = np.fromiter((len(k) == 2 for k in keys), bool, len(keys))
            if short.any():
                ends = np.frombuffer(b"".join(k for k in keys if len(k) == 2), np.uint8).reshape(-1, 2).astype(np.int64)
                yield given(doc[short], word[short] - ends[:, 0], word[short] + base + ends[:, 1])
            rows = np.frombuffer(b"".join(k for k in keys if len(k) != 2), np.uint8).reshape(-1, width), doc[~short], word[~short]
            if held is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows))
            if not len(rows[1]):
                continue
            found, again = compare(*rows, skip, False)
            yield from found
            # kept: the last run, and before it one row of the run before
            held = tuple(x[again:].copy() for x in rows) if again else rows
            skip = bool(len(held[1]) > 1 and (held[1][0] != held[1][1] or (held[0][0, :8] != held[0][1, :8]).any()))
        if held is not None:
            yield from compare(*held, skip, True)[0]

    return sorted_suffixes.select("key", "doc_id", "word").mapInArrow(run, "doc_id long, start int, stop int, probe long")


def looked_up(found: DataFrame) -> DataFrame:
    """``doc_id, start, stop``: the matches, and the windows to look up that two documents or more have."""

    def given(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        shared = False  # whether a document before the held rows has their window
        for b in batches:
            probe = b.column(0)
            asked = np.asarray(probe.is_valid())
            others = [b.column(k).to_numpy() for k in (1, 2, 3)]
            if not asked.all():
                yield given(*(x[~asked] for x in others))
            rows = (np.asarray(probe.drop_null()), *(x[asked] for x in others))
            if held is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows))
            if not len(rows[0]):
                continue
            window, doc = rows[0], rows[1]
            begin = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])]))
            head = window[begin]
            prior = np.concatenate([[shared and held is not None], head[1:] == head[:-1]])
            good = prior | np.append(head[1:] == head[:-1], False)
            sizes = np.diff(np.append(begin, len(window)))
            good[-1] = False  # not known yet
            keep = np.repeat(good, sizes)
            if keep.any():
                yield given(*(x[keep] for x in rows[1:]))
            held, shared = tuple(x[begin[-1] :].copy() for x in rows), bool(prior[-1])
        if held is not None and shared:
            yield given(*held[1:])

    # matches are dealt out by a hash of their own, and pass through
    dealt = found.withColumn("part", F.coalesce("probe", F.xxhash64("doc_id", "start"))).repartition("part").sortWithinPartitions("probe", "doc_id", "start")
    return dealt.select("probe", "doc_id", "start", "stop").mapInArrow(run, "doc_id long, start int, stop int")


def repeated_passages(docs: DataFrame, least: int = LEAST, base: int = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: passages (end exclusive) that other documents hold too."""
    kept = suffixes(docs, least, base, id_col, text_col)
    found = looked_up(matches(kept.repartition("hash").sortWithinPartitions("key", "doc_id", "word"), least, base))
    ordered = Window.partitionBy("doc_id").orderBy("start", "stop")
    reached = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)
    islands = found.withColumn("reached", reached).withColumn("island", F.sum(new).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    passages = islands.groupBy("doc_id", "island").agg(F.min("start").cast("long").alias("start_word"), F.max("stop").cast("long").alias("end_word"))
    named = id_and_text(docs, id_col, text_col).select(document_key().alias("k"), "doc_id").distinct()
    found = passages.withColumnRenamed("doc_id", "k").join(named, "k")
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents"))
