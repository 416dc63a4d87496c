"""Filter interaction audit: what each of five filters removes in every order of the five.

One pass scans the Arrow buffers of whole texts: byte classes as NumPy masks, prefix sums over them give the
capitals of each document, and a prefix sum of weighted bytes gives each word a 64-bit hash. A document's word
hashes are sorted and neighbours of equal hash are compared byte by byte, so its count of distinct words is exact (a
document with two different words of one hash is counted anew by its words). A document becomes a mask of the filters that it
fails; masks are counted by part, and the 120 orders are read off those counts, 32 a part at most.

Repeated texts are found without joining rows: rows of a text are counted by part and labels before the shuffle, with the smallest
id and its rows, so a text that a third of all rows hold is a few rows by then.

Defined results: a null text is empty; a null part is the empty string; a row without doc_id has no
smaller one (it never fails E) and is no smaller one; rows of equal doc_id and text don't make each other fail E; labels that repeat an id
count as 1 where any of them does; bytes that aren't UTF-8 are scanned as they are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, table

#: The filters by letter; a document's mask has the bit of each that it fails.
FILTERS = "ABCDE"
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """A: fewer words than ``words``; B: under ``distinct`` per cent of them distinct; C: over ``capitals`` per cent of the code points are A-Z; D: holds one of ``symbols``."""

    words: int = 200
    distinct: int = 50
    capitals: int = 3
    symbols: bytes = b"#$%&*|"


def _class(of: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


SPACE = _class([0x20, *range(0x09, 0x0E)])
CAPITAL = _class(range(0x41, 0x5B))
#: Bytes that begin a code point.
LEADING = _class(x for x in range(256) if x & 0xC0 != 0x80)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


_INVERSE = pow(_ODD, -1, 1 << 64)
_UP, _DOWN = _powers(_ODD, BLOCK), _powers(_INVERSE, BLOCK)


def sums_at(values: Iterable[np.ndarray], edges: np.ndarray) -> np.ndarray:
    """Prefix sums, modulo 2**64, of blocks of values at ascending edges: the sum of all that stands before each."""
    out, total, at = np.zeros(len(edges), _U), np.zeros(1, _U), 0
    low = int(np.searchsorted(edges, 1))
    for block in values:
        sums = np.cumsum(block, dtype=_U)
        high = int(np.searchsorted(edges, at + len(block), "right"))
        out[low:high] = sums[edges[low:high] - at - 1] + total
        low, at = high, at + len(block)
        total = total + sums[-1:]
    return out


def _blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k, a in enumerate(range(0, len(data), BLOCK)):
        yield k, data[a : a + BLOCK]


def counts(kind: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many bytes of a class stand between neighbouring edges."""
    return np.diff(sums_at((kind[b] for _, b in _blocks(data)), edges).astype(np.int64))


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte after the last one, of every word; an edge ends a word."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:-1] &= ~inside[:-2]
    ends[1:] = inside[:-1] & ~inside[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = inside[inner]
    ends[inner] = inside[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the words' shares of one prefix sum, shifted to a common place."""
    n = len(data) // BLOCK + 1
    up, down = _powers(pow(_ODD, BLOCK, 1 << 64), n), _powers(pow(_INVERSE, BLOCK, 1 << 64), n)
    weighted = lambda: ((b.astype(_U) + _U(1)) * _UP[: len(b)] * up[k] for k, b in _blocks(data))
    h = (sums_at(weighted(), ends) - sums_at(weighted(), starts)) * down[starts // BLOCK] * _DOWN[starts % BLOCK]
    h = (h ^ (h >> _U(32))) * _U(_ODD)
    return h ^ (h >> _U(29))


def unequal(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of words differ, by their bytes."""
    out = lengths[one] != lengths[other]
    same = np.flatnonzero(~out)
    total = np.cumsum(lengths[one[same]])
    for a in range(0, int(total[-1]) if len(total) else 0, BLOCK):
        pairs = same[np.searchsorted(total, a, "right") : np.searchsorted(total, a + BLOCK, "right")]
        if not len(pairs):
            continue
        size = lengths[one[pairs]]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        wrong = data[inside + np.repeat(starts[one[pairs]], size)] != data[inside + np.repeat(starts[other[pairs]], size)]
        out[pairs[np.repeat(np.arange(len(pairs)), size)[wrong]]] = True
    return out


def distinct(data: np.ndarray, edges: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each document: its word hashes sorted, neighbours of equal hash verified."""
    h = hashes(data, starts, ends) if h is None else h
    doc = np.searchsorted(edges, starts, "right") - 1
    order = np.lexsort((h, doc)) if len(edges) > 1 << 16 else np.argsort((doc.astype(_U) << _U(48)) | (h >> _U(16)))
    sorted_doc, sorted_h = doc[order], h[order] >> _U(16)
    same = (sorted_doc[1:] == sorted_doc[:-1]) & (sorted_h[1:] == sorted_h[:-1])
    out = np.bincount(doc, minlength=len(edges) - 1) - np.bincount(sorted_doc[1:][same], minlength=len(edges) - 1)
    again = np.flatnonzero(same)
    wrong = unequal(data, starts, ends - starts, order[again], order[again + 1])
    for d in np.unique(sorted_doc[again[wrong]]):
        out[d] = len(set(data[edges[d] : edges[d + 1]].tobytes().split()))
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the edges of its rows in them, without copying the texts."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def masks(data: np.ndarray, edges: np.ndarray, limits: Limits) -> np.ndarray:
    """Bits of A to D of each document."""
    starts, ends = words(data, edges)
    n = np.diff(np.searchsorted(starts, edges))
    few = n < limits.words
    same = 100 * distinct(data, edges, starts, ends) < limits.distinct * n
    loud = 100 * counts(CAPITAL, data, edges) > limits.capitals * counts(LEADING, data, edges)
    odd = counts(_class(limits.symbols), data, edges) > 0
    return few + 2 * same + 4 * loud + 8 * odd


def marked(docs: DataFrame, limits: Limits, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest`` of every row: the filters A to D that it fails, and its text's SHA-256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches):
            data, edges = text_buffers(b.column(1))
            whole = data.data
            digests = [hashlib.sha256(whole[i:j]).digest() for i, j in zip(edges.tolist(), edges[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(masks(data, edges, limits).astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), part.alias("part"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def failures(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents by the filters, E among them, that they fail."""
    one = lambda c: F.max(F.coalesce(F.col(f"`{c}`").cast("int") == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good = 1 or toxic = 1").withColumn("salt", F.lit(0))
    # rows without an id meet no label: dealt by their text, not as one key
    salt = F.when(F.col("doc_id").isNull(), F.hash("digest", "part")).otherwise(0).alias("salt")
    met = rows.select("doc_id", "part", "mask", "digest", salt).join(known, ["doc_id", "salt"], "left")
    labelled = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    same = ["digest", "part", "mask", "good", "toxic"]
    # a document's equal rows, then a text's documents: each a partial sum before its shuffle
    by_id = labelled.groupBy("doc_id", "salt", *same).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min(F.col("first.doc_id")).over(Window.partitionBy("digest"))
    unrepeated = F.col("without_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("alone", unrepeated)
    bit = 1 << FILTERS.index("E")
    each = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("alone").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))).alias("x"))
    return each.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("n_good"), F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic"))


def steps() -> pa.Table:
    """What each mask does at each step of each order: 32 * 120 * 5 rows, whatever the data."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                rows.append((mask, "".join(order), step, letter, not gone and not fails, fails and not gone, fails and gone, mask == bit))
            before |= bit
    names = ["mask", "filter_order", "step", "letter", "stays", "goes", "again", "alone"]
    return pa.table({n: pa.array(list(v), pa.int32() if n in ("mask", "step") else None) for n, v in zip(names, zip(*rows))})


def interactions(found: DataFrame) -> DataFrame:
    """One row per part, order and step from the documents by part and mask."""
    met = found.join(F.broadcast(found.sparkSession.createDataFrame(steps())), "mask")
    count = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    each = met.groupBy("part", "filter_order", "step", "letter").agg(
        count("stays").alias("kept"), count("goes").alias("removed"), count("again").alias("redundant"), count("alone").alias("unique_fails"), count("goes", "n_good").alias("good_lost"), count("goes", "n_toxic").alias("toxic_lost")
    )
    return each.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return interactions(failures(marked(docs, limits, id_col, text_col, part_col), labels, id_col))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle_sql() -> str:
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, doc_id,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM worded),
counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic
  FROM masked LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters(l, b) AS (VALUES {letters}),
orders AS (
  SELECT [v.l, w.l, x.l, y.l, z.l] AS ls, [v.b, w.b, x.b, y.b, z.b] AS bs
  FROM letters v JOIN letters w ON w.l <> v.l JOIN letters x ON x.l NOT IN (v.l, w.l) JOIN letters y ON y.l NOT IN (v.l, w.l, x.l) JOIN letters z ON z.l NOT IN (v.l, w.l, x.l, y.l)),
stepped AS (
  SELECT array_to_string(ls, '') AS filter_order, step, ls[step] AS letter, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
each AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (before + bit)::BIGINT = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM counted, stepped GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM each"""
