"""Search by an inverted index of character grams, extended batch by batch.

Every character of a text begins one gram: the pair with the next character where both are Han, else the triple with the next two (a text is
padded by two marks, so its last characters begin grams too). A posting is a gram of a block of texts (about ``PIECE`` characters) with the documents that
hold it and the ascending positions in each, kept in Parquet's delta encoding, i.e. as packed gaps. Postings lie in buckets by their first two characters, in files sorted
by gram. Each task writes the postings of its own texts, so none is moved, and tasks grow in number with the texts.

A term of any length is covered by few grams, each at its own place in the term; only their buckets are read (a term of one character needs
all of them), and filters on the gram reach the files. A document holds the term at p if each gram has p plus its place among its positions: postings are shifted by their
places and intersected. So the index answers exactly what ``contains`` does, without reading a text.

Defined results: a null text has no postings; of a document that is in a batch twice, or in two batches, positions count once if the text is the same; an empty term is refused;
the padding mark never occurs in a term.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Pads a text's end; a noncharacter.
PAD = "￿"
_POSTING = "gram string, docs array<long>, ends array<int>, at array<int>"
#: ``ends``: for each document where its positions in ``at`` end.
POSTINGS = f"bucket int, {_POSTING}"
# The ranges of Han characters.
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
#: Characters of a block; a longer text goes alone.
PIECE = 1 << 20


def _han(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    for low, high in HAN:
        out |= (codes >= low) & (codes <= high)
    return out


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))


def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """``gram, docs, ends, at`` of some texts."""
    codes = np.frombuffer("".join(t + PAD * 2 for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    han = _han(codes)
    # a gram as a number: 21 bits a character, the third one absent from a pair
    key = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | np.where(han[:-2] & han[1:-1], np.uint64(0), codes[2:])
    # where each text's characters stand, without its padding
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(of)) + 2 * of
    key = key[place]
    order = np.argsort(key, kind="stable")
    key, of, at = key[order], of[order], (order - begins[of[order]]).astype(np.int32)
    new_gram = np.append(True, key[1:] != key[:-1])
    grams = np.flatnonzero(new_gram)
    docs = np.flatnonzero(new_gram | np.append(True, of[1:] != of[:-1]))
    names = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + (chr(k & 0x1FFFFF) if k & 0x1FFFFF else "") for k in key[grams].tolist()]
    edges = np.append(np.searchsorted(docs, grams), len(docs))
    ends = np.append(docs[1:], len(key)) - np.repeat(grams, np.diff(edges))
    return pa.record_batch([pa.array(names, pa.string()), _lists(np.array(ids, np.int64)[of[docs]], edges), _lists(ends.astype(np.int32), edges), _lists(at, np.append(grams, len(key)))], ["gram", "docs", "ends", "at"])


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 2)), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gram, docs, ends, at`` of blocks of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = text.as_py().replace("\x00", PAD)
                if held and held + len(own) > PIECE:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(own)
                held += len(own)
        if held:
            yield block(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text <> ''")
    return rows.mapInArrow(run, _POSTING).select(bucket_of(F.col("gram"), buckets).alias("bucket"), "gram", "docs", "ends", "at")


def index(docs: DataFrame, path: str, batch: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Add a batch's postings to the index at ``path``; a batch that is added again stands for its earlier rows."""
    found = postings(docs, id_col, text_col, buckets).withColumn("batch", F.lit(batch))
    # each task has files of its own: postings are neither shuffled nor dealt by a number of tasks that is fixed
    found.sortWithinPartitions("batch", "bucket", "gram").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.writer.version", "v2").partitionBy("batch", "bucket").parquet(path)


def cover(term: str) -> list[tuple[int, str, bool]]:
    """(place, gram, whether it is a gram's beginning only) that cover a term; the fewest from the left."""
    han = _han(np.array([ord(c) for c in term], np.int64)).tolist()
    whole = []
    for k in range(len(term) - 1):
        size = 2 if han[k] and han[k + 1] else 3
        whole.append((k, term[k : k + size], k + size > len(term)))
    if not whole:
        return [(0, term, True)]
    out, at = [], 0
    while at < len(term):
        # the gram that begins at or before the first character not yet covered, and reaches farthest
        best = max((g for g in whole if g[0] <= at < g[0] + len(g[1])), key=lambda g: (g[0] + len(g[1]), not g[2], g[0]))
        out.append(best)
        at = best[0] + len(best[1])
    return out


def search(spark: SparkSession, path: str, term: str, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_hits, first_at``: the documents that hold ``term``, how often (hits may overlap), and where first (from 1)."""
    if not term or PAD in term:
        raise ValueError("an empty search term, or one with a padding mark")
    wanted = cover(term.replace("\x00", PAD))
    stored = spark.read.schema(POSTINGS + ", batch string").parquet(path)
    if len(term) > 1:
        starts = sorted({g[:2] for _, g, _ in wanted})
        found = spark.range(1).select(*[bucket_of(F.lit(s), buckets).alias(f"b{k}") for k, s in enumerate(starts)]).first()
        stored = stored.where(F.col("bucket").isin(sorted(set(found))))
    fits = F.lit(False)
    places = F.array()
    for place, gram, begins in wanted:
        own = F.col("gram").startswith(gram) if begins else F.col("gram") == gram
        fits = fits | own
        places = F.concat(places, F.when(own, F.array(F.lit(place))).otherwise(F.array().cast("array<int>")))

    def of(k: Column) -> Column:
        begin = F.coalesce(F.get("ends", k - 1), F.lit(0))
        return F.slice("at", begin + 1, F.get("ends", k) - begin)

    each = F.transform("docs", lambda d, k: F.struct(d.alias("doc_id"), of(k).alias("at")))
    lists = stored.where(fits).select(places.alias("places"), F.inline(each))
    rows = lists.select("doc_id", F.explode("places").alias("place"), "at").select("doc_id", F.struct("place", F.transform("at", lambda p: p - F.col("place")).alias("at")).alias("x"))
    # grams of one beginning are alternatives; those of different places must all be there
    each = rows.groupBy("doc_id", F.col("x.place").alias("place")).agg(F.array_distinct(F.flatten(F.collect_list("x.at"))).alias("at"))
    lists = each.groupBy("doc_id").agg(F.collect_list("at").alias("lists")).where(F.size("lists") == len({g[0] for g in wanted}))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select("doc_id", both.alias("at")).where(F.size("at") > 0).select("doc_id", F.size("at").cast("long").alias("n_hits"), (F.array_min("at") + 1).cast("long").alias("first_at"))
