"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has an order of preference over the slots of a table of prime size: slots offset, offset +
skip, offset + 2 skip and so on, where offset and skip come from a hash of the shard's name. Shards take turns
and claim the first slot of their order that is still free, until the table is full; so shards
hold equally many slots up to one, and when shards come or go few slots change hands. The size of the
table is a parameter (about a hundred slots a shard or more), never of the data, so it is broadcast;
placing a row is a hash, a remainder and a look-up.

Defined results: a null key is placed as the empty string; equal keys share a shard; empty and very
long keys are hashed like any other; repeated rows are kept; an empty table gives no rows; all other
columns are kept, and ``slot`` and ``shard`` replace columns of these names.

A key that a third of the rows share would fill one shard: with ``spread_col`` (a column that tells
these rows apart) the key's rows are dealt to ``spread`` places by that column's hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import table

SHARDS = 64
#: A prime of about 128 slots a shard.
SLOTS = 8191


def _number(text: str, digits: int = 15) -> int:
    """The first hex digits of the MD5 as a number: SQL engines have it too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. Work and size depend on the parameters alone."""
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime and at least that of shards")
    at = [_number(f"{x}:offset") % slots for x in shards]
    skip = [_number(f"{x}:skip") % (slots - 1) + 1 for x in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        owner[at[i]] = i
    return owner


def slot_of(key: Column, slots: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, spread_col: str | None = None, spread: int = 1) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    spark = rows.sparkSession
    key = F.col(f"`{key_col}`").cast("string")
    if spread_col:
        part = F.pmod(F.xxhash64(F.col(f"`{spread_col}`")), F.lit(spread))
        key = F.concat_ws("#", F.coalesce(key, F.lit("")), part)
    owner = lookup_table(shards, slots)
    # one row that is cut into the table's slots by SQL; its size is the parameter ``slots``
    filled = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "index"))
    names = F.array(*map(F.lit, shards))
    placed = filled.select("slot", F.get(names, F.col("index").cast("int")).alias("shard"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    return rows.withColumn("slot", slot_of(key, slots)).drop("shard").join(F.broadcast(placed), "slot").select(*[f"`{c}`" for c in kept], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write a folder for each shard; rows of a shard are dealt to so many files, none to one task alone."""
    spare = "quillgrid_" + "_".join(sorted(placed.columns))
    dealt = placed.withColumn(spare, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns if c != "shard"]), F.lit(files_per_shard)))
    dealt.repartition(F.col("shard"), F.col(f"`{spare}`")).drop(spare).write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def oracle_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The table by a recursion of one turn a step, and the look-up."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE s AS (
  SELECT i, {number.format("n || ':offset'")} % {slots} AS o, {number.format("n || ':skip'")} % ({slots} - 1) + 1 AS k
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 4, '0') AS n FROM range({shards}) AS r(i))),
w AS (SELECT list(o ORDER BY i) AS o, list(k ORDER BY i) AS k FROM s),
f(turn, place, owner, claimed) AS (
  SELECT 0, o, list_transform(range({slots}), lambda x: -1), -1::BIGINT FROM w
  UNION ALL
  SELECT turn + 1, list_transform(place, lambda x, j: CASE WHEN j = turn % {shards} + 1 THEN slot ELSE x END), list_transform(owner, lambda x, j: CASE WHEN j = slot + 1 THEN turn % {shards} ELSE x END), slot
  FROM (SELECT turn, place, owner, list_filter(list_transform(range({slots}), lambda x: (place[turn % {shards} + 1] + x * k[turn % {shards} + 1]) % {slots}), lambda y: owner[y + 1] < 0)[1] AS slot
        FROM f, w WHERE turn < {slots})),
m AS (SELECT unnest(range({slots})) AS slot, unnest(owner) AS i FROM f WHERE turn = {slots})
SELECT doc_id, slot::INTEGER AS slot, 'shard-' || lpad(i::VARCHAR, 4, '0') AS shard
FROM (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, '')")} % {slots} AS slot FROM documents) JOIN m USING (slot)"""
