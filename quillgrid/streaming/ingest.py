"""Incremental ingest: new files are appended once, however late a copy comes.

A file source with ``availableNow`` and ``foreachBatch``; known hashes are looked up in a table beside the target, not in state
that a watermark would drop. That table is partitioned by the first digits of a hash, so a batch reads only the partitions of its own hashes. A batch that is run again after a failure finds its own rows by ``run_id`` (one for each
checkpoint) and ``batch_id`` and replaces them; a new checkpoint replaces nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid import schemas as S
from quillgrid.operators.files import not_stored
from quillgrid.sources.tables import exists

#: What tells a batch of a stream apart in its target.
RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())])


#: Hexadecimal digits of a hash that name its partition.
PREFIX = 2


def run_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps for its query, also when it is started again."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def replace_batch(rows: DataFrame, run_id: str, batch_id: int, target: str) -> None:
    """Write a batch's rows in place of those it may have written before."""
    named = rows.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN.names).parquet(target)


def hashes_of(target: str) -> str:
    return f"{target.rstrip('/')}_hashes"


def add_hashes(rows: DataFrame, target: str, hash_col: str = "file_sha256") -> None:
    """Add the hashes of stored rows to the table beside ``target``."""
    own = rows.select(hash_col, *RUN.names, F.substring(hash_col, 1, PREFIX).alias("prefix"))
    own.repartition("prefix").sortWithinPartitions("prefix", hash_col).write.mode("append").partitionBy("prefix").parquet(hashes_of(target))


def known_hashes(spark: SparkSession, wanted: DataFrame, target: str, hash_col: str = "file_sha256") -> DataFrame:
    """``hash_col, run_id, batch_id`` of the partitions that the hashes in ``wanted`` fall in."""
    schema = T.StructType([T.StructField(hash_col, T.StringType()), *RUN.fields, T.StructField("prefix", T.StringType())])
    if not exists(spark, hashes_of(target)):
        return spark.createDataFrame([], schema).drop("prefix")
    # at most 16 ** PREFIX values
    prefixes = [r[0] for r in wanted.where(F.col(hash_col).isNotNull()).select(F.substring(hash_col, 1, PREFIX)).distinct().collect()]
    return spark.read.schema(schema).parquet(hashes_of(target)).where(F.col("prefix").isin(prefixes)).drop("prefix")


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, text_col: str = "text", id_col: str = "doc_id", max_files: int | None = None) -> None:
    """Append rows of new files below ``source`` whose content hash ``target`` lacks; returns when all is done."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source).withColumn("file_sha256", F.sha2(F.col(text_col), 256))
    stored_schema = T.StructType([*schema.fields, T.StructField("file_sha256", T.StringType()), *RUN.fields])

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if not exists(session, hashes_of(target)) and exists(session, target):  # a target that was written without them
            add_hashes(session.read.schema(stored_schema).parquet(target), target)
        run_id = run_id_of(session, checkpoint)
        known = known_hashes(session, batch.select("file_sha256"), target).where((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id))
        replace_batch(not_stored(batch, known, "file_sha256", id_col), run_id, batch_id, target)
        if exists(session, target):
            # a batch that is run again adds its hashes again, which changes nothing
            add_hashes(session.read.schema(stored_schema).parquet(target).where((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)), target)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


STATES = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("last", T.StructType([S.JOB_EVENT[c] for c in ("ts", "event_id", "state")])), T.StructField("events", T.ArrayType(T.LongType())), *RUN.fields])


def job_states(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, target: str) -> None:
    """Append to ``target``, for each new batch of event files below ``source``, the last event of each of its jobs; see ``read_job_states``."""
    stream = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("last"), F.collect_set("event_id").alias("events"))
        replace_batch(own, run_id_of(batch.sparkSession, checkpoint), batch_id, target)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_job_states(spark: SparkSession, target: str) -> DataFrame:
    """``job_id, state, ts, n_events``: the current state of each job, from what the batches left.

    Events are told by their ids, so one that several batches or checkpoints saw counts once, and parts that each saw add up.
    """
    stored = spark.read.schema(STATES).parquet(target)
    merged = stored.groupBy("job_id").agg(F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("events")))).cast("long").alias("n_events"))
    return merged.select("job_id", "last.state", "last.ts", "n_events")
