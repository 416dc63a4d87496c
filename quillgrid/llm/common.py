"""Helpers shared by the training-data operators: table access, the shared folder, Arrow loops.

Nothing here holds rows: every helper either builds a plan or works on one Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgrid-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders of tables made in this session, for those who know when they are no longer read.
made: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quillgrid/{what}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as Parquet in the shared folder; the table as read back, and its path."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    """``written_at`` without the path: results may read the table later, so it stays until the folder is cleaned."""
    return written_at(df, what)[0]


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, by Hadoop's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_KEPT: dict[tuple, Any] = {}
_LOCK = threading.RLock()
_uses = 0
#: After so long without a new task a worker gives back what it has kept.
IDLE_SECONDS = 2.0


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps for later tasks of the same operator, made once; other operators' things go.

    Workers are used again by later stages: without this, the stores of all stages would add up.
    """
    global _uses
    with _LOCK:
        _uses += 1
        if key not in _KEPT:
            forget()
            _KEPT[key] = make()
        return _KEPT[key]


def forget() -> None:
    """Drop what earlier operators have kept in this worker process, and give free memory back to the system."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def forget_when_idle() -> None:
    """Called at a task's end: ``forget`` unless another task takes what is kept within ``IDLE_SECONDS``.

    A stage of two Python steps leaves twice as many workers as tasks run at once; later stages take them in turn, and
    each would keep its own store while it waits.
    """
    if not _KEPT:
        return
    seen = _uses

    def drop() -> None:
        with _LOCK:
            if _uses == seen:
                forget()

    timer = threading.Timer(IDLE_SECONDS, drop)
    timer.daemon = True
    timer.start()


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), whatever other columns are there."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def pieces(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece has more than ``most_bytes`` of ``column``, single rows apart."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def arrow_batches(batches: Iterable[pa.RecordBatch], column: int = 1, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces; once they have ended, what the worker keeps may go."""
    for batch in batches:
        yield from pieces(batch, column, most_bytes)
    forget_when_idle()
