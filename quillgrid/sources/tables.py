"""Parquet tables of a data folder, and the seed and runtime roots of a deployment.

A runtime table is a folder that every append adds small files to. ``Store.compact`` rewrites them as a version: few files, ranged
by a key, and the names of the files that it stands for. Readers take the latest published version and the files that it doesn't
name, so rows that are appended meanwhile are neither lost nor counted twice, and a reader that has begun goes on with the files
that it listed, until ``drop_superseded`` removes them.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import time
from collections.abc import Callable
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A file in a runtime table's folder: the seed was copied, so it isn't read beside it any more.
COPIED = "_seed_copied"
#: When which runtime table became the seed's again.
RESTORE = T.StructType([T.StructField("name", T.StringType()), T.StructField("ts", T.TimestampNTZType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all in it; False where there was none."""
    system, target = _file(spark, path)
    return system.delete(target, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``); a temporary one only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Store:
    """A read-only seed and a runtime root; reads see both, writes go to the runtime root alone."""

    def __init__(self, spark: SparkSession, seed: str, runtime: str):
        self.spark, self.seed, self.runtime = spark, seed.rstrip("/"), runtime.rstrip("/")

    def _read(self, root: str, name: str, schema: T.StructType) -> DataFrame | None:
        path = f"{root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else None

    def of_seed(self, name: str, schema: T.StructType) -> DataFrame:
        """The seed's rows; none once they were copied to the runtime root."""
        found = None if exists(self.spark, f"{self.runtime}/{name}/{COPIED}") else self._read(self.seed, name, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def has_seed(self, name: str) -> bool:
        return exists(self.spark, f"{self.seed}/{name}")

    def original(self, name: str, schema: T.StructType) -> DataFrame:
        """The seed's rows, whether they were copied or not."""
        found = self._read(self.seed, name, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def of_runtime(self, name: str, schema: T.StructType) -> DataFrame:
        version = self._version(name)
        if version:
            return self._rows(name, schema, version, self._live(name, version))
        found = self._read(self.runtime, name, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def read(self, name: str, schema: T.StructType, key: str | None = None) -> DataFrame:
        """Seed rows and increments; runtime rows stand for the seed rows of their ``key``."""
        seed, own = self.of_seed(name, schema), self.of_runtime(name, schema)
        if key:
            seed = seed.join(own.select(key).distinct(), key, "left_anti").select(*schema.fieldNames())
        return seed.unionByName(own)

    def append(self, rows: DataFrame, name: str, partition_by: str | None = None) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.runtime}/{name}")

    def initialise(self, name: str, schema: T.StructType) -> None:
        """First run: copy a seed table to the runtime root; an existing one is an error and stays as it is."""
        self._copy(name, schema, "errorifexists")

    def restore(self, name: str, schema: T.StructType) -> None:
        """Re-initialisation: the runtime table becomes the seed's again, and the time of that is kept."""
        self._copy(name, schema, "overwrite")
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.append(self.spark.createDataFrame([(name, now)], RESTORE), "restores")

    def restored(self, *names: str) -> dt.datetime | None:
        """When the last of some tables was restored."""
        return self.of_runtime("restores", RESTORE).where(F.col("name").isin(*names)).agg(F.max("ts")).first()[0]

    def claim(self, what: str) -> bool:
        """Make a file that nobody has made before; of several that try at once, one is told that it did."""
        system, target = _file(self.spark, f"{self.runtime}/claims/{what}")
        system.mkdirs(target.getParent())
        try:
            if system.getScheme() == "file":  # whose own create looks first and makes then
                files = self.spark.sparkContext._jvm.java.nio.file
                empty = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.nio.file.attribute.FileAttribute, 0)
                files.Files.createFile(files.Paths.get(target.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)), empty)
            else:
                system.create(target, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- versions of a runtime table ---

    def _children(self, path: str) -> list:
        """Status of what a folder holds; none where there is no folder."""
        system, target = _file(self.spark, path)
        return list(system.listStatus(target)) if system.exists(target) else []

    def _numbers(self, path: str, prefix: str = "") -> list[int]:
        names = [c.getPath().getName().removeprefix(prefix) for c in self._children(path) if c.getPath().getName().startswith(prefix)]
        return [int(n) for n in names if n.isdecimal()]

    def _version(self, name: str) -> int:
        """The number of the latest published version, 0 where there is none."""
        return max(self._numbers(f"{self.runtime}/versions/{name}"), default=0)

    def _path(self, name: str, version: int) -> str:
        return f"{self.runtime}/versions/{name}/{version:09d}"

    def _named(self, name: str, version: int) -> list[str]:
        """The names of the files that a version stands for."""
        if not version:
            return []
        system, target = _file(self.spark, f"{self._path(name, version)}/files")
        stream = system.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _live(self, name: str, version: int) -> dict[str, int]:
        """Name and bytes of a table's files that the version doesn't stand for."""
        found = [c for c in self._children(f"{self.runtime}/{name}") if c.getPath().getName()[0] not in "_."]
        if any(c.isDirectory() for c in found):
            raise ValueError(f"{name} is partitioned: its partitions are replaced, not compacted")
        own = {c.getPath().getName(): c.getLen() for c in found}
        gone = set(self._named(name, version)) if own else set()
        return {n: size for n, size in own.items() if n not in gone}

    def _rows(self, name: str, schema: T.StructType, version: int, files: dict[str, int]) -> DataFrame:
        paths = [f"{self.runtime}/{name}/{n}" for n in sorted(files)]
        if version:
            paths.append(f"{self._path(name, version)}/rows")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def n_files(self, name: str) -> int:
        """How many files a read of the runtime table opens."""
        version = self._version(name)
        own = self._children(f"{self._path(name, version)}/rows") if version else []
        return len(self._live(name, version)) + sum(c.getPath().getName()[0] not in "_." for c in own)

    def compact(self, name: str, schema: T.StructType, key: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, file_bytes: int = 128 << 20, file_rows: int = 2_000_000) -> int:
        """Publish a version of a runtime table in files of about ``file_bytes``, or of ``file_rows`` where that is less, with what ``keep`` leaves of its rows; returns its number.

        Rows are ranged by ``key`` and, within a value, by a hash of the row, so that a value that holds most rows
        fills several files; a filter by the key skips files and row groups. A version that another writer published
        meanwhile is a RuntimeError, and nothing changes. A table without rows gives a version without rows.
        """
        claims = lambda: max(self._numbers(f"{self.runtime}/claims", f"version-{name}-"), default=0)
        version, claimed = self._version(name), claims()
        files = self._live(name, version)
        old = self._children(f"{self._path(name, version)}/rows") if version else []
        stored = self._rows(name, schema, version, files)
        # files pack rows many times smaller than a sort holds them, so a task's rows are bounded too; counting them reads footers only
        n = max(1, -(-(sum(files.values()) + sum(c.getLen() for c in old)) // file_bytes), -(-stored.count() // file_rows))
        rows = keep(stored).select(*schema.fieldNames())
        spread = F.xxhash64(*[F.col(c) for c in schema.fieldNames()])
        return self._publish(name, rows.repartitionByRange(n, F.col(key), spread).sortWithinPartitions(key), version, claimed, [*self._named(name, version), *files])

    def _publish(self, name: str, rows: DataFrame, version: int, claimed: int, files: list[str]) -> int:
        number, built = max(version, claimed) + 1, f"{self.runtime}/versions/{name}/building-{uuid.uuid4().hex}"
        rows.write.parquet(f"{built}/rows")
        system, target = _file(self.spark, f"{built}/files")
        stream = system.create(target)
        stream.write(bytearray("\n".join(files), "utf-8"))
        stream.close()
        # a driver that ends between the claim and the renaming leaves the number unused; the next compaction takes the one after it
        if self._version(name) != version or not self.claim(f"version-{name}-{number:09d}"):
            system.delete(target.getParent(), True)
            raise RuntimeError(f"{name} was compacted by another writer meanwhile")
        system.rename(target.getParent(), _file(self.spark, self._path(name, number))[1])
        return number

    def drop_superseded(self, name: str, older_than: float) -> int:
        """Remove the files that the latest version stands for, and earlier versions, once it is ``older_than`` seconds old; returns how many went.

        Readers and compactions that began before the version must have ended by then.
        """
        version = self._version(name)
        if not version:
            return 0
        system, listed = _file(self.spark, f"{self._path(name, version)}/files")
        if time.time() - system.getFileStatus(listed).getModificationTime() / 1000 < older_than:
            return 0
        gone = sum(system.delete(_file(self.spark, f"{self.runtime}/{name}/{n}")[1], False) for n in self._named(name, version))
        for number in self._numbers(f"{self.runtime}/versions/{name}"):
            if number < version:
                gone += system.delete(_file(self.spark, self._path(name, number))[1], True)
        return gone

    def _copy(self, name: str, schema: T.StructType, mode: str) -> None:
        version = self._version(name)
        if version and mode == "overwrite":
            self._publish(name, self.spark.createDataFrame([], schema), version, version, [])
        self.spark.read.schema(schema).parquet(f"{self.seed}/{name}").write.mode(mode).parquet(f"{self.runtime}/{name}")
        system, target = _file(self.spark, f"{self.runtime}/{name}/{COPIED}")
        system.create(target).close()

    def replace_partitions(self, rows: DataFrame, name: str, partition_by: str) -> None:
        """Overwrite only the partitions that ``rows`` has: a repeated batch changes nothing."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(f"{self.runtime}/{name}")
