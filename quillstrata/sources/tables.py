"""Input tables and lineage cuts.

Every path is opened by Spark's own readers and writers, so inputs and the
scratch folder may live in any store that the cluster can reach.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Bytes of a batch that goes to a Python worker; Spark's default is 64 MB.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return the parquet table ``name`` below ``sf_dir`` (one file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table over the tasks.

    For a table from whose rows much more is made: one small file is read by one task,
    which would make all of it.
    """
    return df.repartition(key)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ``BATCH_BYTES`` bytes, unless the session has its own setting.

    For the owner of a session to call (the driver entry and the pipeline do); no
    operator changes the session that it runs in.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def scratch_dir(spark: SparkSession) -> str:
    """Return the shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting (a test) gets a temporary folder of its own; on a cluster
    that folder would be another one on each machine, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstrata-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint a small table reliably; lost executors do not lose it."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Named tables in the shared folder, each deleted after its last reader.

    A table is whole in the shared folder before the ones it was made from are
    dropped, so a lost executor never needs a dropped one.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
        self._serial = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Write a table once and return its reader, which fetches only the columns it needs."""
        self._serial += 1
        path = f"{self._root}/{self._serial}"
        df.write.option("compression", "zstd").parquet(path)
        if self._serial == 1:
            _end_with_application(self._spark, self._root)
        table = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned and nothing will read again."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            self._delete(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        """Delete all tables: what was made of them has been written elsewhere."""
        self._paths.clear()
        self._delete(self._root)

    def _delete(self, path: str) -> None:
        files, target = _files(self._spark, path)
        files.delete(target, True)


def _files(spark: SparkSession, path: str) -> tuple:
    """Return the file system of a path, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _end_with_application(spark: SparkSession, path: str) -> None:
    """Let a folder that exists be deleted when the application ends, if nothing deletes it before."""
    files, target = _files(spark, path)
    files.deleteOnExit(target)


def work_folder(spark: SparkSession) -> str:
    """Return a new folder in the shared folder, which is deleted when the application ends."""
    path = f"{scratch_dir(spark)}/work/{uuid.uuid4().hex}"
    files, target = _files(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


#: What ``shared`` has built, by application, inputs and name.
_SHARED: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, names: tuple[str, ...], what: str, build: Callable[[], T]) -> T:
    """Return what ``build`` makes of some tables, built once an application for as long as their files stay the same.

    What it writes is deleted when the application ends.
    """
    stamp = []
    for name in names:
        files, target = _files(spark, f"{sf_dir}/{name}.parquet")
        listed = files.listFiles(target, True)
        while listed.hasNext():
            one = listed.next()
            stamp.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    key = (spark.sparkContext.applicationId, what, *sorted(stamp))
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def durable_table(df: DataFrame, level: int = 3) -> DataFrame:
    """Write a wide table once to the shared folder and return its reader.

    Unlike a checkpoint, later reads of the columnar copy fetch only the columns
    they need. ``level`` is that of the compression. The table is deleted when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    _end_with_application(spark, path)
    return spark.read.schema(df.schema).parquet(path)
