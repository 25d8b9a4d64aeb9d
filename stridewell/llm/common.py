"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none and runs on this machine alone (tests, a laptop), a new local folder is set as
    checkpoint folder; on a cluster that would be a folder of each executor's own, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            found = os.path.dirname(found.rstrip("/"))
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage is cut and a
    lost executor costs no more than a new read."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, narrow rows of a written table, marked for broadcast if they are ``most`` at most; larger, it is
    joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, which is no column of ``df`` in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def workers_import_this(spark: SparkSession) -> None:
    """Python workers find this package also when the driver put it on ``sys.path`` itself."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Most rows of an Arrow batch that holds whole texts.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session; a smaller number set before stays. A batch of whole texts is held
    on both sides of a Python worker, and Spark's 10,000 rows are tens of MB on each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (long), the columns ``keep`` and text, null text as the empty one; other columns go."""
    workers_import_this(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def release_memory() -> None:
    """Gives memory that a Python worker has freed back to the system: later stages use the worker again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None]) -> Callable:
    """``run`` for mapInArrow that leaves nothing behind in its Python worker: words that a task has remembered are
    forgotten with it, as the next stage on that worker has no use for them."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            release_memory()

    return tidied


def fold(column: str, n: int) -> F.Column:
    """crc32 of a key written as text, modulo n; a null key falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def fields(*pairs: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in pairs])
