"""Where rows are between two steps of a job.

A staged result is parquet in the cluster's shared checkpoint folder.  It cuts the lineage, survives the
loss of any executor, is read back by column and lets Spark choose the next join from its real size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sediment.types import quoted

_SETTING = "spark.checkpoint.dir"

#: What Spark sends to Python at a time, in bytes, where a step asks for it.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22

_kept: ContextVar[list[str] | None] = ContextVar("staged_folders", default=None)


def staging_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder the session names."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="sediment-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/sediment/{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end, for jobs that keep none of it."""
    outer, folders = _kept.get(), []
    _kept.set(folders)
    try:
        yield
    finally:
        _kept.set(outer)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _new_folder(spark: SparkSession) -> str:
    folder = staging_folder(spark)
    if _kept.get() is not None:
        _kept.get().append(folder)
    return folder


@contextmanager
def staged_table(df: DataFrame, name: str, buckets: int, keys: list[str], codec: str) -> Iterator[DataFrame]:
    """`df` staged as a bucketed table that is dropped at the end, so that what reads it by the keys shuffles nothing.

    Rows are sorted by the keys, so that equal ones lie side by side and take next to nothing.  `name` begins the table's name, which is one of its own.
    """
    spark = df.sparkSession
    own = ".".join(quoted(part.strip("`")) for part in f"{name.rstrip('`')}_{uuid.uuid4().hex}".split("."))
    try:
        writer = df.write.format("parquet").option("path", _new_folder(spark)).option("compression", codec)
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(own)
        yield spark.table(own)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {own}")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, rows go to Python by _BATCH_BYTES, however many; the session's setting is back at the end."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(_BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def stage(df: DataFrame, codec: str | None = None, small_batches: bool = False) -> DataFrame:
    """Write `df` once and return it as a scan of what was written; `codec` is the compression, by default the session's.

    With `small_batches` a Python step holds some megabytes of its rows at a time, not 10,000 texts in each of Spark's and
    Python's buffers; for steps whose results do not depend on how rows are dealt to batches.
    """
    spark = df.sparkSession
    folder = _new_folder(spark)
    with _small_batches(spark) if small_batches else nullcontext():
        df.write.parquet(folder, compression=codec)
    return spark.read.schema(df.schema).parquet(folder)
