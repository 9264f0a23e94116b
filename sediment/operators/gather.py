"""How many tasks share the rows of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sediment.types import cols


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that rows come from; 0 for rows from elsewhere."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def pieces(df: DataFrame, piece_bytes: int) -> int:
    """Partitions for the rows of an input: one for each `piece_bytes` of its files, but one for each core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-input_bytes(df) // piece_bytes))


def whole_pieces(df: DataFrame, piece_bytes: int, buckets: int) -> int:
    """`pieces`, as a multiple of `buckets`: then no piece has rows of two buckets of a table bucketed by the keys they are dealt by."""
    return -(-pieces(df, piece_bytes) // buckets) * buckets


def gathered(df: DataFrame, keys: list[str], piece_bytes: int, buckets: int = 1) -> DataFrame:
    """The rows with equal keys in one of `whole_pieces` partitions.

    Their number follows the input, not the settings, and is not lowered where rows compress well, so that what a task
    sorts or counts fits its memory.
    """
    return df.repartition(whole_pieces(df, piece_bytes, buckets), *cols(keys))


def fits_every_task(df: DataFrame) -> bool:
    """Whether Spark sends the rows of these files to all tasks that join with them, by the session's limit."""
    return input_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
