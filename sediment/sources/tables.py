"""Tables of the session catalog: creating, appending, and merging into them."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.types import cols, quoted

BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 8
READ_BYTES = 16 << 20
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _parts(name: str) -> list[str]:
    return [p.strip("`") for p in name.split(".")]


def _sql_name(name: str) -> str:
    return ".".join(quoted(p) for p in _parts(name))


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(_sql_name(name))


def ensure_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    *,
    bucket_by: list[str] | None = None,
    buckets: int = LEAST_BUCKETS,
    partition_by: list[str] | None = None,
    codec: str | None = None,
) -> DataFrame:
    """The table, created empty if it is missing.

    A table bucketed by the key it is merged on is joined without shuffling it.  `codec` is the compression of all that is ever
    written to it, by default that of the session that writes.
    """
    if not exists(spark, name):
        writer = spark.createDataFrame([], schema).write.format("parquet")
        if codec:
            writer = writer.option("compression", codec)
        if bucket_by:
            writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(_sql_name(name))
    return spark.table(_sql_name(name))


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_sql_name(name)}").collect()}


def bucket_count(spark: SparkSession, name: str) -> int | None:
    """The buckets of a table; None if it is missing or has none."""
    found = _described(spark, name).get("Num Buckets") if exists(spark, name) else None
    return int(found) if found else None


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket that Spark puts a row into in a table bucketed by these columns."""
    return F.pmod(F.hash(*cols(keys)), F.lit(buckets))


def buckets_for(spark: SparkSession, name: str) -> int:
    """Buckets of some hundred megabytes each for a table made of what `name` holds, by the size of its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_described(spark, name)["Location"])
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    return max(LEAST_BUCKETS, -(-files.getLength() // BUCKET_BYTES))


def job_session(spark: SparkSession, buckets: int) -> SparkSession:
    """A session for one job, with the caller's settings but for five that no other job shall see.

    Files are read in small pieces, as rows may become several times as many before they are sorted or counted.
    An overwrite replaces the partitions it has rows for.  It shuffles into as many partitions as the target has buckets, and lets the target's bucketing serve joins on
    more columns than it is bucketed by.  Then a join with the bucketed table shuffles neither it nor the
    rows a second time, and every task writes the file of one bucket.  What a step has shuffled leaves the disks when the step ends, not when the
    driver happens to collect its garbage; a job stages what it reads twice.
    """
    job = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) and value is not None:
            job.conf.set(name, value)
    job.conf.set("spark.sql.shuffle.partitions", str(buckets))
    job.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    job.conf.set(_OVERWRITE, "dynamic")
    job.conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))
    job.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return job


def refresh(spark: SparkSession, *names: str) -> None:
    """Let a session see what another has written to tables."""
    for name in names:
        if exists(spark, name):
            spark.catalog.refreshTable(_sql_name(name))


# Kept with a table of the jobs: how often it was written to, and how many rows it had then.
_VERSION, _ROWS = "sediment.version", "sediment.rows"


def _property(spark: SparkSession, name: str, key: str) -> int | None:
    if not exists(spark, name):
        return None
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_sql_name(name)}").collect()}
    return int(held[key]) if key in held else None


def _set(spark: SparkSession, name: str, key: str, value: int) -> None:
    spark.sql(f"ALTER TABLE {_sql_name(name)} SET TBLPROPERTIES ('{key}' = '{value}')")


def _written(spark: SparkSession, name: str) -> None:
    _set(spark, name, _VERSION, (_property(spark, name, _VERSION) or 0) + 1)


def append(df: DataFrame, name: str) -> None:
    """Append rows to a table, by column name; a column the table has and `df` lacks is an error.  The table gets a new version."""
    spark = df.sparkSession
    df.select(*cols(spark.table(_sql_name(name)).columns)).write.insertInto(_sql_name(name))
    _written(spark, name)


def replace_partitions(df: DataFrame, name: str) -> None:
    """Let the rows of `df` be all of the partitions they belong to; the others stay as they are.  The table gets a new version.

    The rows may come from these partitions: what is written takes the place of a partition when all is written.
    To be called in a `job_session`.
    """
    spark = df.sparkSession
    if spark.conf.get(_OVERWRITE) != "dynamic":
        raise RuntimeError(f"{_OVERWRITE} must be dynamic, or all partitions would go")
    df.select(*cols(spark.table(_sql_name(name)).columns)).write.insertInto(_sql_name(name), overwrite=True)
    _written(spark, name)


def row_count(spark: SparkSession, name: str) -> int:
    """The rows of a table; of Parquet files the footers say it."""
    return spark.table(_sql_name(name)).count()


def record_rows(spark: SparkSession, name: str, rows: int) -> None:
    """Remember how many rows a table has after a run."""
    _set(spark, name, _ROWS, rows)


def recorded_rows(spark: SparkSession, name: str) -> int | None:
    """How many rows the last run left; None if no run said so."""
    return _property(spark, name, _ROWS)


def table_version(spark: SparkSession, name: str) -> int | None:
    """The latest version of a table: of its history if its format keeps one, else the number of writes by `append` and
    `replace_partitions`; None if there is neither."""
    try:
        return spark.sql(f"DESCRIBE HISTORY {_sql_name(name)} LIMIT 1").first()["version"]
    except (AnalysisException, ParseException):  # plain tables have no history
        return _property(spark, name, _VERSION)
