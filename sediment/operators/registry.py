"""Schema versions, drift, lineage and usage, kept as ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.identity import canonical_text
from sediment.operators.ordered import number_runs
from sediment.types import col, cols

INVENTORY = ("ordinal", "name", "sql_type", "path")

_STRING = T.StringType()


def schema_fingerprint(inventory: DataFrame, identity: list[str]) -> DataFrame:
    """One hash per column list: names, types (case and blanks aside), paths and order count.

    Every column is hashed with its position and the hashes are added up, an order-free sum of a
    sequence-numbered set.  It needs a fixed-size buffer per list, however long the list is.
    """
    type_name = F.upper(F.regexp_replace("sql_type", r"\s+", ""))
    one = F.sha2(
        F.concat_ws(
            "|",
            F.col("ordinal").cast("string"),
            canonical_text(F.col("name"), _STRING),
            canonical_text(type_name, _STRING),
            canonical_text(F.col("path"), _STRING),
        ),
        256,
    )
    part = [
        F.sum(F.conv(F.substring("_one", 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(4)
    ]
    return (
        inventory.select(*cols(identity), one.alias("_one"))
        .groupBy(*cols(identity))
        .agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *part), 256).alias("schema_hash"),
        )
    )


def columns_json(inventory: DataFrame, identity: list[str]) -> DataFrame:
    """The column list of each table as a JSON array of {name, sql_type} in order.

    Repeated entries count once.  A list is one value by nature, as large as the table is wide.
    """
    inventory = inventory.select(*cols(identity), "ordinal", "name", "sql_type").distinct()
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "name", "sql_type")))
    return inventory.groupBy(*cols(identity)).agg(
        F.to_json(
            F.transform(listed, lambda c: F.struct(c["name"].alias("name"), c["sql_type"].alias("sql_type")))
        ).alias("columns")
    )


def number_versions(observations: DataFrame, identity: list[str], current: DataFrame | None = None) -> DataFrame:
    """Every observation with its `version` and `_status`: created, unchanged or drifted.

    An observation (`schema_hash`, `observed_at`, `observation_id`) is compared with the one before it;
    the first of a source with the active version in `current`.  Going back to an earlier shape opens a
    new version.
    """
    seen = observations.select(
        *cols(identity),
        F.lit(1).alias("_turn"),
        "observed_at",
        "observation_id",
        "schema_hash",
        F.lit(None).cast("long").alias("_known"),
        col("observed_at").alias("_start"),
        col("observed_at").alias("_verified"),
    )
    if current is not None:
        active = current.where("record_is_active").select(
            *cols(identity),
            F.lit(0).alias("_turn"),
            F.col("record_start_ts").alias("observed_at"),
            F.lit(None).cast(observations.schema["observation_id"].dataType).alias("observation_id"),
            "schema_hash",
            F.col("version").cast("long").alias("_known"),
            F.col("record_start_ts").alias("_start"),
            F.col("last_verified_at").alias("_verified"),
        )
        seen = active.unionByName(seen)
    numbered = number_runs(
        seen, identity, ["_turn", "observed_at", "observation_id"], "schema_hash", carry="_known"
    )
    version = F.col("_run") + F.coalesce(F.col("_carried") - 1, F.lit(0))
    status = (
        F.when(~F.col("_first_of_run"), "unchanged")
        .when(version == 1, "created")
        .otherwise("drifted")
    )
    return numbered.withColumns({"version": version, "_status": status}).drop("_run", "_first_of_run", "_carried")


def register_versions(observations: DataFrame, identity: list[str], current: DataFrame | None = None) -> DataFrame:
    """The version table after the observations: one row per source and version, one active per source.

    A version starts with its first observation, ends when the next one starts, and was last verified
    by its last observation.
    """
    versions = (
        number_versions(observations, identity, current)
        .groupBy(*cols(identity), "version")
        .agg(
            F.min("schema_hash").alias("schema_hash"),
            F.min("_start").alias("record_start_ts"),
            F.max("_verified").alias("last_verified_at"),
        )
    )
    following = versions.select(
        *[col(i).alias(f"_next_{i}") for i in identity],
        (F.col("version") - 1).alias("_next_version"),
        F.col("record_start_ts").alias("record_end_ts"),
    )
    on = F.col("version") == F.col("_next_version")
    for i in identity:
        on = on & col(i).eqNullSafe(col(f"_next_{i}"))
    result = versions.join(following, on, "left").select(
        *cols(identity),
        "schema_hash",
        "version",
        "record_start_ts",
        "record_end_ts",
        F.col("record_end_ts").isNull().alias("record_is_active"),
        "last_verified_at",
    )
    if current is None:
        return result
    closed = current.where(~F.col("record_is_active")).select(
        *[col(c).cast(result.schema[c].dataType).alias(c) for c in result.columns]
    )
    return closed.unionByName(result)


def newest_first(versions: DataFrame, identity: list[str]) -> DataFrame:
    """Every version with its `place` in its source's history: 1 is the newest."""
    newest = versions.groupBy(*cols(identity)).agg(F.max("version").alias("_newest"))
    return (
        versions.join(newest, identity)
        .withColumn("place", F.col("_newest") - F.col("version") + 1)
        .drop("_newest")
    )


def history(versions: DataFrame, identity: dict) -> DataFrame:
    """All versions of one source, newest first; a missing definition path equals a blank one."""
    found = versions
    for name, value in identity.items():
        if name == "definition_path":
            found = found.where(F.coalesce(col(name), F.lit("")) == (value or ""))
        else:
            found = found.where(col(name) == value)
    return found.orderBy(F.desc("version"))


def schema_diff(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """Which columns were added, removed, retyped or moved between two column inventories."""

    def side(df, prefix):
        return df.select(
            *[col(i).alias(f"{prefix}{i}") for i in identity],
            *[col(c).alias(f"{prefix}{c}") for c in INVENTORY],
        )

    keys = [*identity, "name"]
    on = F.lit(True)
    for k in keys:
        on = on & col(f"old_{k}").eqNullSafe(col(f"new_{k}"))

    def compact(c):
        return F.upper(F.regexp_replace(c, r"\s+", ""))

    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "removed")
        .when(compact("old_sql_type") != compact("new_sql_type"), "retyped")
        .when(
            (F.col("old_ordinal") != F.col("new_ordinal"))
            | ~F.col("old_path").eqNullSafe(F.col("new_path")),
            "moved",
        )
    )
    return (
        side(old, "old_")
        .join(side(new, "new_"), on, "full_outer")
        .select(
            *[F.coalesce(col(f"old_{k}"), col(f"new_{k}")).alias(k) for k in keys],
            change.alias("change"),
            "old_ordinal", "new_ordinal", "old_sql_type", "new_sql_type",
        )
        .where("change IS NOT NULL")
    )


def stale_consumers(consumers: DataFrame, links: DataFrame, versions: DataFrame) -> DataFrame:
    """Consumers built from a version of a source that is no longer the active one.

    `links` ties a consumer to the version id it was built from.
    """
    identity = ["source_type", "source_path", "definition_path"]
    v = versions.withColumn("definition_path", F.coalesce("definition_path", F.lit("")))
    active = v.where("record_is_active").select(
        *identity, F.col("version_id").alias("current_id"), F.col("version").alias("current_version")
    )
    # Versions are few and unique; which of them are out of date is settled before the links come in.
    stale = (
        v.select("version_id", *identity, F.col("version").alias("built_from_version"))
        .join(active, identity)
        .where("current_id <> version_id")
    )
    return (
        links.join(stale, "version_id")
        .withColumnRenamed("version_id", "built_from_id")
        .join(consumers, "consumer_id")
    )


def clean_edges(edges: DataFrame) -> DataFrame:
    """Each (downstream, upstream) pair once, without self loops."""
    return edges.select("downstream", "upstream").where("downstream <> upstream").distinct()


def degrees(tables: DataFrame, edges: DataFrame, key: str = "table_id") -> DataFrame:
    """How many tables each table is built from, and how many are built from it."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("downstream").alias(key), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(F.col("upstream").alias(key), F.lit(0).alias("up"), F.lit(1).alias("down")),
            )
        ).alias("end")
    ).select("end.*")
    counted = ends.groupBy(key).agg(F.sum("up").alias("upstream_count"), F.sum("down").alias("downstream_count"))
    return tables.join(counted, key, "left").na.fill(0, ["upstream_count", "downstream_count"])


def neighbors(tables: DataFrame, edges: DataFrame, of: DataFrame, key: str = "table_id") -> DataFrame:
    """The direct neighbours of the tables in `of`, each with its direction."""
    start = of.select(col(key).alias("_of")).distinct()
    up = edges.select(
        F.col("downstream").alias("_of"), F.col("upstream").alias(key), F.lit("upstream").alias("direction")
    )
    down = edges.select(
        F.col("upstream").alias("_of"), F.col("downstream").alias(key), F.lit("downstream").alias("direction")
    )
    return (
        up.unionByName(down)
        .join(start, "_of", "left_semi")
        .join(tables, key)
        .withColumnRenamed("_of", "of_table")
    )


def usage_vs_limit(owners: DataFrame, items: DataFrame, tiers: DataFrame) -> DataFrame:
    """Items per owner against the limit of the owner's tier; owners without items count too.

    `owners` has owner_id and tier, `items` owner_id, `tiers` tier and item_limit.
    """
    counted = items.groupBy("owner_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (
        owners.join(tiers, "tier")
        .join(counted, "owner_id", "left")
        .na.fill(0, ["item_count"])
        .withColumn("can_add", F.col("item_count") < F.col("item_limit"))
    )
