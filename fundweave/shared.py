"""Written tables in the shared folder, for what is used twice or cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _local_root(application: str) -> str:
    """The folder of a local application; the setting itself cannot be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="fundweave-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = _local_root(spark.sparkContext.applicationId)
    if root.startswith("/"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, *order: str, name: str = "row_ordinal") -> DataFrame:
    """df with dense 0-based ordinals in the given order, without one task for all rows.

    The rows are range-partitioned and numbered within their partition; one row a partition
    carries the numbers of rows before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy(part.alias("__part")).count()
    base = base.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    out = numbered.withColumn("__part", part).join(F.broadcast(base), "__part")  # a row a partition
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__base")


def values_at_ranks(df: DataFrame, by: tuple[str, ...], column: str, ranks) -> DataFrame:
    """The by columns, rank_id, value: for each group the values at the 0-based ranks that ranks(n) names.

    ranks: from the column of a group's number of values to an array column of ranks.
    Nulls have no rank. The values are range-partitioned and numbered, so that no task
    holds a group; only the values asked for are joined.
    """
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"))
    ordered = with_ordinal(values, *by, "value", name="__rank")
    groups = ordered.groupBy(*by).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    asked = groups.select(*by, "__first", F.posexplode(ranks(F.col("__n"))).alias("rank_id", "__at"))
    asked = asked.select(*by, "rank_id", (F.col("__first") + F.col("__at")).alias("__rank"))
    return asked.join(ordered.select("__rank", "value"), "__rank").select(*by, "rank_id", "value")
