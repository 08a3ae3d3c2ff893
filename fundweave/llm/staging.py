"""Shared-folder helpers: every intermediate that is used twice is a written table there.

A written table survives the loss of any executor, which neither a cached block nor a
local checkpoint does.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_root(application: str) -> str:
    """The folder of a local application; the setting itself cannot be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="fundweave-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder, under spark.checkpoint.dir, that all executors can reach.

    Where that setting is absent the session must be a local one; its folder is then
    made once, with tempfile.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = _local_root(spark.sparkContext.applicationId)
    if root.startswith("/"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def like(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns, whatever their names, play no part."""
    return df.select(*[df[f"`{n}`"] for n in names])


#: A key counts as hot from one in so many of its table's rows: fewer keys than this are hot.
HOT_KEYS = 1024


def join_unique(left: DataFrame, right: DataFrame, on: list[str], rows: int, n: str = "n") -> DataFrame:
    """left inner-joined to right, a written table of one row a key and the key's number n of left's rows.

    A key with more than 1 in HOT_KEYS of left's rows would fill a task of its own. There
    are fewer than HOT_KEYS of those, whatever the size of the table, so they are broadcast
    and their rows stay where they are; the rows of all other keys are shuffled.
    """
    limit = max(1, rows // HOT_KEYS)
    hot, cold = right.where(F.col(n) > limit).drop(n), right.where(F.col(n) <= limit).drop(n)
    if hot.isEmpty():
        return left.join(cold, on)
    near = left.join(F.broadcast(hot), on)
    far = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until df has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
