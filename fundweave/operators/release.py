"""Release checks over inventories of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """release_id, name, status: OK, MISSING, EXTRA or TAMPERED; both tables (release_id, name, sha256)."""
    a = actual.select("release_id", "name", F.col("sha256").alias("_sha"))
    j = expected.join(a, ["release_id", "name"], "full_outer")
    status = F.when(F.col("sha256").isNull(), "EXTRA").when(F.col("_sha").isNull(), "MISSING").when(F.col("sha256") == F.col("_sha"), "OK").otherwise("TAMPERED")
    return j.select("release_id", "name", status.alias("status"))


def release_status(releases: DataFrame, expected: DataFrame, actual: DataFrame, sizes: tuple[int, ...] = (5, 8)) -> DataFrame:
    """release_id, n_artifacts, n_problems, ready.

    releases (release_id, drifted, tests_passed, git_sha, built_sha). Ready needs an
    inventory of a legal size without a problem, no drift, passed tests, and the same sha.
    """
    d = inventory_diff(expected, actual).groupBy("release_id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.count_if(F.col("status") != "OK").alias("n_problems"))
    r = releases.join(d, "release_id", "left").fillna(0, ["n_artifacts", "n_problems"])
    ready = F.col("n_artifacts").isin(*sizes) & (F.col("n_problems") == 0) & ~F.col("drifted") & F.col("tests_passed") & F.col("git_sha").eqNullSafe(F.col("built_sha"))
    return r.select("release_id", "n_artifacts", "n_problems", F.coalesce(ready, F.lit(False)).alias("ready"))
