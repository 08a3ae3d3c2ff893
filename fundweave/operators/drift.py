"""Population stability of a numeric column between a baseline and a current table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundweave.shared import values_at_ranks

#: Floor of a share, and the index from which a column has drifted.
FLOOR, THRESHOLD = 1e-9, 0.1


def quantile_edges(baseline: DataFrame, column: str, n: int) -> list[float]:
    """n + 1 strictly increasing edges, the outer ones infinite.

    Quantiles are exact, by linear interpolation: 2 (n - 1) values come to the driver.
    """
    at = [i / n for i in range(1, n)]
    last = lambda size: (size - 1).cast("double")
    ranks = lambda size: F.array(*[f(last(size) * p).cast("long") for p in at for f in (F.floor, F.ceil)])
    rows = values_at_ranks(baseline.select(F.col(column).cast("double").alias("x")), (), "x", ranks).crossJoin(F.broadcast(baseline.agg(F.count(column).alias("n"))))  # one row
    found = {r.rank_id: (r.value, r.n) for r in rows.collect()}
    edges = [-math.inf]
    for i, p in enumerate(at if found else []):
        (low, size), (high, _) = found[2 * i], found[2 * i + 1]
        share = p * (size - 1) - math.floor(p * (size - 1))
        x = low if low == high else low * (1 - share) + high * share
        edges.append(max(float(x), math.nextafter(edges[-1], math.inf)) if edges[-1] > -math.inf else float(x))
    return [*edges, math.inf]


def bin_of(column: str, edges: list[float]) -> Column:
    """0-based bin; bins are closed at their lower edge and open at the upper."""
    inner = F.array(*[F.lit(x) for x in edges[1:-1]]).cast("array<double>")
    return F.size(F.filter(inner, lambda e: F.col(column) >= e))


def psi_bins(baseline: DataFrame, column: str, n: int) -> tuple[list[float], DataFrame]:
    """(edges, table (bin, n, share)) of the baseline, a row a bin, empty bins included."""
    edges = quantile_edges(baseline, column, n)
    return edges, bin_shares(baseline, column, edges)


def bin_shares(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(bin_of(column, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(counts, "bin", "left").fillna(0, ["n"])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return filled.crossJoin(F.broadcast(total)).select("bin", "n", F.when(F.col("all") == 0, 0.0).otherwise(F.col("n") / F.nullif("all", F.lit(0))).alias("share"))  # one row


def psi(edges: list[float], base: DataFrame, current: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row: psi and whether it has reached the threshold."""
    b, c = F.greatest("b", F.lit(FLOOR)), F.greatest("c", F.lit(FLOOR))
    j = base.select("bin", F.col("share").alias("b")).join(bin_shares(current, column, edges).select("bin", F.col("share").alias("c")), "bin")
    value = F.greatest(F.sum((c - b) * F.log(c / b)), F.lit(0.0))
    return j.agg(value.alias("psi")).withColumn("drifted", F.col("psi") >= threshold)
