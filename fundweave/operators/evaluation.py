"""Evaluation of detection and tracing."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundweave.shared import staged

LABELS = ("RELEVANT", "CONFIRMED_BENIGN", "UNKNOWN")


def training_mask(labels: DataFrame) -> DataFrame:
    """Unknown is a third value, never a negative."""
    return labels.where(F.col("label") != "UNKNOWN")


def trace_metrics(returned: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a case: recall of relevant edges, shares of benign and unknown among the returned.

    A returned edge without a label is an error, so it is an error to divide by.
    """
    j = labels.join(returned.select("case_id", "edge_id", F.lit(True).alias("hit")), ["case_id", "edge_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    n = F.count_if(hit)
    share = lambda label: F.when(n == 0, 0.0).otherwise(F.count_if(hit & (F.col("label") == label)) / F.nullif(n, F.lit(0)))
    relevant = F.count_if(F.col("label") == "RELEVANT")
    return j.groupBy("case_id").agg(
        F.when(relevant == 0, 0.0).otherwise(F.count_if(hit & (F.col("label") == "RELEVANT")) / F.nullif(relevant, F.lit(0))).alias("recall"),
        share("CONFIRMED_BENIGN").alias("benign_share"), share("UNKNOWN").alias("unknown_share"),
    )


def unlabelled_returns(returned: DataFrame, labels: DataFrame) -> DataFrame:
    return returned.join(labels, ["case_id", "edge_id"], "left_anti")


def running_sums(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """df with upto_<column>: sums of all rows with an order value at least this one's, descending.

    Rows are range-partitioned; totals of partitions, a row each, are added to the sums
    within. df has one row a value of order.
    """
    key = F.col(order).desc()
    ranged = staged(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "running")
    within = Window.partitionBy("__part").orderBy(key)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    base = base.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    out = ranged.join(F.broadcast(base), "__part")  # a row a partition
    return out.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"__{c}")).alias(f"upto_{c}") for c in columns])


def average_precision(scores: DataFrame) -> DataFrame:
    """Step-wise: at each distinct score, the gain of recall times the precision (y, score)."""
    groups = scores.groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = running_sums(groups, "score", "pos", "n")
    total = groups.agg(F.sum("pos").alias("all_pos"))
    step = F.col("pos") * (F.col("upto_pos") / F.col("upto_n"))
    return run.crossJoin(F.broadcast(total)).agg(  # one row
        F.coalesce(F.sum(step) / F.nullif(F.max("all_pos"), F.lit(0)), F.lit(0.0)).alias("average_precision")
    )


def precision_at(scores: DataFrame, k: int) -> DataFrame:
    """Mean label of the k best rows (row_id, y, score), the earlier row first in a tie."""
    return scores.orderBy(F.desc("score"), F.asc("row_id")).limit(k).agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("precision_at_k"), F.count(F.lit(1)).alias("n_alerts"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def detection_metrics(scores: DataFrame, k: int) -> DataFrame:
    """One row: average_precision, precision_at_k, n_alerts, brier."""
    return average_precision(scores).crossJoin(precision_at(scores, k)).crossJoin(brier(scores))  # a row each


def top_alerts(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows with their rank."""
    top = scores.orderBy(F.desc("score"), F.asc("row_id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("row_id"))))


def rank_edges(scored: DataFrame) -> DataFrame:
    """Edges with rank within their case: the higher score, then the smaller edge id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "edge_id")))


#: Fixed values of the gate: seeds of a run, bound of the resampled mean, least number of gains.
SEEDS = (11, 23, 37, 53, 71)
LOWER, LEAST_GAINS = 0.025, 4


def bootstrap_gate(runs: DataFrame) -> DataFrame:
    """runs with lower_bound, n_gains, selected.

    baseline and candidate are arrays of five metrics. All 5^5 resamples of the five paired
    differences are equally likely, so the bound is exact and needs no seed. Resamples of the
    same picks in another order have the same mean: 126 picks stand for them, each counted as
    often as it can be ordered.
    """
    n = len(SEEDS)
    diff = F.zip_with("candidate", "baseline", lambda c, b: c - b)
    r = runs.withColumn("_d", diff)
    orders = lambda picks: math.factorial(n) // math.prod(math.factorial(picks.count(i)) for i in set(picks))
    every = F.array(*[F.struct(F.array(*map(F.lit, p)).alias("i"), F.lit(orders(p)).alias("n")) for p in itertools.combinations_with_replacement(range(n), n)])
    pick = [F.get("_d", F.get("_p.i", F.lit(k))) for k in range(n)]
    means = r.withColumn("_p", F.explode(every)).withColumn("_m", sum(pick[1:], pick[0]) / n)
    keys = runs.columns
    bound = means.groupBy(*keys, "_d").agg(F.percentile("_m", LOWER, F.col("_p.n")).alias("lower_bound"))
    out = bound.withColumn("n_gains", F.size(F.filter("_d", lambda x: x > 0)))
    return out.withColumn("selected", (F.col("lower_bound") > 0) & (F.col("n_gains") >= LEAST_GAINS)).drop("_d")
