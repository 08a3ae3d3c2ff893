"""Leakage audits of splits, and order checks of run stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN = "train"


def split_members(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Case records with their track; a manifest id without a record is an error."""
    if manifest.join(records, "case_id", "left_anti").limit(1).count():
        raise ValueError("the manifest names a case without a record")
    return manifest.select("track", "case_id").join(records, "case_id")


def split_overlap(members: DataFrame) -> DataFrame:
    """kind (entity, edge, seed), id: what training shares with other tracks, a row each.

    A group-by of each id over its tracks, so an id that stands in every case is a row a
    task, not a join.
    """
    ids = members.select(
        (F.col("track") == TRAIN).alias("is_train"),
        F.explode(F.concat(
            F.transform("entity_ids", lambda x: F.struct(F.lit("entity").alias("kind"), x.alias("id"))),
            F.transform("edge_ids", lambda x: F.struct(F.lit("edge").alias("kind"), x.alias("id"))),
            F.array(F.struct(F.lit("seed").alias("kind"), F.col("generator_seed").cast("string").alias("id"))),
        )).alias("x"),
    ).select("is_train", "x.*")
    both = ids.groupBy("kind", "id").agg(F.bool_or("is_train").alias("t"), F.bool_or(~F.col("is_train")).alias("o"))
    return both.where("t and o").select("kind", "id")


def assert_split_safe(members: DataFrame) -> None:
    found = {r.kind: r["count"] for r in split_overlap(members).groupBy("kind").count().collect()}  # three rows at most
    for kind in ("entity", "edge", "seed"):
        if found.get(kind):
            raise ValueError(f"training shares {found[kind]} {kind} ids with other tracks")


def embargo_violations(ticks: DataFrame, cutoff: int, embargo: int) -> DataFrame:
    """Ticks in (cutoff, cutoff + embargo], sorted."""
    return ticks.where((F.col("tick") > cutoff) & (F.col("tick") <= cutoff + embargo)).orderBy("tick")


def temporal_split_audit(ticks: DataFrame, ids: DataFrame, cutoff: int, embargo: int) -> DataFrame:
    """One row: status and its reasons.

    ticks (tick); ids (side train|test, kind entity|edge, id). A missing side of the cutoff
    or id set makes the split NOT_EVALUABLE, whatever else; an overlap of ids or a tick in
    the embargo BLOCKED_DATA; else SAFE.
    """
    a = ticks.agg(
        F.coalesce(F.bool_or(F.col("tick") <= cutoff), F.lit(False)).alias("has_before"),
        F.coalesce(F.bool_or(F.col("tick") > cutoff), F.lit(False)).alias("has_after"),
        F.count_if((F.col("tick") > cutoff) & (F.col("tick") <= cutoff + embargo)).alias("n_embargo"),
    )
    sets = ids.groupBy("kind", "id").agg(F.bool_or(F.col("side") == "train").alias("tr"), F.bool_or(F.col("side") == "test").alias("te"))
    b = sets.agg(
        *[F.count_if((F.col("kind") == k) & F.col(c)).alias(f"n_{c}_{k}") for k in ("entity", "edge") for c in ("tr", "te")],
        F.count_if(F.col("tr") & F.col("te")).alias("n_overlap"),
    )
    sides = F.col("has_before") & F.col("has_after")
    for k in ("entity", "edge"):
        for c in ("tr", "te"):
            sides = sides & (F.col(f"n_{c}_{k}") > 0)
    one = a.withColumn("_1", F.lit(1)).join(b.withColumn("_1", F.lit(1)), "_1")  # a row each
    status = F.when(~sides, "NOT_EVALUABLE").when((F.col("n_overlap") > 0) | (F.col("n_embargo") > 0), "BLOCKED_DATA").otherwise("SAFE")
    return one.select(status.alias("status"), "n_overlap", "n_embargo")


#: The stages of a run, in order.
STAGES = ("PREREGISTERED", "DATA_VERIFIED", "FITTED", "VALIDATED", "CALIBRATED", "FROZEN", "TESTED", "TRACE_EVALUATED", "DECIDED")


def stage_violations(log: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Rows of (run_id, seq, stage) whose stage is not the successor of the one before."""
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    w = Window.partitionBy("run_id").orderBy("seq")
    return log.withColumn("_at", at).withColumn("_before", F.coalesce(F.lag("_at").over(w), F.lit(0))).where(
        (F.col("_at") == 0) | (F.col("_at") != F.col("_before") + 1)
    ).drop("_at", "_before")
