"""Queries over models. Iterative fits are beyond SQL: rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundweave.operators import features, models
from fundweave.plans import tables as t
from fundweave.plans.tables import CUTOFF

COLUMNS = ["in_degree", "out_degree", "amount_in", "amount_out", "pass_through_ratio"]


def _accounts(spark, d):
    """Features at the cutoff; the label is whether an account sends more than 100 in one later transfer."""
    e = t.edges(spark, d)
    f = features.account_features(e, CUTOFF)
    later = e.where(F.col("event_time") > F.lit(CUTOFF).cast("timestamp")).groupBy(F.col("source_id").alias("account_id")).agg(F.max("amount").alias("m"))
    f = f.join(later, "account_id", "left").withColumn("label", F.coalesce((F.col("m") > 120).cast("int"), F.lit(0))).drop("m")
    return f.withColumn("row_id", F.expr("cast(substring(account_id, 2) as long)"))


def _logistic(spark, d):
    a = _accounts(spark, d)
    model = models.fit_logistic(a.where("row_id % 3 > 0"), COLUMNS)
    return models.predict_scores(model, a, COLUMNS).select("account_id", "label", F.round("score", 6).alias("score"))


def _trees(spark, d):
    a = _accounts(spark, d)
    model = models.fit_boosted_trees(a.where("row_id % 3 > 0"), COLUMNS)
    return models.predict_scores(model, a, COLUMNS).select("account_id", "label", F.round("score", 6).alias("score"))


def _calibrated(spark, d):
    a = _accounts(spark, d)
    model = models.fit_logistic(a.where("row_id % 3 = 1"), COLUMNS)
    scored = models.predict_scores(model, a, COLUMNS)
    return models.calibrate(scored.where("row_id % 3 = 2"), scored).select("account_id", F.round("score", 6).alias("score"), F.round("calibrated", 6).alias("calibrated"))


def _labelled(spark, d):
    c = t.case_edges(spark, d)
    k = F.substring("edge_id", 2, 20).cast("long")
    label = F.when(k % 4 == 0, "UNKNOWN").when(F.col("amount") + k % 30 > 70, "RELEVANT").otherwise("CONFIRMED_BENIGN")
    return c.withColumn("label", label).withColumn("size", F.log1p("amount")).withColumn("at", F.coalesce(F.hour("event_time"), F.lit(-1))).withColumn("k", k)


def _ranker(spark, d):
    e = _labelled(spark, d)
    model = models.fit_edge_ranker(e.where("k % 2 = 0"), ["size", "at"])
    return models.rank(model, e, ["size", "at"]).select("case_id", "edge_id", F.round("score", 6).alias("score"), "rank")


def _pairwise(spark, d):
    e = _labelled(spark, d)
    model = models.fit_pairwise_ranker(e.where("k % 2 = 0"), ["size", "at"])
    return models.rank(model, e, ["size", "at"]).select("case_id", "edge_id", F.round("score", 6).alias("score"), "rank")


def _neighborhood(spark, d):
    e = features.at_or_before(t.edges(spark, d), CUTOFF)
    a = _accounts(spark, d)
    n = features.neighborhood_features(e, a, COLUMNS)
    wide = [c for c in n.columns if c != "account_id"]
    full = n.join(a.select("account_id", "label", "row_id"), "account_id")
    model = models.fit_logistic(full.where("row_id % 3 > 0"), wide)
    return models.predict_scores(model, full, wide).select("account_id", "label", F.round("score", 6).alias("score"))


QUERIES = {
    "logistic_scores": _logistic,
    "boosted_tree_scores": _trees,
    "calibrated_scores": _calibrated,
    "edge_ranker": _ranker,
    "edge_ranker_pairwise": _pairwise,
    "neighborhood_scores": _neighborhood,
}

ORACLE_SQL: dict[str, str] = {}
