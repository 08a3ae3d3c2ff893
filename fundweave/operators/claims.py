"""Checks of model-written claims against cited evidence, and their metrics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundweave.shared import values_at_ranks

OUTPUT = "summary string, claims array<struct<text string, cited_evidence_ids array<string>>>"
#: Lengths of a summary and a claim, and budgets.
MAX_SUMMARY, MAX_CLAIM = 2000, 500
MAX_CALLS, MAX_IN, MAX_OUT, MAX_MONTH = 6, 60_000, 8_000, 200_000


def _shape(raw: Column, x: Column) -> Column:
    """Whether the text is a well-formed answer: two keys, texts of legal length, citation lists."""
    keys = F.array_sort(F.json_object_keys(raw))
    claims = F.col("_out.claims")
    good = F.forall(claims, lambda c: c["text"].isNotNull() & F.length(c["text"]).between(1, MAX_CLAIM) & c["cited_evidence_ids"].isNotNull())
    size = F.length(F.col("_out.summary")).between(1, MAX_SUMMARY)
    return F.coalesce((keys == F.array(F.lit("claims"), F.lit("summary"))) & size & claims.isNotNull() & good, F.lit(False))


def claim_status(runs: DataFrame) -> DataFrame:
    """runs with status, claims (emptied unless all citations hold), n_claims.

    runs (run_id, case_id, provider_on, transport, answer JSON text, evidence_ids array).
    The first rule that holds decides: no evidence INSUFFICIENT_EVIDENCE; provider off,
    budget or transport error AI_UNAVAILABLE; malformed answer AI_INVALID_OUTPUT; any claim
    without a citation or with one that is not the case's AI_INVALID_OUTPUT, all claims
    dropped; else HYPOTHESIS_GENERATED, with or without claims.
    """
    parsed = runs.withColumn("_out", F.from_json("answer", OUTPUT, {"mode": "PERMISSIVE"}))
    claims = F.coalesce("_out.claims", F.array().cast("array<struct<text:string,cited_evidence_ids:array<string>>>"))
    bad = F.exists(claims, lambda c: (F.size(c["cited_evidence_ids"]) == 0) | (F.size(F.array_except(c["cited_evidence_ids"], F.col("evidence_ids"))) > 0))
    status = (
        F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "INSUFFICIENT_EVIDENCE")
        .when(~F.col("provider_on"), "AI_UNAVAILABLE")
        .when(F.col("transport") != "OK", "AI_UNAVAILABLE")
        .when(~_shape(F.col("answer"), claims), "AI_INVALID_OUTPUT")
        .when(bad, "AI_INVALID_OUTPUT")
        .otherwise("HYPOTHESIS_GENERATED")
    )
    out = parsed.withColumn("status", status)
    kept = F.when(F.col("status") == "HYPOTHESIS_GENERATED", claims).otherwise(F.slice(claims, 1, 0))
    return out.withColumn("valid_claims", kept).withColumn("n_claims", F.size("valid_claims")).withColumn("written_claims", claims).drop("_out")


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, empty).otherwise(part / F.nullif(whole, F.lit(0)))


def claim_metrics(checked: DataFrame) -> DataFrame:
    """One row over claim_status(): citation_precision, claim_coverage, unsupported_claims, abstention_rate."""
    per = checked.select(
        "status",
        F.aggregate("written_claims", F.lit(0), lambda a, c: a + F.size(c["cited_evidence_ids"])).alias("cited"),
        F.aggregate("written_claims", F.lit(0), lambda a, c: a + F.size(F.array_intersect(c["cited_evidence_ids"], F.col("evidence_ids")))).alias("valid"),
        F.size("written_claims").alias("claims"),
        F.size(F.filter("written_claims", lambda c: F.size(F.array_intersect(c["cited_evidence_ids"], F.col("evidence_ids"))) > 0)).alias("covered"),
    )
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    abstained = F.count_if(F.col("status").isin("INSUFFICIENT_EVIDENCE", "AI_UNAVAILABLE"))
    return per.agg(
        _ratio(s("valid"), s("cited"), 1.0).alias("citation_precision"), _ratio(s("covered"), s("claims"), 1.0).alias("claim_coverage"),
        (s("claims") - s("covered")).alias("unsupported_claims"), _ratio(abstained, F.count(F.lit(1)), 0.0).alias("abstention_rate"),
    )


def nearest_rank(df: DataFrame, column: str, *shares: float, by: tuple[str, ...] = ()) -> DataFrame:
    """p<share> of each group: the value at rank ceil(share * n), the least for 0; 0.0 if there is none."""
    ranks = lambda n: F.array(*[F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)).cast("long") for p in shares])
    found = values_at_ranks(df, by, column, ranks).groupBy(*by).agg(*[F.max(F.when(F.col("rank_id") == i, F.col("value"))).alias(f"v{i}") for i in range(len(shares))])
    if by:
        groups = df.select(*by).distinct()
        same = functools.reduce(lambda a, b: a & b, [groups[c].eqNullSafe(found[c]) for c in by])
        found = groups.join(found, same, "left").select(*[groups[c] for c in by], *[f"v{i}" for i in range(len(shares))])
    return found.select(*by, *[F.coalesce(f"v{i}", F.lit(0.0)).alias(f"p{round(100 * p)}") for i, p in enumerate(shares)])


def usage_by_case(attempts: DataFrame) -> DataFrame:
    """case_id, calls, tokens settled and pending, and whether a limit is passed.

    attempts (case_id, month_key, status, reserved_in, reserved_out, reserved_cost,
    actual_in, actual_out, actual_cost). Released attempts do not count.
    """
    settled, pending = F.col("status") == "RECONCILED", F.col("status").isin("RESERVED", "DISPATCHED")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    u = attempts.groupBy("case_id").agg(
        F.count_if(settled | pending).alias("calls"),
        total("actual_in", settled).alias("settled_in"), total("actual_out", settled).alias("settled_out"),
        total("reserved_in", pending).alias("pending_in"), total("reserved_out", pending).alias("pending_out"),
    )
    return u.withColumn(
        "over_limit",
        (F.col("calls") > MAX_CALLS) | (F.col("settled_in") + F.col("pending_in") > MAX_IN) | (F.col("settled_out") + F.col("pending_out") > MAX_OUT),
    )


def usage_by_month(attempts: DataFrame) -> DataFrame:
    """month_key, committed_cost, over_limit."""
    cost = F.when(F.col("status") == "RECONCILED", F.col("actual_cost")).when(F.col("status").isin("RESERVED", "DISPATCHED"), F.col("reserved_cost"))
    m = attempts.groupBy("month_key").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("committed_cost"))
    return m.withColumn("over_limit", F.col("committed_cost") > MAX_MONTH)
