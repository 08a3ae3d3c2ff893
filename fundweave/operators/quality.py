"""Validation, quarantine and quality reports of raw transfer tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundweave.functions.scalars import is_finite, lenient_double, missing_id
from fundweave.shared import with_ordinal

#: Reason codes, in their order of precedence.
BAD_ID = "missing_or_blank_identifier"
BAD_AMOUNT = "non_positive_or_non_finite_amount"
BAD_TICK = "negative_or_invalid_tick"
REASONS = (BAD_ID, BAD_AMOUNT, BAD_TICK)

#: The public columns of an edge.
EDGE = ("edge_id", "source_id", "target_id", "amount", "event_time")


class Raw(NamedTuple):
    """Column names of a raw table with relative ticks."""

    source: str = "sourceNodeId"
    target: str = "targetNodeId"
    value: str = "value"
    time: str = "time"


def reason_code(raw: Raw = Raw(), kinds: T.StructType | None = None) -> Column:
    """The first reason to reject a row, or null.

    kinds: the table's types, where they are known; columns of numbers are then not read as text.
    """
    known = {f.name for f in kinds or () if isinstance(f.dataType, T.NumericType)}
    value, tick = (F.col(c).cast("double") if c in known else lenient_double(F.col(c)) for c in (raw.value, raw.time))
    bad_id = missing_id(F.col(raw.source).cast("string")) | missing_id(F.col(raw.target).cast("string"))
    good_tick = is_finite(tick) & (tick >= 0) & (tick == F.floor(tick))
    return (
        F.when(bad_id, BAD_ID)
        .when(~is_finite(value) | F.coalesce(value <= 0, F.lit(True)), BAD_AMOUNT)
        .when(~F.coalesce(good_tick, F.lit(False)), BAD_TICK)
    )


def clean_transfers(df: DataFrame, *order: str, raw: Raw = Raw()) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined). The latter has row_ordinal, by the order columns, and reason_code.

    Amounts are never clipped and duplicates never removed.
    """
    reason = reason_code(raw, df.schema)
    accepted = df.where(reason.isNull())
    if not order:
        return accepted, df.withColumn("reason_code", reason).where("reason_code is not null")
    marked = with_ordinal(df, *order).withColumn("reason_code", reason)
    return accepted, marked.where("reason_code is not null")


def quality_report(df: DataFrame, raw: Raw = Raw(), source_id: str | None = None, raw_sha256: str | None = None) -> DataFrame:
    """One row: counts, duplicates, a count for each reason, schema_hash, report_hash.

    With source_id and raw_sha256 the report names them, and its hash covers them.

    Rows are counted once for each distinct content, so duplicates come from the same
    aggregate as the rest.
    """
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    each = df.select(content.alias("h"), reason_code(raw, df.schema).alias("reason")).groupBy("h", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    counts = [F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in REASONS]
    report = each.agg(
        total.alias("input_rows"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted_rows"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("rejected_rows"),
        (total - F.count(F.lit(1))).alias("duplicate_rows"),
        *counts,
    )
    if source_id is not None and raw_sha256 is not None:
        report = report.withColumns({"source_id": F.lit(source_id), "raw_sha256": F.lit(raw_sha256)})
    report = report.withColumn("schema_hash", F.sha2(F.lit(",".join(df.columns)), 256))
    return report.withColumn("report_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in report.columns]), 256))


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and exact duplicates; nothing is removed."""
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return each.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def canonical_violations(df: DataFrame) -> DataFrame:
    """One row with a count of each way in which df is no canonical edge table."""
    counts = [F.count_if(missing_id(F.col(c))).alias(f"bad_{c}") for c in EDGE[:3]]
    counts += [F.count_if(~is_finite(F.col("amount"))).alias("bad_amount"), F.count_if(F.col("event_time").isNull()).alias("bad_event_time")]
    return df.agg(*counts)


def assert_canonical(df: DataFrame) -> None:
    """Raises unless df is a canonical edge table; messages hold rules, never values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lacking = sorted(set(EDGE) - set(kinds))
    if lacking:
        raise ValueError(f"missing canonical columns: {lacking}")
    for c in EDGE[:3]:
        if not isinstance(kinds[c], T.StringType):
            raise ValueError(f"{c} must be a string")
    if not isinstance(kinds["amount"], T.NumericType):
        raise ValueError("amount must be numeric")
    if not isinstance(kinds["event_time"], T.TimestampType):
        raise ValueError("event_time must be a timestamp with a time zone")
    found = canonical_violations(df).first().asDict()
    if broken := sorted(k for k, n in found.items() if n):
        raise ValueError(f"canonical rules broken: {broken}")


def public_projection(df: DataFrame) -> DataFrame:
    """The public columns alone, in the order in which df has them."""
    return df.select(*[c for c in df.columns if c in EDGE])


def account_labels(nodes: DataFrame, id_col: str = "nodeid", flag_col: str = "isFraud", step_col: str = "fraudStep") -> DataFrame:
    """account_id, is_fraud, label_provenance; the flag must be exactly 0 or 1."""
    flag = F.col(flag_col).cast("double")
    out = nodes.select(
        F.col(id_col).cast("string").alias("account_id"),
        F.when(flag.isin(0.0, 1.0), flag.cast("int")).alias("is_fraud"),
        F.col(step_col).cast("string").alias("label_provenance"),
    )
    return out


def assert_labels(labels: DataFrame) -> None:
    if labels.where("is_fraud is null").limit(1).count():
        raise ValueError("a label is neither 0 nor 1")


def event_violations(df: DataFrame) -> DataFrame:
    """df with violation: the first event rule a row breaks, or null."""
    return df.withColumn(
        "violation",
        F.when(missing_id(F.col("edge_id")) | missing_id(F.col("source_id")) | missing_id(F.col("target_id")), "BLANK_ID")
        .when(~is_finite(F.col("amount")) | (F.col("amount") <= 0), "BAD_AMOUNT")
        .when(F.col("event_time").isNull(), "NO_TIME"),
    )


#: Largest whole number that a double holds exactly with all below it.
MAX_SAFE_VND = 9_007_199_254_740_991


def trace_edge_violations(df: DataFrame) -> DataFrame:
    """df with violation, over flow_amount, currency, confidence."""
    amount = F.col("flow_amount")
    return df.withColumn(
        "violation",
        F.when(~is_finite(amount) | (amount < 0), "BAD_AMOUNT")
        .when(F.col("currency").isNotNull() & ~F.col("currency").rlike("^[A-Z]{3}$"), "BAD_CURRENCY")
        .when((F.col("currency") == "VND") & ((F.floor(amount) != amount) | (amount > MAX_SAFE_VND)), "BAD_VND")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "BAD_CONFIDENCE"),
    )


def trace_node_violations(df: DataFrame, badges: tuple[str, ...]) -> DataFrame:
    """df with violation, over risk_score, account_last4, badge."""
    return df.withColumn(
        "violation",
        F.when(~F.coalesce(F.col("risk_score").between(0, 1), F.lit(False)), "BAD_RISK")
        .when(F.col("account_last4").isNotNull() & ~F.col("account_last4").rlike(r"^\d{4}$"), "BAD_LAST4")
        .when(F.col("badge").isNotNull() & ~F.col("badge").isin(*badges), "BAD_BADGE"),
    )


def manifest_violations(df: DataFrame) -> DataFrame:
    """df with violation, over sha256, url, name, seed, trial_cap, budget."""
    return df.withColumn(
        "violation",
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "BAD_HASH")
        .when(~F.coalesce(F.col("url").rlike(r"^https://\S+$"), F.lit(False)), "BAD_URL")
        .when(missing_id(F.col("name")), "BLANK_NAME")
        .when(~F.coalesce(F.col("trial_cap").between(1, 50), F.lit(False)), "BAD_TRIAL_CAP")
        .when(~F.coalesce(F.col("budget") > 0, F.lit(False)), "BAD_BUDGET"),
    )


def admission(df: DataFrame) -> DataFrame:
    """df with required_bytes and verdict: whether a source fits in the free space."""
    parts = ["archive_bytes", "extraction_bytes", "processed_bytes", "temp_bytes", "headroom_bytes"]
    required = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    negative = F.lit(False)
    for c in [*parts, "free_bytes"]:
        negative = negative | (F.col(c) < 0)
    return df.withColumn("required_bytes", required).withColumn(
        "verdict", F.when(negative, "INVALID").when(F.col("free_bytes") >= F.col("required_bytes"), "READY").otherwise("SKIPPED_BY_RESOURCE")
    )
