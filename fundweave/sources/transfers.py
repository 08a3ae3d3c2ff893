"""Reading transfer tables in three layouts, case documents and gold corpora; writing artifacts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundweave.functions.hashing import content_hash
from fundweave.functions.scalars import missing_id, tick_to_time
from fundweave.operators.quality import public_projection
from fundweave.shared import staged, with_ordinal

#: Raw layouts: raw column -> canonical column.
LAYOUTS = {
    "transactions": {"transaction_id": "edge_id", "orig_id": "source_id", "dest_id": "target_id", "amount": "amount", "timestamp": "event_time"},
    "accounts": {"transaction_id": "edge_id", "source_account_id": "source_id", "target_account_id": "target_id", "amount": "amount", "transaction_time": "event_time"},
}
TICKS = ("sourceNodeId", "targetNodeId", "value", "time")


def _need(df: DataFrame, names) -> None:
    lacking = tuple(sorted(set(names) - set(df.columns)))
    if lacking:
        raise ValueError(f"missing source columns: {lacking}")


def adapt(df: DataFrame, layout: str) -> DataFrame:
    """A raw table of a named layout as canonical edges."""
    names = LAYOUTS[layout]
    _need(df, names)
    return df.select(*[F.col(raw).alias(name) for raw, name in names.items()])


def tick_violations(df: DataFrame) -> DataFrame:
    """One row with a count of each way in which rows with relative ticks are not fit to adapt."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf"))
    return df.agg(
        *[F.count_if(missing_id(F.col(c).cast("string"))).alias(f"bad_{c}") for c in TICKS[:2]],
        F.count_if(~finite | F.coalesce(value <= 0, F.lit(True))).alias("bad_value"),
        F.count_if(F.col("time").isNull() | (F.col("time") < 0)).alias("bad_time"),
    )


def adapt_ticks(df: DataFrame, *order: str, start: str, tick_seconds: float, prefix: str) -> DataFrame:
    """Raw edges with relative ticks: edge ids from the row ordinal, times from the tick.

    start has a time zone; ticks are of an integer type and not negative, values numeric,
    finite and positive, ids neither null nor blank. Anything else is an error.
    """
    _need(df, TICKS)
    if not tick_seconds > 0 or not prefix.strip():
        raise ValueError("a tick must last and the prefix must not be blank")
    if not re.search(r"(Z|[+-]\d\d:?\d\d)$", start):
        raise ValueError("the start must have a time zone")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not isinstance(kinds["value"], T.NumericType):
        raise ValueError("value must be numeric")
    if not isinstance(kinds["time"], T.IntegralType):
        raise ValueError("ticks must be of an integer type")
    # Written once: the rules, the sample of the ranges and the ranges each read the rows.
    df = staged(df, "ticks")
    if broken := sorted(k for k, n in tick_violations(df).first().asDict().items() if n):
        raise ValueError(f"tick rules broken: {broken}")
    begin = F.lit(start).cast("timestamp")
    return with_ordinal(df, *order).select(
        F.concat(F.lit(prefix), F.col("row_ordinal").cast("string")).alias("edge_id"),
        F.col("sourceNodeId").cast("string").alias("source_id"),
        F.col("targetNodeId").cast("string").alias("target_id"),
        F.col("value").cast("double").alias("amount"),
        tick_to_time(begin, F.col("time"), tick_seconds).alias("event_time"),
    )


def read_transfers(spark: SparkSession, path: str, layout: str, fmt: str = "parquet") -> DataFrame:
    """Canonical edges of a raw CSV or parquet table."""
    names = TICKS if layout == "ticks" else LAYOUTS[layout]
    if fmt == "csv":
        kinds = {"amount": "double", "value": "double", "time": "double", "timestamp": "timestamp", "transaction_time": "timestamp"}
        df = spark.read.option("header", True).csv(path)
        _need(df, names)
        df = df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
    else:
        df = spark.read.format(fmt).load(path)
    return df if layout == "ticks" else adapt(df, layout)


_CASE = (
    "caseId string, seedEntity string, createdAt timestamp,"
    "nodes array<struct<nodeId:string,entityType:string,riskScore:double,isSeed:boolean,isContext:boolean,accountHolderName:string,bankShortName:string,accountLast4:string,badge:string>>,"
    "edges array<struct<edgeId:string,source:string,target:string,flowAmount:double,currency:string,timestamp:timestamp,relationshipType:string,identityConfidence:double>>,"
    "evidence array<struct<evidenceId:string,category:string,sourceReference:string,polarity:string,snapshotTime:timestamp,generationMethodVersion:string,confidence:double,payloadSummary:string>>"
)


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _rows(df: DataFrame, column: str) -> DataFrame:
    items = df.select(F.col("caseId").alias("case_id"), F.posexplode(column).alias("position", "x")).select("case_id", "position", "x.*")
    return items.toDF(*[_snake(c) for c in items.columns])


def read_case_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases, nodes, edges and evidence of JSON documents, one a case."""
    docs = spark.read.schema(_CASE).option("multiLine", True).json(path)
    cases = docs.select(
        F.col("caseId").alias("case_id"), F.col("seedEntity").alias("seed_entity"), F.col("createdAt").alias("created_at"),
        F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["edgeId"]))).alias("trace_edge_ids"),
        F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["evidenceId"]))).alias("evidence_ids"),
    )
    return {"cases": cases} | {c: _rows(docs, c) for c in ("nodes", "edges", "evidence")}


_CORPUS = (
    "cases array<struct<caseId:string,name:string,scenarioType:string,mode:string,seedEntity:string,generatorSeed:bigint,"
    "evidenceIds:array<string>,traceEdgeIds:array<string>,expectedStatus:string,"
    "evidence:array<struct<evidenceId:string,category:string,polarity:string,confidence:double,payloadSummary:string>>,"
    "graphEdges:array<struct<edgeId:string,source:string,target:string,flowAmount:double,currency:string,timestamp:timestamp,relationshipType:string,identityConfidence:double>>,"
    "mockAiResponse:string>>"
)


def read_gold_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases, evidence and edges of a gold corpus, with the defaults of absent fields."""
    docs = spark.read.schema(_CORPUS).option("multiLine", True).json(path)
    cases = docs.select(F.explode("cases").alias("c")).select("c.*")
    evidence = _rows(cases, "evidence").fillna({"category": "OBSERVED", "polarity": "SUPPORTING", "confidence": 0.9})
    edges = _rows(cases, "graphEdges").fillna({"flow_amount": 1000.0, "relationship_type": "FUNDS_TRANSFER", "identity_confidence": 0.95})
    flat = cases.drop("evidence", "graphEdges")
    return {"cases": flat.toDF(*[_snake(c) for c in flat.columns]), "evidence": evidence, "edges": edges}


def write_public_artifact(df: DataFrame, path: str, *, source: str, parent_hash: str, adapter: str, params: tuple[str, ...] = ()) -> DataFrame:
    """Writes the public columns to a new place; returns its manifest, one row, written beside it.

    The manifest's hash is that of the rows, in any order, as part files differ from run to
    run. An existing place is never overwritten.
    """
    spark = df.sparkSession
    out = public_projection(df)
    out.write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path)
    manifest = content_hash(written).select(
        F.lit(source).alias("source"), F.lit(parent_hash).alias("parent_hash"), F.lit(adapter).alias("adapter"),
        F.array(*[F.lit(p) for p in params]).cast("array<string>").alias("params"),
        F.col("content_hash").alias("output_hash"), "row_count", F.array(*[F.lit(c) for c in out.columns]).alias("columns"),
    )
    manifest.write.mode("errorifexists").json(path.rstrip("/") + ".manifest")
    return spark.read.schema(manifest.schema).json(path.rstrip("/") + ".manifest")


def write_clean_artifact(
    df: DataFrame, path: str, report: DataFrame | str, *, source: str, parent_hash: str, adapter: str, params: tuple[str, ...] = ()
) -> DataFrame:
    """write_public_artifact() of accepted rows; the report's hash becomes a parameter.

    A report table (one row of quality_report() with its source and raw hash) must be of
    this source, raw table and number of rows; a string must be the hash of a report.
    """
    if isinstance(report, str):
        found = report
    else:
        r = report.first()
        if r.source_id != source:
            raise ValueError("the report is of another source")
        if r.raw_sha256 != parent_hash:
            raise ValueError("the report is of another raw table")
        if r.accepted_rows != df.count():
            raise ValueError("the report does not count the accepted rows")
        found = r.report_hash
    if not re.fullmatch("[0-9a-f]{64}", found):
        raise ValueError("the report hash must be 64 hex digits")
    return write_public_artifact(df, path, source=source, parent_hash=parent_hash, adapter=adapter, params=(*params, f"quality_report_sha256:{found}"))


def artifact_inventory(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, sha256 of the bytes of files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_run_artifact(spark: SparkSession, payload: dict, path: str) -> None:
    """A JSON record with sorted keys at a new place."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def run_violations(runs: DataFrame) -> DataFrame:
    """One row with a count of each way in which runs (run_id, git_sha, dataset_hash, split_hash, metric, value) are malformed."""
    hex64 = "^[0-9a-f]{64}$"
    bad = {"git_sha": ~F.col("git_sha").rlike("^[0-9a-f]{40}$"), "dataset_hash": ~F.col("dataset_hash").rlike(hex64), "split_hash": ~F.col("split_hash").rlike(hex64)}
    bad["value"] = F.isnan("value") | (F.abs("value") == float("inf"))
    each = runs.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(f"bad_{k}") for k, c in bad.items()])
    return each.agg(*[F.coalesce(F.sum(f"bad_{k}"), F.lit(0)).alias(f"bad_{k}") for k in bad], F.count_if(F.col("n") > 1).alias("repeated_metric"))


def run_ledger(runs: DataFrame, path: str, tolerance: float = 1e-6) -> DataFrame:
    """Appends runs, reads back what this call has written and returns it.

    Malformed tags, metrics that are not finite and a metric that stands twice in a run are
    errors, and nothing is written; so is a value or tag that does not read back.
    """
    if broken := sorted(k for k, n in run_violations(runs).first().asDict().items() if n):
        raise ValueError(f"run rules broken: {broken}")
    names, batch = ["run_id", "git_sha", "dataset_hash", "split_hash", "metric", "value"], uuid.uuid4().hex
    runs.select(*names).withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    back = runs.sparkSession.read.parquet(path).where(F.col("batch") == batch).drop("batch")
    read = back.select("run_id", "metric", F.struct(*names[1:4]).alias("tags_read"), F.col("value").alias("value_read"))
    both = runs.select("run_id", "metric", F.struct(*names[1:4]).alias("tags"), "value").join(read, ["run_id", "metric"], "full_outer")
    same = F.col("tags").eqNullSafe(F.col("tags_read")) & (F.abs(F.col("value") - F.col("value_read")) <= tolerance)
    if not both.where(~F.coalesce(same, F.lit(False))).isEmpty():
        raise ValueError("runs do not read back as written")
    return back
