"""Domain tables derived by Spark from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTOFF = "2024-01-20 00:00:00"
#: Events of a case and documents of an evidence case: the numbers of both kinds of cases grow with the tables.
CASE_EVENTS, CASE_DOCUMENTS = 500, 40
#: Lines of orders that one task sorts, joins and sums.
TASK_LINES = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transfers: user -> the account that props names."""
    e = read(spark, sf_dir, "events").where("value > 0")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("edge_id"),
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("target_id"),
        F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_id",
    )


EDGES = """edges AS (
    SELECT 'e' || event_id AS edge_id, 'A' || user_id AS source_id, 'A' || json_extract_string(props, '$.k') AS target_id,
           value AS amount, ts AS event_time, event_id
    FROM events WHERE value > 0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers customer -> supplier, an edge an order and supplier.

    Both tables are dealt by order to as many tasks as there are TASK_LINES lines: a
    shuffled byte becomes twenty in the sorts and the sums, so that partitions cut by their
    shuffled bytes take more memory the larger the table is.
    """
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    n = li.count() // TASK_LINES + 1
    o, li = o.repartition(n, "o_orderkey"), li.repartition(n, "l_orderkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    g = j.groupBy("l_orderkey", "l_suppkey", "o_custkey", "o_orderdate").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount")
    )
    return g.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("transaction_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("orig_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dest_id"),
        "amount",
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw rows with relative ticks and known faults."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    source = F.when(k % 97 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("A"), F.col("user_id").cast("string")))
    target = F.when(k % 89 == 0, F.lit(None)).otherwise(F.concat(F.lit("A"), F.get_json_object("props", "$.k")))
    value = F.when(k % 83 == 0, -F.col("value") - 1).when(k % 79 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    tick = F.when(k % 73 == 0, F.lit(-1.0)).when(k % 71 == 0, F.lit(1.5)).otherwise(F.col("event_id").cast("double"))
    return e.select(k, source.alias("sourceNodeId"), target.alias("targetNodeId"), value.alias("value"), tick.alias("time"))


RAW = """raw AS (
    SELECT event_id, CASE WHEN event_id % 97 = 0 THEN ' ' || chr(9) ELSE 'A' || user_id END AS sourceNodeId,
           CASE WHEN event_id % 89 = 0 THEN NULL ELSE 'A' || json_extract_string(props, '$.k') END AS targetNodeId,
           CASE WHEN event_id % 83 = 0 THEN -value - 1 WHEN event_id % 79 = 0 THEN 'nan'::DOUBLE ELSE value END AS value,
           CASE WHEN event_id % 73 = 0 THEN -1.0 WHEN event_id % 71 = 0 THEN 1.5 ELSE event_id::DOUBLE END AS time
    FROM events),
judged AS (
    SELECT *, CASE WHEN trim(coalesce(sourceNodeId, ''), ' ' || chr(9)) = '' OR trim(coalesce(targetNodeId, ''), ' ' || chr(9)) = ''
                        THEN 'missing_or_blank_identifier'
                   WHEN isnan(value) OR value <= 0 THEN 'non_positive_or_non_finite_amount'
                   WHEN time < 0 OR time <> floor(time) THEN 'negative_or_invalid_tick' END AS reason
    FROM raw)"""


def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, seed and edges: every edge, in the case of its time; the seed is the first edge's target."""
    e = edges(spark, sf_dir).withColumn("currency", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise("VND"))
    e = e.withColumn("event_time", F.when(F.col("event_id") % 19 != 0, F.col("event_time")))
    e = e.withColumn("case_id", F.concat(F.lit("case"), F.floor(F.col("event_id") / CASE_EVENTS).cast("string")))
    seed = F.min_by("target_id", "event_id").over(Window.partitionBy("case_id"))
    return e.select("case_id", seed.alias("seed"), "edge_id", "source_id", "target_id", "amount", "event_time", "currency")


CASES = f"""case_edges AS (
    SELECT 'case' || (event_id // {CASE_EVENTS}) AS case_id, arg_min(target_id, event_id) OVER (PARTITION BY event_id // {CASE_EVENTS}) AS seed,
           edge_id, source_id, target_id, amount,
           CASE WHEN event_id % 19 <> 0 THEN event_time END AS event_time, CASE WHEN event_id % 5 <> 0 THEN 'VND' END AS currency
    FROM edges),
hops0 AS (SELECT DISTINCT case_id, seed AS node, 0 AS d FROM case_edges),
both_ways AS (SELECT case_id, source_id AS a, target_id AS b FROM case_edges UNION SELECT case_id, target_id, source_id FROM case_edges),
hops1 AS (SELECT case_id, node, min(d) AS d FROM (SELECT * FROM hops0 UNION ALL
    SELECT w.case_id, w.b, h.d + 1 FROM hops0 h JOIN both_ways w ON w.case_id = h.case_id AND w.a = h.node) GROUP BY ALL),
hops2 AS (SELECT case_id, node, min(d) AS d FROM (SELECT * FROM hops1 UNION ALL
    SELECT w.case_id, w.b, h.d + 1 FROM hops1 h JOIN both_ways w ON w.case_id = h.case_id AND w.a = h.node) GROUP BY ALL),
hops3 AS (SELECT case_id, node, min(d) AS d FROM (SELECT * FROM hops2 UNION ALL
    SELECT w.case_id, w.b, h.d + 1 FROM hops2 h JOIN both_ways w ON w.case_id = h.case_id AND w.a = h.node) GROUP BY ALL),
hops4 AS (SELECT case_id, node, min(d) AS d FROM (SELECT * FROM hops3 UNION ALL
    SELECT w.case_id, w.b, h.d + 1 FROM hops3 h JOIN both_ways w ON w.case_id = h.case_id AND w.a = h.node) GROUP BY ALL)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence rows, CASE_DOCUMENTS a case."""
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    categories = F.array(*[F.lit(f"CATEGORY_{i}") for i in range(6)])
    polarities = F.array(*[F.lit(x) for x in ("SUPPORTING", "MITIGATING", "NEUTRAL", "CONTRADICTING")])
    return d.select(
        F.concat(F.lit("ev"), k.cast("string")).alias("evidence_id"),
        F.concat(F.lit("c"), F.floor(k / CASE_DOCUMENTS).cast("string")).alias("case_id"),
        F.get(categories, (k % 6).cast("int")).alias("category"),
        F.get(polarities, (k % 4).cast("int")).alias("polarity"),
        F.col("source").alias("source_ref"),
        F.col("n_chars").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload_hash"),
    )


EVIDENCE = f"""evidence AS (
    SELECT 'ev' || doc_id AS evidence_id, 'c' || (doc_id // {CASE_DOCUMENTS}) AS case_id, 'CATEGORY_' || (doc_id % 6) AS category,
           ['SUPPORTING', 'MITIGATING', 'NEUTRAL', 'CONTRADICTING'][1 + (doc_id % 4)::INTEGER] AS polarity,
           source AS source_ref, n_chars, sha256(coalesce(text, '')) AS payload_hash
    FROM documents)"""
