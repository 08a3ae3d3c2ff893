"""Queries over intake, quality, features and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundweave.functions import hashing, scalars
from fundweave.operators import features, quality
from fundweave.plans import tables as t
from fundweave.plans.tables import CUTOFF, EDGES, RAW
from fundweave.shared import shared_dir
from fundweave.sources import transfers


def _account_features(spark, d):
    return features.account_features(t.edges(spark, d), CUTOFF)


def _requested(spark, d):
    asked = t.read(spark, d, "customer").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("account_id"))
    return features.account_features(t.edges(spark, d), CUTOFF, asked)


def _canonical(spark, d):
    return transfers.adapt(t.lines(spark, d), "transactions")


def _read_back(spark, d):
    """Raw transfers written as a table of the second layout, and read as canonical edges."""
    path = shared_dir(spark, "raw")
    names = {"orig_id": "source_account_id", "dest_id": "target_account_id", "timestamp": "transaction_time"}
    t.lines(spark, d).withColumnsRenamed(names).write.parquet(path)
    return transfers.read_transfers(spark, path, "accounts")


def _graph_at(spark, d):
    return features.build_graph(t.edges(spark, d), CUTOFF).select("edge_id", "source_id", "target_id", "amount")


def _neighbours(spark, d):
    e = t.edges(spark, d)
    seeds = e.select(F.col("source_id").alias("account_id")).distinct()
    return features.neighbor_sample(e, seeds, (5, 3))


def _artifact(spark, d):
    """The manifest of the accepted ticks as a public artifact, with its report."""
    raw = t.raw_ticks(spark, d)
    edges, report = _ticks(spark, d), quality.quality_report(raw.drop("event_id"), source_id="events", raw_sha256="0" * 64)
    m = transfers.write_clean_artifact(edges, shared_dir(spark, "artifact"), report, source="events", parent_hash="0" * 64, adapter="ticks")
    return m.select("source", "parent_hash", "adapter", "row_count", F.array_join("columns", ",").alias("columns"), F.size("params").alias("n_params"), F.length("output_hash").alias("hash_length"))


def _ledger(spark, d):
    """A metric of each supplier as a run, appended and read back."""
    s = t.read(spark, d, "supplier")
    sha = lambda x: F.sha2(F.concat(F.lit(x), F.col("s_suppkey").cast("string")), 256)
    runs = s.select(
        F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("run_id"), F.substring(sha("g"), 1, 40).alias("git_sha"), sha("d").alias("dataset_hash"),
        sha("s").alias("split_hash"), F.explode(F.array(F.lit("ap"), F.lit("brier"))).alias("metric"), (F.col("s_suppkey") / 7).alias("value"),
    )
    return transfers.run_ledger(runs, shared_dir(spark, "ledger")).withColumn("value", F.round("value", 9))


def _public(spark, d):
    return quality.public_projection(t.edges(spark, d).withColumn("label", F.col("event_id") % 2))


def _ticks(spark, d):
    good, _ = quality.clean_transfers(t.raw_ticks(spark, d))
    good = good.withColumn("time", F.col("time").cast("long"))
    return transfers.adapt_ticks(good, "event_id", start="2024-01-01T00:00:00Z", tick_seconds=0.5, prefix="t-")


def _accepted(spark, d):
    return quality.clean_transfers(t.raw_ticks(spark, d))[0]


def _quarantine(spark, d):
    bad = quality.clean_transfers(t.raw_ticks(spark, d), "event_id")[1]
    return bad.select("row_ordinal", "event_id", "sourceNodeId", "targetNodeId", "reason_code")


def _report(spark, d):
    raw = t.raw_ticks(spark, d).select("sourceNodeId", "targetNodeId", F.floor(F.nanvl("value", F.lit(-1.0)) / 50).cast("double").alias("value"), F.lit(1.0).alias("time"))
    return quality.quality_report(raw).drop("report_hash")


def _duplicates(spark, d):
    li = t.read(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    return quality.duplicate_profile(li)


def _violations(spark, d):
    raw = t.raw_ticks(spark, d)
    e = raw.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("edge_id"), F.col("sourceNodeId").alias("source_id"),
        F.col("targetNodeId").alias("target_id"), F.col("value").alias("amount"),
        F.when(F.col("time") >= 0, F.lit(CUTOFF).cast("timestamp")).alias("event_time"),
    )
    return quality.canonical_violations(e)


def _event_violations(spark, d):
    raw = t.raw_ticks(spark, d)
    e = raw.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("edge_id"), F.col("sourceNodeId").alias("source_id"),
        F.col("targetNodeId").alias("target_id"), F.col("value").alias("amount"),
        F.when(F.col("time") >= 0, F.lit(CUTOFF).cast("timestamp")).alias("event_time"),
    )
    return quality.event_violations(e).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def _trace_edge_checks(spark, d):
    p = t.read(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.floor("p_retailprice")).otherwise(F.col("p_retailprice") - 1000).alias("flow_amount"),
        F.when(F.col("p_size") < 20, "VND").when(F.col("p_size") < 40, "usd").alias("currency"), (F.col("p_size") / 40).alias("confidence"),
    )
    return quality.trace_edge_violations(p).select("p_partkey", "violation")


def _trace_node_checks(spark, d):
    c = t.read(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 9000).alias("risk_score"), F.substring("c_name", -4, 4).alias("account_last4"),
        F.col("c_mktsegment").alias("badge"),
    )
    return quality.trace_node_violations(c, ("BUILDING", "MACHINERY", "HOUSEHOLD")).select("c_custkey", "violation")


def _manifest_checks(spark, d):
    p = t.read(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 7 == 0, "short").otherwise(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("sha256"), "url",
        F.when(F.col("page_id") % 11 == 0, " ").otherwise("page").alias("name"), (F.col("page_id") % 60).alias("trial_cap"),
        (F.col("page_id") % 13).alias("budget"),
    )
    return quality.manifest_violations(p).select("page_id", "violation")


def _admission(spark, d):
    s = t.read(spark, d, "part").select(
        "p_partkey", (F.col("p_partkey") * 1000).alias("archive_bytes"), (F.col("p_size").cast("long") * 50000).alias("extraction_bytes"),
        F.lit(1000).cast("long").alias("processed_bytes"), (F.col("p_partkey") % 5 - F.when(F.col("p_partkey") % 97 == 0, 9).otherwise(0)).alias("temp_bytes"),
        F.lit(100).cast("long").alias("headroom_bytes"), F.lit(2_000_000).cast("long").alias("free_bytes"),
    )
    return quality.admission(s).select("p_partkey", "required_bytes", "verdict")


def _labels(spark, d):
    lab = t.read(spark, d, "labels").select(
        F.col("doc_id").alias("nodeid"), F.when(F.col("doc_id") % 31 == 0, 0.5).otherwise(F.col("toxic").cast("double")).alias("isFraud"),
        (F.col("doc_id") % 7).alias("fraudStep"),
    )
    return quality.account_labels(lab)


def _duplicate_edges(spark, d):
    li = t.read(spark, d, "lineitem")
    return features.duplicate_edges(li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id")))


def _monotonic(spark, d):
    e = t.edges(spark, d)
    late = e.withColumn("event_time", F.when(F.col("event_id") % 53 == 0, F.col("event_time") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("event_time")))
    late = late.withColumn("stream", F.col("event_id") % 8)
    return features.monotonic_violations(late, "event_id", "stream").select("edge_id", "event_time")


def _groups(spark, d):
    g = features.neighbor_edge_groups(t.edges(spark, d))
    money = F.transform("amounts", lambda x: F.format_string("%.2f", x))
    return g.select("account_id", "direction", "neighbor_id", F.array_join(money, ",").alias("amounts"), F.col("ordinal").cast("long").alias("ordinal"))


def _neighborhood(spark, d):
    e = features.at_or_before(t.edges(spark, d), CUTOFF)
    f = features.account_features(e).select("account_id", F.col("amount_in").alias("amount"))
    return features.neighborhood_features(e, f, ["amount"]).select(
        "account_id", "amount", F.round("amount_mean1", 4).alias("amount_mean1"), F.round("amount_mean2", 3).alias("amount_mean2")
    )


def _formats(spark, d):
    e = t.edges(spark, d)
    vnd = F.round(F.col("amount") * 100).cast("long") * 12345 - 1000
    currency = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, "VND").otherwise("USD")
    amount = F.when(currency == "VND", vnd).otherwise(F.round(F.col("amount") * 100).cast("long"))
    at = F.when(F.col("event_id") % 10 != 0, F.col("event_time"))
    return e.select(
        "edge_id", scalars.format_vnd_millions(vnd).alias("vnd_text"), scalars.format_transaction(amount, currency, at).alias("label"),
        scalars.amount_band(vnd, currency, high=60_000_000, middle=20_000_000).alias("band"),
        scalars.cost_vnd(F.col("event_id"), F.length("source_id")).alias("cost"),
        scalars.url_component(F.concat_ws("|", F.lit("cluster:é (x)"), "source_id", "target_id")).alias("component"),
        scalars.utc_seconds(F.col("event_time")).alias("utc"), scalars.month_key(F.col("event_time")).alias("month"),
    )


def _snapshots(spark, d):
    ev = t.evidence(spark, d)
    cases = ev.groupBy("case_id").agg(F.collect_list("evidence_id").alias("ids"), F.sum("n_chars").alias("size"))
    cases = cases.select("case_id", scalars.sorted_unique(F.col("ids")).alias("evidence_ids"), "size")
    return cases.select("case_id", hashing.integrity_hash(cases, ["case_id", "evidence_ids", "size"]).alias("snapshot_hash"))


QUERIES = {
    "account_features": _account_features,
    "account_features_requested": _requested,
    "canonical_edges": _canonical,
    "public_projection": _public,
    "read_transfers": _read_back,
    "graph_at_cutoff": _graph_at,
    "neighbor_sample": _neighbours,
    "clean_artifact": _artifact,
    "run_ledger": _ledger,
    "tick_adapter": _ticks,
    "clean_accepted": _accepted,
    "clean_quarantine": _quarantine,
    "quality_report": _report,
    "duplicate_profile": _duplicates,
    "canonical_violations": _violations,
    "event_violations": _event_violations,
    "trace_edge_checks": _trace_edge_checks,
    "trace_node_checks": _trace_node_checks,
    "manifest_checks": _manifest_checks,
    "source_admission": _admission,
    "account_labels": _labels,
    "duplicate_edges": _duplicate_edges,
    "monotonic_violations": _monotonic,
    "neighbor_edge_groups": _groups,
    "neighborhood_features": _neighborhood,
    "transfer_formats": _formats,
    "snapshot_hash": _snapshots,
}

_FEATURES = f"""{EDGES},
ends AS (
    SELECT source_id AS account_id, 0 AS i, 1 AS o, 0::DECIMAL(18,2) AS ai, amount::DECIMAL(18,2) AS ao FROM edges WHERE event_time <= TIMESTAMP '{CUTOFF}'
    UNION ALL SELECT target_id, 1, 0, amount::DECIMAL(18,2), 0 FROM edges WHERE event_time <= TIMESTAMP '{CUTOFF}'),
f AS (SELECT account_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(ai)::DOUBLE AS amount_in, sum(ao)::DOUBLE AS amount_out
      FROM ends GROUP BY account_id)"""
_RATIO = "CASE WHEN {i} = 0 THEN 0.0::DOUBLE ELSE least({o} / {i}, 1.0) END AS pass_through_ratio"

ORACLE_SQL = {
    "account_features": f"WITH {_FEATURES} SELECT *, {_RATIO.format(i='amount_in', o='amount_out')} FROM f",
    "account_features_requested": f"""WITH {_FEATURES},
        a AS (SELECT 'A' || c_custkey AS account_id FROM customer),
        j AS (SELECT a.account_id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
                     coalesce(amount_in, 0) AS amount_in, coalesce(amount_out, 0) AS amount_out FROM a LEFT JOIN f USING (account_id))
        SELECT *, {_RATIO.format(i='amount_in', o='amount_out')} FROM j""",
    "canonical_edges": """
        SELECT 'o' || l_orderkey || '-' || l_suppkey AS edge_id, 'C' || o_custkey AS source_id, 'S' || l_suppkey AS target_id,
               sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, o_orderdate AS event_time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderdate""",
    "read_transfers": """
        SELECT 'o' || l_orderkey || '-' || l_suppkey AS edge_id, 'C' || o_custkey AS source_id, 'S' || l_suppkey AS target_id,
               sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, o_orderdate AS event_time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderdate""",
    "graph_at_cutoff": f"WITH {EDGES} SELECT edge_id, source_id, target_id, amount FROM edges WHERE event_time <= TIMESTAMP '{CUTOFF}'",
    "neighbor_sample": f"""WITH {EDGES},
        b AS (SELECT source_id AS node_id, target_id AS neighbor_id, edge_id FROM edges UNION ALL SELECT target_id, source_id, edge_id FROM edges),
        p AS (SELECT node_id, neighbor_id, min(edge_id) AS edge_id FROM b GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY edge_id, neighbor_id) AS rk FROM p),
        one AS (SELECT s.source_id AS seed_id, 1 AS hop, node_id, neighbor_id FROM (SELECT DISTINCT source_id FROM edges) s JOIN r ON r.node_id = s.source_id WHERE rk <= 5)
        SELECT * FROM one UNION ALL SELECT o.seed_id, 2, r.node_id, r.neighbor_id FROM (SELECT DISTINCT seed_id, neighbor_id FROM one) o JOIN r ON r.node_id = o.neighbor_id WHERE rk <= 3""",
    "clean_artifact": f"""WITH {RAW}
        SELECT 'events' AS source, repeat('0', 64) AS parent_hash, 'ticks' AS adapter, count(*) AS row_count, 'edge_id,source_id,target_id,amount,event_time' AS columns,
               1 AS n_params, 64 AS hash_length FROM judged WHERE reason IS NULL""",
    "run_ledger": """
        SELECT 'run' || s_suppkey AS run_id, substr(sha256('g' || s_suppkey), 1, 40) AS git_sha, sha256('d' || s_suppkey) AS dataset_hash,
               sha256('s' || s_suppkey) AS split_hash, metric, round(s_suppkey / 7, 9) AS value FROM supplier, (SELECT unnest(['ap', 'brier']) AS metric) m""",
    "public_projection": f"WITH {EDGES} SELECT edge_id, source_id, target_id, amount, event_time FROM edges",
    "tick_adapter": f"""WITH {RAW}
        SELECT 't-' || (row_number() OVER (ORDER BY event_id) - 1) AS edge_id, sourceNodeId AS source_id, targetNodeId AS target_id,
               value AS amount, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(time::BIGINT * 500000) AS event_time
        FROM judged WHERE reason IS NULL""",
    "clean_accepted": f"WITH {RAW} SELECT event_id, sourceNodeId, targetNodeId, value, time FROM judged WHERE reason IS NULL",
    "clean_quarantine": f"""WITH {RAW}, n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_ordinal FROM judged)
        SELECT row_ordinal, event_id, sourceNodeId, targetNodeId, reason AS reason_code FROM n WHERE reason IS NOT NULL""",
    "quality_report": f"""WITH {RAW},
        r AS (SELECT sourceNodeId AS s, targetNodeId AS t, floor(CASE WHEN isnan(value) THEN -1.0 ELSE value END / 50) AS v FROM raw),
        j AS (SELECT *, CASE WHEN trim(coalesce(s, ''), ' ' || chr(9)) = '' OR coalesce(t, '') = '' THEN 1 WHEN v <= 0 THEN 2 END AS reason FROM r)
        SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS accepted_rows, count(*) FILTER (reason IS NOT NULL) AS rejected_rows,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT s, t, v FROM r)) AS duplicate_rows,
               count(*) FILTER (reason = 1) AS n_missing_or_blank_identifier, count(*) FILTER (reason = 2) AS n_non_positive_or_non_finite_amount,
               0::BIGINT AS n_negative_or_invalid_tick, sha256('sourceNodeId,targetNodeId,value,time') AS schema_hash
        FROM j""",
    "duplicate_profile": """
        WITH r AS (SELECT l_suppkey, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT sum(n)::BIGINT AS n_rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows FROM r""",
    "canonical_violations": f"""WITH {RAW}
        SELECT 0::BIGINT AS bad_edge_id, count(*) FILTER (trim(coalesce(sourceNodeId, ''), ' ' || chr(9)) = '') AS bad_source_id,
               count(*) FILTER (targetNodeId IS NULL) AS bad_target_id, count(*) FILTER (isnan(value)) AS bad_amount,
               count(*) FILTER (time < 0) AS bad_event_time FROM raw""",
    "event_violations": f"""WITH {RAW}
        SELECT CASE WHEN trim(coalesce(sourceNodeId, ''), ' ' || chr(9)) = '' OR targetNodeId IS NULL THEN 'BLANK_ID'
                    WHEN isnan(value) OR value <= 0 THEN 'BAD_AMOUNT' WHEN time < 0 THEN 'NO_TIME' END AS violation, count(*) AS n
        FROM raw GROUP BY 1""",
    "trace_edge_checks": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice) ELSE p_retailprice - 1000 END AS a,
                          CASE WHEN p_size < 20 THEN 'VND' WHEN p_size < 40 THEN 'usd' END AS c, p_size / 40 AS f FROM part)
        SELECT p_partkey, CASE WHEN a < 0 THEN 'BAD_AMOUNT' WHEN c = 'usd' THEN 'BAD_CURRENCY'
                               WHEN c = 'VND' AND floor(a) <> a THEN 'BAD_VND' WHEN f > 1 THEN 'BAD_CONFIDENCE' END AS violation FROM p""",
    "trace_node_checks": """
        SELECT c_custkey, CASE WHEN NOT (c_acctbal / 9000 BETWEEN 0 AND 1) THEN 'BAD_RISK'
                               WHEN NOT regexp_full_match(right(c_name, 4), '[0-9]{4}') THEN 'BAD_LAST4'
                               WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'BAD_BADGE' END AS violation
        FROM customer""",
    "manifest_checks": r"""
        SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'BAD_HASH' WHEN NOT regexp_full_match(url, 'https://\S+') THEN 'BAD_URL'
                             WHEN page_id % 11 = 0 THEN 'BLANK_NAME' WHEN NOT (page_id % 60 BETWEEN 1 AND 50) THEN 'BAD_TRIAL_CAP'
                             WHEN page_id % 13 = 0 THEN 'BAD_BUDGET' END AS violation FROM pages""",
    "source_admission": """
        WITH s AS (SELECT p_partkey, p_partkey % 5 - CASE WHEN p_partkey % 97 = 0 THEN 9 ELSE 0 END AS temp,
                          p_partkey * 1000 + p_size::BIGINT * 50000 + 1100 AS rest FROM part)
        SELECT p_partkey, rest + temp AS required_bytes,
               CASE WHEN temp < 0 THEN 'INVALID' WHEN 2000000 >= rest + temp THEN 'READY' ELSE 'SKIPPED_BY_RESOURCE' END AS verdict FROM s""",
    "account_labels": """
        SELECT doc_id::VARCHAR AS account_id, CASE WHEN doc_id % 31 <> 0 THEN toxic END AS is_fraud, (doc_id % 7)::VARCHAR AS label_provenance
        FROM labels""",
    "duplicate_edges": "SELECT l_orderkey || '-' || l_linenumber AS edge_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "monotonic_violations": f"""WITH {EDGES},
        l AS (SELECT edge_id, event_id, CASE WHEN event_id % 53 = 0 THEN event_time - INTERVAL 1 DAY ELSE event_time END AS event_time FROM edges),
        w AS (SELECT *, lag(event_time) OVER o AS bt, lag(edge_id) OVER o AS bi FROM l WINDOW o AS (PARTITION BY event_id % 8 ORDER BY event_id))
        SELECT edge_id, event_time FROM w WHERE bt > event_time OR (bt = event_time AND bi >= edge_id)""",
    "neighbor_edge_groups": f"""WITH {EDGES},
        e AS (SELECT source_id AS account_id, 'out' AS direction, target_id AS neighbor_id, amount, event_time, edge_id FROM edges
              UNION ALL SELECT target_id, 'in', source_id, amount, event_time, edge_id FROM edges),
        g AS (SELECT account_id, direction, neighbor_id, string_agg(printf('%.2f', amount), ',' ORDER BY event_time, edge_id) AS amounts,
                     min(ROW(event_time, edge_id)) AS f FROM e GROUP BY ALL)
        SELECT account_id, direction, neighbor_id, amounts, row_number() OVER (PARTITION BY account_id, direction ORDER BY f) - 1 AS ordinal FROM g""",
    "neighborhood_features": f"""WITH {_FEATURES},
        b AS (SELECT source_id AS a, target_id AS n, edge_id FROM edges WHERE event_time <= TIMESTAMP '{CUTOFF}'
              UNION ALL SELECT target_id, source_id, edge_id FROM edges WHERE event_time <= TIMESTAMP '{CUTOFF}'),
        p AS (SELECT a, n, min(edge_id) AS edge_id FROM b GROUP BY a, n),
        r AS (SELECT a, n FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY edge_id, n) <= 15),
        m1 AS (SELECT r.a, sum(f.amount_in::DECIMAL(28,6))::DOUBLE / count(*) AS m FROM r JOIN f ON f.account_id = r.n GROUP BY r.a),
        m2 AS (SELECT r.a, sum(m1.m::DECIMAL(28,6))::DOUBLE / count(*) AS m FROM r JOIN m1 ON m1.a = r.n GROUP BY r.a)
        SELECT f.account_id, f.amount_in AS amount, round(coalesce(m1.m, 0), 4) AS amount_mean1, round(coalesce(m2.m, 0), 3) AS amount_mean2
        FROM f LEFT JOIN m1 ON m1.a = f.account_id LEFT JOIN m2 ON m2.a = f.account_id""",
    "transfer_formats": f"""WITH {EDGES},
        v AS (SELECT *, round(amount * 100)::BIGINT AS cents FROM edges),
        a AS (SELECT *, cents * 12345 - 1000 AS vnd, CASE event_id % 3 WHEN 1 THEN 'VND' WHEN 2 THEN 'USD' END AS currency FROM v),
        b AS (SELECT *, CASE WHEN vnd < 0 THEN '-' ELSE '' END || (abs(vnd) // 1000000) || '.' ||
                     CASE WHEN abs(vnd) % 1000000 = 0 THEN '0' ELSE rtrim(lpad((abs(vnd) % 1000000)::VARCHAR, 6, '0'), '0') END || ' tr' AS vnd_text FROM a)
        SELECT edge_id, vnd_text,
               CASE WHEN currency = 'VND' THEN vnd_text WHEN currency IS NULL THEN cents || '.00 (unknown currency)' ELSE cents || '.00 USD' END || ' (' ||
               CASE WHEN event_id % 10 <> 0 THEN strftime(event_time + INTERVAL 7 HOUR, '%H:%M') ELSE 'unknown time' END || ')' AS label,
               CASE WHEN currency = 'VND' AND vnd >= 60000000 THEN 4.5 WHEN currency = 'VND' AND vnd >= 20000000 THEN 3.0 ELSE 1.8 END::DOUBLE AS band,
               (event_id * 7 + length(source_id) * 28 + 1999) // 2000 AS cost,
               'cluster%3A%C3%A9%20(x)%7C' || source_id || '%7C' || target_id AS component,
               strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(event_time, '%Y-%m') AS month
        FROM b""",
    "snapshot_hash": f"""WITH {t.EVIDENCE},
        c AS (SELECT case_id, string_agg(DISTINCT '"' || evidence_id || '"', ',' ORDER BY '"' || evidence_id || '"') AS ids, sum(n_chars) AS size
              FROM evidence GROUP BY case_id)
        SELECT case_id, sha256('{{"case_id":"' || case_id || '","evidence_ids":[' || ids || '],"size":' || size || '}}') AS snapshot_hash FROM c""",
}
