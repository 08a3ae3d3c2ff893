"""Queries over evidence, claims and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundweave.functions import hashing
from fundweave.functions.scalars import cost_vnd
from fundweave.operators import claims, evidence, release
from fundweave.plans import tables as t
from fundweave.plans.tables import CASES, EDGES, EVIDENCE
from fundweave.shared import staged


def _put(spark, d):
    ev = t.evidence(spark, d)
    k = F.substring("evidence_id", 3, 20).cast("long")
    batch = ev.where(k % 2 == 0).select("evidence_id", "payload_hash")
    again = ev.where(k % 10 == 0).select("evidence_id", F.when(k % 20 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("payload_hash")).alias("payload_hash"))
    current = ev.where(k % 3 == 0).select("evidence_id", F.when(k % 9 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("payload_hash")).alias("payload_hash"))
    return evidence.put_status(batch.unionByName(again), current, "evidence_id", "payload_hash").select("evidence_id", "payload_hash", "status")


def _gaps(spark, d):
    ev, docs, lab = t.evidence(spark, d), t.read(spark, d, "documents"), t.read(spark, d, "labels")
    c = t.case_edges(spark, d)
    known = t.edges(spark, d).select("source_id")
    return evidence.referential_gaps(
        document_without_label=(docs, "doc_id", lab, "doc_id"), target_never_sends=(c, "target_id", known, "source_id"),
        evidence_of_no_case=(ev, "case_id", ev.where("n_chars > 2000"), "case_id"),
    )


def _resolve(spark, d):
    c = t.case_edges(spark, d)
    cases = c.groupBy("case_id").agg(F.collect_set("edge_id").alias("trace_edge_ids"))
    e = t.edges(spark, d)
    nodes = e.where("amount > 150").select(F.col("source_id").alias("node_id")).distinct()
    return evidence.resolve_cases(cases, e.where("event_id % 23 <> 0"), nodes)[1]


def _get_many(spark, d):
    ev = t.evidence(spark, d)
    r = t.read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.transform(F.array(F.lit(7), F.lit(1), F.lit(400)), lambda p: F.concat(F.lit("ev"), (F.col("s_suppkey") * p).cast("string"))).alias("ids"),
    )
    return evidence.get_many(r, ev.select("evidence_id", "category"), "evidence_id").select("request_id", "position", "evidence_id", "category", "found")


def _by_polarity(spark, d):
    return evidence.evidence_by_polarity(t.evidence(spark, d), "SUPPORTING", 3)


def _pinned(ev):
    return ev.where(F.substring("evidence_id", 3, 20).cast("long") % 11 == 0).select("case_id", "evidence_id")


def _prompt(spark, d):
    ev = t.evidence(spark, d)
    return evidence.prompt_evidence(ev, _pinned(ev), 4)


def _summary(spark, d):
    ev = t.evidence(spark, d)
    cases = ev.groupBy("case_id").agg(F.collect_set("evidence_id").alias("evidence_ids"), F.collect_set(F.when(F.col("n_chars") > 500, F.col("source_ref"))).alias("trace_edge_ids"))
    return evidence.case_summary(cases)


def _commands(spark, d):
    c = t.case_edges(spark, d)
    # Every edge is also named, wrongly, in the case after its own.
    after = F.concat(F.lit("case"), (F.floor(F.col("event_id") / t.CASE_EVENTS) + 1).cast("string"))
    foreign = t.edges(spark, d).select(after.alias("case_id"), "edge_id", (F.col("event_id") + 1_000_000).alias("seq"), F.lit(True).alias("is_pinned"), F.lit("LAYERING").alias("tag"))
    own = c.withColumn("k", F.substring("edge_id", 2, 20).cast("long"))
    n = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    own = own.select("case_id", "edge_id", "k", n).select(
        "case_id", "edge_id", (F.col("k") + F.col("n") * 100000).alias("seq"), ((F.col("k") + F.col("n")) % 3 != 0).alias("is_pinned"),
        F.when((F.col("k") + F.col("n")) % 2 == 0, "FAN_IN").otherwise("LAYERING").alias("tag"),
    )
    return own.unionByName(foreign)


def _latest_pins(spark, d):
    return evidence.latest_pins(_commands(spark, d))


def _pin_cases(spark, d):
    c = t.case_edges(spark, d)
    return evidence.pin_cases(c.groupBy("case_id", F.col("seed").alias("seed_entity")).agg(
        F.min("event_time").alias("created_at"), F.collect_set("edge_id").alias("trace_edge_ids"), F.array().cast("array<string>").alias("evidence_ids")
    ))


def _pin_commands(spark, d, known):
    """Commands of which some expect the first snapshot of their known case, which the first effective one replaces."""
    first = known.select("case_id", "snapshot_hash")
    c = _commands(spark, d).join(first, "case_id", "left")
    return c.withColumn("expected_hash", F.when(F.col("seq") % 13 == 0, F.col("snapshot_hash"))).drop("snapshot_hash")


def _pin_log(spark, d):
    known = staged(_pin_cases(spark, d), "pin-cases")
    return evidence.pin_log(_pin_commands(spark, d, known), known)


def _pin_evidence(spark, d):
    return evidence.pin_evidence(_pin_log(spark, d))


def _runs(spark, d):
    ev = t.evidence(spark, d)
    per = ev.groupBy("case_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("ids"))
    docs = t.read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("c"), F.floor(F.col("doc_id") / t.CASE_DOCUMENTS).cast("string")).alias("case_id"))
    r = docs.join(per, "case_id")
    good, foreign = F.get("ids", F.lit(0)), F.lit("ev-foreign")
    cited = F.when(F.col("k") % 7 == 0, F.array(good, foreign)).when(F.col("k") % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(good))
    body = F.to_json(F.struct(F.lit("s").alias("summary"), F.array(F.struct(F.lit("t").alias("text"), cited.alias("cited_evidence_ids")), F.struct(F.lit("u").alias("text"), F.array(good).alias("cited_evidence_ids"))).alias("claims")))
    none = F.lit('{"summary":"s","claims":[]}')
    answer = F.when(F.col("k") % 11 == 0, "{broken").when(F.col("k") % 11 == 1, '{"summary":"s"}').when(F.col("k") % 11 == 2, none).otherwise(body)
    return r.select(
        F.col("k").alias("run_id"), "case_id", (F.col("k") % 13 != 0).alias("provider_on"), F.when(F.col("k") % 17 == 0, "TIMEOUT").otherwise("OK").alias("transport"),
        answer.alias("answer"), F.when(F.col("k") % 19 == 0, F.array().cast("array<string>")).otherwise(F.col("ids")).alias("evidence_ids"),
    )


def _claim_status(spark, d):
    return claims.claim_status(_runs(spark, d)).select("run_id", "status", "n_claims")


def _claim_metrics(spark, d):
    m = claims.claim_metrics(claims.claim_status(_runs(spark, d)))
    return m.select(*[F.round(c, 9).alias(c) if c != "unsupported_claims" else F.col(c) for c in m.columns])


def _latency(spark, d):
    return claims.nearest_rank(t.read(spark, d, "events"), "value", 0.0, 0.5, 0.95, 0.99, by=("event_type",))


def _attempts(spark, d):
    e = t.read(spark, d, "events")
    k = F.col("event_id")
    status = F.get(F.array(*[F.lit(s) for s in ("RECONCILED", "RESERVED", "DISPATCHED", "RELEASED")]), (k % 4).cast("int"))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("case_id"), F.date_format("ts", "yyyy-MM-dd").alias("month_key"), status.alias("status"),
        (k % 900).alias("reserved_in"), (k % 90).alias("reserved_out"), cost_vnd(k % 900, k % 90).alias("reserved_cost"),
        (k % 800).alias("actual_in"), (k % 80).alias("actual_out"), cost_vnd(k % 800, k % 80).alias("actual_cost"),
    )


def _usage_case(spark, d):
    return claims.usage_by_case(_attempts(spark, d))


def _usage_month(spark, d):
    return claims.usage_by_month(_attempts(spark, d))


def _release(spark, d):
    s = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("release_id"))
    names = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("release_id") % 2 == 0, 5).otherwise(8))))
    row = lambda df, extra: df.select("release_id", F.concat(F.lit("file"), F.col("i").cast("string")).alias("name"), F.sha2(F.concat_ws(":", F.col("release_id").cast("string"), F.col("i").cast("string"), extra), 256).alias("sha256"))
    expected = row(names, F.lit(""))
    actual = row(names.where("not (release_id % 10 = 3 and i = 2)"), F.when((F.col("release_id") % 10 == 4) & (F.col("i") == 1), "x").otherwise(""))
    rel = s.select(
        "release_id", (F.col("release_id") % 7 == 0).alias("drifted"), (F.col("release_id") % 11 != 0).alias("tests_passed"),
        F.lit("a").alias("git_sha"), F.when(F.col("release_id") % 13 == 0, "b").otherwise("a").alias("built_sha"),
    )
    return release.release_status(rel, expected, actual)


def _content(spark, d):
    """The hash of all order lines, dealt in two ways."""
    n = t.read(spark, d, "lineitem")
    h = hashing.content_hash(n.repartition("l_partkey"))
    same = hashing.content_hash(n.repartitionByRange("l_shipdate")).withColumnRenamed("content_hash", "other").drop("row_count")
    changed = hashing.content_hash(n.withColumn("l_quantity", F.col("l_quantity") + (F.col("l_orderkey") == 1).cast("int"))).select(F.col("content_hash").alias("changed"))
    return h.crossJoin(same).crossJoin(changed).select("row_count", (F.col("content_hash") == F.col("other")).alias("order_free"), (F.col("content_hash") != F.col("changed")).alias("sees_changes"))  # a row each


QUERIES = {
    "evidence_put": _put,
    "referential_gaps": _gaps,
    "resolve_gaps": _resolve,
    "get_many": _get_many,
    "evidence_by_polarity": _by_polarity,
    "prompt_evidence": _prompt,
    "case_summary": _summary,
    "latest_pins": _latest_pins,
    "pin_log": _pin_log,
    "pin_evidence": _pin_evidence,
    "claim_status": _claim_status,
    "claim_metrics": _claim_metrics,
    "latency_percentiles": _latency,
    "usage_by_case": _usage_case,
    "usage_by_month": _usage_month,
    "release_status": _release,
    "content_hash": _content,
}

_RUNS = """r AS (SELECT doc_id AS k FROM documents),
st AS (SELECT k AS run_id, CASE WHEN k % 19 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 13 = 0 OR k % 17 = 0 THEN 'AI_UNAVAILABLE'
              WHEN k % 11 IN (0, 1) THEN 'AI_INVALID_OUTPUT' WHEN k % 11 = 2 THEN 'HYPOTHESIS_GENERATED'
              WHEN k % 7 IN (0, 1) THEN 'AI_INVALID_OUTPUT' ELSE 'HYPOTHESIS_GENERATED' END AS status, k % 11 > 2 AS full_answer FROM r)"""

ORACLE_SQL = {
    "evidence_put": f"""WITH {EVIDENCE},
        e AS (SELECT evidence_id, substr(evidence_id, 3)::BIGINT AS k, payload_hash AS h FROM evidence),
        b AS (SELECT evidence_id, h FROM e WHERE k % 2 = 0 UNION ALL SELECT evidence_id, CASE WHEN k % 20 = 0 THEN sha256('other') ELSE h END FROM e WHERE k % 10 = 0),
        c AS (SELECT evidence_id, CASE WHEN k % 9 = 0 THEN sha256('old') ELSE h END AS have FROM e WHERE k % 3 = 0),
        x AS (SELECT evidence_id, min(h) <> max(h) AS clash FROM b GROUP BY evidence_id)
        SELECT evidence_id, h AS payload_hash, CASE WHEN clash THEN 'CONFLICT' WHEN have IS NULL THEN 'INSERT' WHEN have = h THEN 'NOOP' ELSE 'CONFLICT' END AS status
        FROM b JOIN x USING (evidence_id) LEFT JOIN c USING (evidence_id)""",
    "referential_gaps": f"""WITH {EDGES}, {CASES}, {EVIDENCE}
        SELECT DISTINCT 'document_without_label' AS rule, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT DISTINCT 'target_never_sends', target_id FROM case_edges WHERE target_id NOT IN (SELECT source_id FROM edges)
        UNION ALL SELECT DISTINCT 'evidence_of_no_case', case_id FROM evidence WHERE case_id NOT IN (SELECT case_id FROM evidence WHERE n_chars > 2000)""",
    "resolve_gaps": f"""WITH {EDGES}, {CASES},
        i AS (SELECT DISTINCT case_id, edge_id, source_id, target_id FROM case_edges),
        n AS (SELECT DISTINCT source_id AS node FROM edges WHERE amount > 150),
        f AS (SELECT * FROM i WHERE substr(edge_id, 2)::BIGINT % 23 <> 0),
        g AS (SELECT case_id, source_id AS node FROM f UNION SELECT case_id, target_id FROM f)
        SELECT case_id, 'edge' AS kind, edge_id AS id FROM i WHERE substr(edge_id, 2)::BIGINT % 23 = 0
        UNION ALL SELECT case_id, 'node', node FROM g WHERE node NOT IN (SELECT node FROM n)""",
    "get_many": f"""WITH {EVIDENCE},
        r AS (SELECT s_suppkey AS request_id, p.i - 1 AS position, 'ev' || (s_suppkey * [7, 1, 400][p.i]) AS evidence_id FROM supplier, (SELECT unnest([1, 2, 3]) AS i) p)
        SELECT request_id, position::INTEGER AS position, r.evidence_id, category, e.evidence_id IS NOT NULL AS found FROM r LEFT JOIN evidence e USING (evidence_id)""",
    "evidence_by_polarity": f"""WITH {EVIDENCE}
        SELECT case_id, evidence_id, (row_number() OVER (PARTITION BY case_id ORDER BY evidence_id))::INTEGER AS rank FROM evidence
        WHERE polarity = 'SUPPORTING' QUALIFY rank <= 3""",
    "prompt_evidence": f"""WITH {EVIDENCE},
        g AS (SELECT case_id, evidence_id, 0 AS grp FROM evidence WHERE substr(evidence_id, 3)::BIGINT % 11 = 0
              UNION ALL SELECT case_id, evidence_id, 1 FROM evidence WHERE polarity = 'MITIGATING'
              UNION ALL SELECT case_id, evidence_id, 2 FROM evidence WHERE polarity = 'SUPPORTING'),
        k AS (SELECT *, row_number() OVER (PARTITION BY case_id, grp ORDER BY evidence_id) AS rk FROM g QUALIFY rk <= 4),
        m AS (SELECT case_id, evidence_id, min(grp * 1000 + rk) AS pos FROM k GROUP BY case_id, evidence_id)
        SELECT case_id, evidence_id, (row_number() OVER (PARTITION BY case_id ORDER BY pos, evidence_id))::INTEGER AS position FROM m""",
    "case_summary": f"""WITH {EVIDENCE}
        SELECT case_id, count(DISTINCT evidence_id)::INTEGER AS n_evidence, count(DISTINCT CASE WHEN n_chars > 500 THEN source_ref END)::INTEGER AS n_trace_edges
        FROM evidence GROUP BY case_id""",
    "latest_pins": f"""WITH {EDGES}, {CASES},
        o AS (SELECT case_id, edge_id, substr(edge_id, 2)::BIGINT AS k, n FROM case_edges, (SELECT unnest([0, 1, 2]) AS n) u),
        c AS (SELECT case_id, edge_id, k + n * 100000 AS seq, (k + n) % 3 <> 0 AS is_pinned, CASE WHEN (k + n) % 2 = 0 THEN 'FAN_IN' ELSE 'LAYERING' END AS tag FROM o
              UNION ALL SELECT 'case' || (event_id // {t.CASE_EVENTS} + 1), edge_id, event_id + 1000000, true, 'LAYERING' FROM edges)
        SELECT case_id, edge_id, is_pinned, tag, seq FROM c QUALIFY row_number() OVER (PARTITION BY case_id, edge_id ORDER BY seq DESC) = 1""",
    "claim_status": f"""WITH {_RUNS}
        SELECT run_id, status, CASE WHEN status = 'HYPOTHESIS_GENERATED' AND full_answer THEN 2 ELSE 0 END::INTEGER AS n_claims FROM st""",
    "claim_metrics": f"""WITH {_RUNS},
        w AS (SELECT run_id, status, CASE WHEN NOT full_answer THEN 0 WHEN run_id % 7 = 0 THEN 3 WHEN run_id % 7 = 1 THEN 1 ELSE 2 END AS cited,
                     CASE WHEN NOT full_answer OR run_id % 19 = 0 THEN 0 WHEN run_id % 7 = 1 THEN 1 ELSE 2 END AS valid,
                     CASE WHEN full_answer THEN 2 ELSE 0 END AS claims,
                     CASE WHEN NOT full_answer OR run_id % 19 = 0 THEN 0 WHEN run_id % 7 = 1 THEN 1 ELSE 2 END AS covered FROM st)
        SELECT round(sum(valid) / sum(cited), 9) AS citation_precision, round(sum(covered) / sum(claims), 9) AS claim_coverage,
               (sum(claims) - sum(covered))::BIGINT AS unsupported_claims,
               round(count(*) FILTER (status IN ('INSUFFICIENT_EVIDENCE', 'AI_UNAVAILABLE')) / count(*), 9) AS abstention_rate FROM w""",
    "latency_percentiles": """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, min(value) AS p0, min(value) FILTER (i >= ceil(0.5 * n)) AS p50, min(value) FILTER (i >= ceil(0.95 * n)) AS p95,
               min(value) FILTER (i >= ceil(0.99 * n)) AS p99 FROM r GROUP BY event_type""",
    "usage_by_case": """
        WITH u AS (SELECT 'u' || user_id AS case_id, count(*) FILTER (event_id % 4 < 3) AS calls,
               coalesce(sum(event_id % 800) FILTER (event_id % 4 = 0), 0)::BIGINT AS settled_in, coalesce(sum(event_id % 80) FILTER (event_id % 4 = 0), 0)::BIGINT AS settled_out,
               coalesce(sum(event_id % 900) FILTER (event_id % 4 IN (1, 2)), 0)::BIGINT AS pending_in, coalesce(sum(event_id % 90) FILTER (event_id % 4 IN (1, 2)), 0)::BIGINT AS pending_out
               FROM events GROUP BY user_id)
        SELECT *, calls > 6 OR settled_in + pending_in > 60000 OR settled_out + pending_out > 8000 AS over_limit FROM u""",
    "usage_by_month": """
        WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS month_key, coalesce(sum(CASE WHEN event_id % 4 = 0 THEN ((event_id % 800) * 7 + (event_id % 80) * 28 + 1999) // 2000
               WHEN event_id % 4 IN (1, 2) THEN ((event_id % 900) * 7 + (event_id % 90) * 28 + 1999) // 2000 END), 0)::BIGINT AS committed_cost FROM events GROUP BY 1)
        SELECT *, committed_cost > 200000 AS over_limit FROM m""",
    "release_status": """
        WITH s AS (SELECT s_suppkey AS r, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 8 END AS n, CASE WHEN s_suppkey % 10 IN (3, 4) THEN 1 ELSE 0 END AS p FROM supplier)
        SELECT r AS release_id, n::BIGINT AS n_artifacts, p::BIGINT AS n_problems, p = 0 AND r % 7 <> 0 AND r % 11 <> 0 AND r % 13 <> 0 AS ready FROM s""",
    "content_hash": "SELECT count(*) AS row_count, true AS order_free, count(*) FILTER (l_orderkey = 1) > 0 AS sees_changes FROM lineitem",
}
