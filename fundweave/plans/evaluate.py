"""Queries over audits, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundweave.functions.scalars import next_model_family
from fundweave.operators import audits, drift, evaluation
from fundweave.plans import tables as t
from fundweave.plans.tables import CASES, EDGES


def _members(spark, d):
    c = t.case_edges(spark, d)
    records = c.groupBy("case_id").agg(
        F.collect_set("source_id").alias("entity_ids"), F.collect_set("edge_id").alias("edge_ids"),
        (F.regexp_extract(F.first("case_id"), r"\d+", 0).cast("int") % 9).alias("generator_seed"),
    )
    k = F.regexp_extract("case_id", r"\d+", 0).cast("int")
    manifest = records.select("case_id", F.when(k % 2 == 0, "train").otherwise("test").alias("track"))
    return audits.split_members(records, manifest)


def _overlap(spark, d):
    return audits.split_overlap(_members(spark, d))


def _temporal(spark, d):
    e = t.edges(spark, d)
    ticks = e.select(F.col("event_id").alias("tick"))
    side = F.when(F.col("event_id") <= 500, "train").otherwise("test")
    ids = e.select(side.alias("side"), F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("source_id").alias("id")), F.struct(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))).alias("x"))
    return audits.temporal_split_audit(ticks, ids.select("side", "x.*"), 500, 20)


def _embargo(spark, d):
    e = t.edges(spark, d).select(F.floor(F.unix_timestamp("event_time") / 3600).alias("tick"), "edge_id")
    begin = 473352  # hours to 2024-01-01
    return audits.embargo_violations(e, begin + 200, 24)


def _stages(spark, d):
    e = t.edges(spark, d)
    names = F.array(*[F.lit(s) for s in audits.STAGES])
    at = F.col("event_id") % 9 + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    log = e.select(F.floor(F.col("event_id") / 9).alias("run_id"), F.col("event_id").alias("seq"), F.get(names, (at % 9).cast("int")).alias("stage"))
    return audits.stage_violations(log)


def _scores(spark, d):
    return t.edges(spark, d).join(t.read(spark, d, "events").select("event_id", "event_type"), "event_id").select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.col("amount") / 500, F.lit(1.0)).alias("score")
    )


def _detection(spark, d):
    m = evaluation.detection_metrics(_scores(spark, d), 100)
    return m.select(F.round("average_precision", 9).alias("average_precision"), F.round("precision_at_k", 9).alias("precision_at_k"), "n_alerts", F.round("brier", 9).alias("brier"))


def _alerts(spark, d):
    return evaluation.top_alerts(_scores(spark, d), 100)


def _traces(spark, d):
    c = t.case_edges(spark, d)
    k = F.substring("edge_id", 2, 20).cast("long") % 3
    labels = c.select("case_id", "edge_id", F.when(k == 0, "RELEVANT").when(k == 1, "CONFIRMED_BENIGN").otherwise("UNKNOWN").alias("label"))
    returned = c.where(F.col("amount") > 60).select("case_id", "edge_id")
    m = evaluation.trace_metrics(returned, labels)
    return m.select("case_id", *[F.round(x, 9).alias(x) for x in ("recall", "benign_share", "unknown_share")])


def _rank(spark, d):
    c = t.case_edges(spark, d)
    return evaluation.rank_edges(c.select("case_id", "edge_id", F.round("amount", -1).alias("score")))


def _mask(spark, d):
    e = t.edges(spark, d).select("edge_id", F.when(F.col("event_id") % 3 == 0, "UNKNOWN").when(F.col("event_id") % 3 == 1, "RELEVANT").otherwise("CONFIRMED_BENIGN").alias("label"))
    return evaluation.training_mask(e)


def _gate(spark, d):
    c = t.read(spark, d, "supplier")
    key = F.col("s_suppkey")
    base = F.array(*[(F.lit(60) + (key * p) % 11).cast("double") for p in (3, 5, 7, 2, 9)])
    cand = F.array(*[(F.lit(60) + (key * p) % 11 + (key * q) % 7 - 2).cast("double") for p, q in ((3, 4), (5, 6), (7, 3), (2, 5), (9, 2))])
    g = evaluation.bootstrap_gate(c.select("s_suppkey", base.alias("baseline"), cand.alias("candidate")))
    return g.select("s_suppkey", F.round("lower_bound", 6).alias("lower_bound"), F.col("n_gains").cast("long").alias("n_gains"), "selected")


def _family(spark, d):
    p = t.read(spark, d, "part")
    key = F.col("p_partkey")
    fam = next_model_family(key % 5 - 1, F.col("p_size") > 25, key % 7 - 3, key % 2 == 0, key % 11 - 4)
    return p.select("p_partkey", fam.alias("family"))


def _halves(spark, d):
    e = t.edges(spark, d)
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("amount", F.col("amount") * 1.3)


def _bins(spark, d):
    edges, bins = drift.psi_bins(_halves(spark, d)[0], "amount", 10)
    lower = F.array(*[F.lit(x if x > float("-inf") else None) for x in edges[:-1]]).cast("array<double>")
    return bins.select("bin", F.round(F.get(lower, F.col("bin")), 6).alias("lower_edge"), "n", F.round("share", 9).alias("share"))


def _psi(spark, d):
    base, current = _halves(spark, d)
    edges, bins = drift.psi_bins(base, "amount", 10)
    p = drift.psi(edges, bins, current, "amount")
    return p.select(F.round("psi", 9).alias("psi"), "drifted")


QUERIES = {
    "split_overlap": _overlap,
    "temporal_split_audit": _temporal,
    "embargo_violations": _embargo,
    "stage_order": _stages,
    "detection_metrics": _detection,
    "top_alerts": _alerts,
    "trace_metrics": _traces,
    "rank_edges": _rank,
    "training_mask": _mask,
    "promotion_gate": _gate,
    "next_model_family": _family,
    "psi_bins": _bins,
    "psi_drift": _psi,
}

_SCORES = f"""{EDGES},
s AS (SELECT event_id AS row_id, (event_type = 'purchase')::INTEGER AS y, least(amount / 500, 1.0) AS score FROM edges JOIN events USING (event_id))"""
_BINS = f"""{EDGES},
b AS (SELECT amount FROM edges WHERE event_id % 2 = 0), c AS (SELECT amount * 1.3 AS amount FROM edges WHERE event_id % 2 = 1),
q AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM b),
nb AS (SELECT len(list_filter(e, lambda x: amount >= x)) AS bin, count(*) AS n FROM b, q GROUP BY 1),
nc AS (SELECT len(list_filter(e, lambda x: amount >= x)) AS bin, count(*) AS n FROM c, q GROUP BY 1)"""

ORACLE_SQL = {
    "split_overlap": f"""WITH {EDGES}, {CASES},
        m AS (SELECT substr(case_id, 5)::INTEGER AS k, source_id, edge_id FROM case_edges),
        x AS (SELECT DISTINCT k % 2 AS o, 'entity' AS kind, source_id AS id FROM m UNION SELECT DISTINCT k % 2, 'edge', edge_id FROM m
              UNION SELECT DISTINCT k % 2, 'seed', (k % 9)::VARCHAR FROM m)
        SELECT kind, id FROM x GROUP BY kind, id HAVING count(DISTINCT o) = 2""",
    "temporal_split_audit": f"""WITH {EDGES},
        n AS (SELECT count(*) AS n_embargo FROM edges WHERE event_id > 500 AND event_id <= 520),
        o AS (SELECT count(*) AS n_overlap FROM (SELECT source_id FROM edges WHERE event_id <= 500 INTERSECT SELECT source_id FROM edges WHERE event_id > 500))
        SELECT CASE WHEN n_overlap > 0 OR n_embargo > 0 THEN 'BLOCKED_DATA' ELSE 'SAFE' END AS status, n_overlap, n_embargo FROM n, o""",
    "embargo_violations": f"""WITH {EDGES}, x AS (SELECT (epoch_us(event_time) // 3600000000)::BIGINT AS tick, edge_id FROM edges)
        SELECT * FROM x WHERE tick > 473552 AND tick <= 473576""",
    "stage_order": f"""WITH {EDGES},
        l AS (SELECT event_id // 9 AS run_id, event_id AS seq, 1 + (event_id % 9 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 9 AS pos FROM edges),
        w AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY run_id ORDER BY seq), 0) AS b FROM l)
        SELECT run_id, seq, ['PREREGISTERED', 'DATA_VERIFIED', 'FITTED', 'VALIDATED', 'CALIBRATED', 'FROZEN', 'TESTED', 'TRACE_EVALUATED', 'DECIDED'][pos::INTEGER] AS stage FROM w WHERE pos <> b + 1""",
    "detection_metrics": f"""WITH {_SCORES},
        g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM s GROUP BY score),
        r AS (SELECT *, sum(pos) OVER o AS cp, sum(n) OVER o AS cn, sum(pos) OVER () AS total FROM g WINDOW o AS (ORDER BY score DESC)),
        k AS (SELECT y FROM s ORDER BY score DESC, row_id LIMIT 100)
        SELECT (SELECT round(sum(pos * (cp / cn)) / max(total), 9) FROM r) AS average_precision, (SELECT round(avg(y), 9) FROM k) AS precision_at_k,
               (SELECT count(*) FROM k) AS n_alerts, (SELECT round(avg((score - y) * (score - y)), 9) FROM s) AS brier""",
    "top_alerts": f"""WITH {_SCORES}
        SELECT row_id, y, score, (row_number() OVER (ORDER BY score DESC, row_id))::INTEGER AS rank FROM s QUALIFY rank <= 100""",
    "trace_metrics": f"""WITH {EDGES}, {CASES},
        l AS (SELECT case_id, edge_id, substr(edge_id, 2)::BIGINT % 3 AS k, amount > 60 AS hit FROM case_edges)
        SELECT case_id, round(coalesce(count(*) FILTER (hit AND k = 0) / nullif(count(*) FILTER (k = 0), 0), 0), 9) AS recall,
               round(coalesce(count(*) FILTER (hit AND k = 1) / nullif(count(*) FILTER (hit), 0), 0), 9) AS benign_share,
               round(coalesce(count(*) FILTER (hit AND k = 2) / nullif(count(*) FILTER (hit), 0), 0), 9) AS unknown_share
        FROM l GROUP BY case_id""",
    "rank_edges": f"""WITH {EDGES}, {CASES}
        SELECT case_id, edge_id, round(amount, -1) AS score,
               (row_number() OVER (PARTITION BY case_id ORDER BY round(amount, -1) DESC, edge_id))::INTEGER AS rank FROM case_edges""",
    "training_mask": f"""WITH {EDGES} SELECT edge_id, CASE event_id % 3 WHEN 1 THEN 'RELEVANT' ELSE 'CONFIRMED_BENIGN' END AS label FROM edges WHERE event_id % 3 <> 0""",
    "promotion_gate": """
        WITH s AS (SELECT s_suppkey, [(s_suppkey * 4) % 7 - 2, (s_suppkey * 6) % 7 - 2, (s_suppkey * 3) % 7 - 2, (s_suppkey * 5) % 7 - 2, (s_suppkey * 2) % 7 - 2] AS d FROM supplier),
        m AS (SELECT s_suppkey, d, (d[1 + i % 5] + d[1 + (i // 5) % 5] + d[1 + (i // 25) % 5] + d[1 + (i // 125) % 5] + d[1 + (i // 625) % 5])::DOUBLE / 5 AS m
              FROM s, unnest(range(3125)) AS t(i))
        SELECT s_suppkey, round(quantile_cont(m, 0.025), 6) AS lower_bound, len(list_filter(any_value(d), lambda x: x > 0)) AS n_gains,
               quantile_cont(m, 0.025) > 0 AND len(list_filter(any_value(d), lambda x: x > 0)) >= 4 AS selected FROM m GROUP BY s_suppkey""",
    "next_model_family": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 - 1 <= 0 THEN 'JUSTIFIED_NULL' WHEN p_size > 25 AND p_partkey % 7 - 3 <= 0 THEN 'hgt'
            WHEN p_partkey % 2 = 0 AND p_partkey % 11 - 4 <= 0 THEN 'tgn' WHEN p_partkey % 7 - 3 > 0 AND p_partkey % 11 - 4 > 0 THEN 'hybrid'
            ELSE 'JUSTIFIED_NULL' END AS family FROM part""",
    "psi_bins": f"""WITH {_BINS}
        SELECT bin::INTEGER AS bin, round(CASE WHEN bin > 0 THEN e[bin] END, 6) AS lower_edge, n, round(n / sum(n) OVER (), 9) AS share FROM nb, q""",
    "psi_drift": f"""WITH {_BINS},
        j AS (SELECT nb.n / (SELECT sum(n) FROM nb) AS b, greatest(coalesce(nc.n, 0) / (SELECT sum(n) FROM nc), 1e-9) AS c FROM nb LEFT JOIN nc USING (bin))
        SELECT round(sum((c - b) * ln(c / b)), 9) AS psi, sum((c - b) * ln(c / b)) >= 0.1 AS drifted FROM j""",
}
