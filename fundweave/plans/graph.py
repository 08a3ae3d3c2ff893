"""Queries over traversals and typologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundweave.operators import traversal, typology
from fundweave.plans import tables as t
from fundweave.plans.tables import CASES, CUTOFF, EDGES

HOUR24 = 24 * 3_600_000


def _cut():
    return F.lit(CUTOFF).cast("timestamp")


def _seeds(c):
    return c.select("case_id", F.col("seed").alias("node")).distinct()


def _distances(spark, d):
    c = t.case_edges(spark, d)
    return traversal.distances(c, _seeds(c), 4)


def _trace(spark, d):
    c = t.case_edges(spark, d)
    return traversal.bounded_trace(c, _seeds(c), 4, 40)[0].select("case_id", "edge_id", "hop", "rank")


def _trace_summary(spark, d):
    c = t.case_edges(spark, d)
    s = traversal.bounded_trace(c, _seeds(c), 2, 40)[1]
    return s.select("case_id", "n_edges", "truncated", "total_hops", F.array_join("nodes", ",").alias("nodes"))


def _fund_trace(spark, d):
    c = t.case_edges(spark, d)
    cases = c.groupBy("case_id", F.col("seed").alias("seed_entity")).agg(F.array_sort(F.collect_set("edge_id")).alias("trace_edge_ids"))
    return traversal.fund_trace(cases, t.edges(spark, d), 3, 100)[0].select("case_id", "edge_id", "hop", "rank")


def _initial(spark, d):
    c = t.case_edges(spark, d)
    return traversal.canvas_initial(c, _seeds(c), 20)[0]


def _initial_summary(spark, d):
    c = t.case_edges(spark, d)
    return traversal.canvas_initial(c, _seeds(c), 20)[1]


def _requests(spark, d):
    """One request for each edge at the seed: expand its other end, knowing that edge."""
    c = t.case_edges(spark, d).where("source_id = seed or target_id = seed")
    k = F.substring("edge_id", 2, 20).cast("long")
    return c.select(
        F.concat_ws(":", "case_id", "edge_id").alias("request_id"), "case_id",
        F.when(k % 5 == 0, F.lit("A-none")).when(F.col("source_id") == F.col("seed"), F.col("target_id")).otherwise(F.col("source_id")).alias("node"),
        F.when(k % 7 == 0, F.array("edge_id", "edge_id")).otherwise(F.array("edge_id")).alias("known_edges"),
        F.when(k % 11 == 0, "stale").otherwise(F.sha2("case_id", 256)).alias("snapshot_hash"),
    )


def _expand(spark, d, which):
    c = t.case_edges(spark, d)
    snapshots = c.select("case_id", F.sha2("case_id", 256).alias("snapshot_hash")).distinct()
    return traversal.canvas_expand(c, _seeds(c), _requests(spark, d), snapshots, 6)[which]


def _expand_status(spark, d):
    return _expand(spark, d, 0)


def _expand_edges(spark, d):
    return _expand(spark, d, 1)


def _accounts(e):
    """Every account is a seed; those that never send have a trace without edges."""
    return e.select(F.explode(F.array("source_id", "target_id")).alias("seed")).distinct()


def _candidates(spark, d):
    e = t.edges(spark, d)
    return traversal.trace_candidates(e, _accounts(e), 3, 50)


def _candidates_one_hop(spark, d):
    e = t.edges(spark, d)
    return traversal.trace_candidates(e, _accounts(e), 1, 20)


def _targets(c):
    return c.select("case_id", F.col("target_id").alias("node")).distinct()


def _focus_depth(spark, d):
    c = t.case_edges(spark, d)
    return traversal.focus(c, _seeds(c), _targets(c)).where("step = 1").select("case_id", "node", "depth")


def _focus_path(spark, d):
    c = t.case_edges(spark, d)
    return traversal.focus(c, _seeds(c), _targets(c))


def _focus_elements(spark, d):
    c = t.case_edges(spark, d)
    return traversal.focus_elements(c, _seeds(c), _targets(c))


def _funding_candidates(spark, d):
    f = typology.funding_candidates(t.case_edges(spark, d), _cut(), below=50, window_ms=HOUR24, senders=5)
    return f.select("case_id", "target_id", "first_ms", F.array_join("senders", "|").alias("senders"))


def _funding_clusters(spark, d):
    f = typology.funding_clusters(t.case_edges(spark, d), _cut(), below=50, window_ms=HOUR24, senders=5)
    return f.withColumn("senders", F.array_join("senders", "|"))


def _view_of(spark, d):
    c = t.case_edges(spark, d)
    k = F.substring("edge_id", 2, 20).cast("long")
    over, hide = c.where(k % 6 == 0).select("case_id", "edge_id"), c.where(k % 10 == 0).select("case_id", "edge_id")
    return typology.project_view(c, _cut(), 40.0, over, hide)


def _view(spark, d):
    return _view_of(spark, d).select("case_id", "edge_id", "state")


def _hidden(spark, d):
    h = typology.hidden_flow_by_node(_view_of(spark, d))
    return h.withColumn("edge_ids", F.array_join("edge_ids", ","))


def _bundles(spark, d):
    c = t.case_edges(spark, d)
    k = F.substring("source_id", 2, 20).cast("int")
    owners = c.where(k % 4 == 0).select("case_id", F.col("source_id").alias("node"), F.concat(F.lit("cl"), (k % 8).cast("string")).alias("cluster_id")).distinct()
    b = typology.cluster_bundles(c, owners)
    return b.withColumn("edge_ids", F.array_join("edge_ids", ","))


QUERIES = {
    "case_distances": _distances,
    "bounded_trace": _trace,
    "bounded_trace_summary": _trace_summary,
    "fund_trace": _fund_trace,
    "canvas_initial": _initial,
    "canvas_initial_summary": _initial_summary,
    "canvas_expand_status": _expand_status,
    "canvas_expand_edges": _expand_edges,
    "trace_candidates": _candidates,
    "trace_candidates_one_hop": _candidates_one_hop,
    "focus_depth": _focus_depth,
    "focus_path": _focus_path,
    "focus_elements": _focus_elements,
    "funding_candidates": _funding_candidates,
    "funding_clusters": _funding_clusters,
    "project_view": _view,
    "hidden_flow": _hidden,
    "cluster_bundles": _bundles,
}

_C = f"WITH {EDGES}, {CASES}"
_SCOPE = f"""{_C},
sc AS (SELECT e.*, s.d AS d_source, g.d AS d_target FROM case_edges e
       JOIN hops3 s ON s.case_id = e.case_id AND s.node = e.source_id JOIN hops3 g ON g.case_id = e.case_id AND g.node = e.target_id),
vw AS (SELECT case_id, edge_id, source_id, target_id, d_source, d_target,
              (row_number() OVER (PARTITION BY case_id ORDER BY event_time NULLS LAST, edge_id))::INTEGER AS rank
       FROM sc WHERE source_id = seed OR target_id = seed QUALIFY rank <= 20)"""


def _traced(hops: int, most: int) -> str:
    return f"""{_C},
h AS (SELECT e.case_id, e.edge_id, e.source_id, e.target_id, least(coalesce(s.d, 9), coalesce(g.d, 9)) + 1 AS hop FROM case_edges e
      LEFT JOIN hops{hops - 1} s ON s.case_id = e.case_id AND s.node = e.source_id LEFT JOIN hops{hops - 1} g ON g.case_id = e.case_id AND g.node = e.target_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY hop, edge_id))::INTEGER AS rank FROM h WHERE hop <= {hops} QUALIFY rank <= {most})"""


_EXPAND = f"""{_SCOPE},
rq AS (SELECT case_id || ':' || edge_id AS request_id, case_id, edge_id, seed, source_id, target_id, substr(edge_id, 2)::BIGINT AS k,
              CASE WHEN substr(edge_id, 2)::BIGINT % 5 = 0 THEN 'A-none' WHEN source_id = seed THEN target_id ELSE source_id END AS node
       FROM case_edges WHERE source_id = seed OR target_id = seed),
st AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'SNAPSHOT_CONFLICT' WHEN k % 7 = 0 OR node = 'A-none' THEN 'INVALID_EXPANSION' ELSE 'OK' END AS status FROM rq)"""

_FUND = f"""{_C},
e AS (SELECT case_id, target_id, source_id, epoch_us(event_time) // 1000 AS ms, edge_id FROM case_edges
      WHERE currency = 'VND' AND amount > 0 AND amount < 50 AND source_id <> target_id AND source_id <> seed AND event_time <= TIMESTAMP '{CUTOFF}')"""

# Any depth below 100: no case has that many nodes in a row.
_FOCUS = f"""WITH RECURSIVE {EDGES}, {CASES},
bfs AS (SELECT * FROM hops0 UNION SELECT w.case_id, w.b, b.d + 1 FROM bfs b JOIN both_ways w ON w.case_id = b.case_id AND w.a = b.node WHERE b.d < 100),
dist AS (SELECT case_id, node, min(d) AS d FROM bfs GROUP BY ALL),
ln AS (SELECT case_id, source_id AS a, target_id AS b, edge_id FROM case_edges UNION SELECT case_id, target_id, source_id, edge_id FROM case_edges),
nx AS (SELECT x.case_id, x.node, x.d, first(l.b ORDER BY l.b, l.edge_id) AS b, first(l.edge_id ORDER BY l.b, l.edge_id) AS edge_id
       FROM dist x JOIN ln l ON l.case_id = x.case_id AND l.a = x.node JOIN dist y ON y.case_id = x.case_id AND y.node = l.b AND y.d = x.d - 1 GROUP BY ALL),
tg AS (SELECT DISTINCT case_id, target_id AS node FROM case_edges),
pt AS (SELECT case_id, node, d AS depth, d AS step, edge_id, node AS end_node, b AS onward FROM tg JOIN nx USING (case_id, node)
       UNION ALL SELECT p.case_id, p.node, p.depth, p.step - 1, n.edge_id, p.onward, n.b FROM pt p JOIN nx n ON n.case_id = p.case_id AND n.node = p.onward)"""

# At most 50 edges are popped, each queued once a hop: 3 x 51 entries always hold 51 edges, if there are.
_WALK = f"""WITH RECURSIVE {EDGES},
top AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY amount DESC, edge_id) AS r FROM edges QUALIFY r <= 51),
adj AS (SELECT source_id AS node, list({{'a': -amount, 'e': edge_id, 't': target_id}}) AS outs FROM top GROUP BY source_id),
walk AS (
    SELECT s.seed, 0 AS n, NULL::VARCHAR AS edge_id, 0 AS hop, []::VARCHAR[] AS seen,
           list_sort(coalesce(list_transform(outs, lambda o: {{'a': o.a, 'e': o.e, 't': o.t, 'h': 1}}), []))[:153] AS q
    FROM (SELECT source_id AS seed FROM edges UNION SELECT target_id FROM edges) s LEFT JOIN adj ON adj.node = s.seed
    UNION ALL
    SELECT w.seed, w.n + 1, w.x.e, w.x.h, list_append(w.seen, w.x.e),
           list_sort(list_concat(list_filter(w.q, lambda y: y.e <> w.x.e), CASE WHEN w.n + 1 < 50 AND w.x.h < 3
               THEN coalesce(list_transform(list_filter(outs, lambda o: o.e <> w.x.e AND NOT list_contains(w.seen, o.e)), lambda o: {{'a': o.a, 'e': o.e, 't': o.t, 'h': w.x.h + 1}}), [])
               ELSE [] END))[:153]
    FROM (SELECT *, q[1] AS x FROM walk WHERE n < 50 AND len(q) > 0) w LEFT JOIN adj ON adj.node = w.x.t),
ends AS (SELECT seed, max(n) AS n, CASE WHEN len(arg_max(q, n)) > 0 THEN 'TRACE_TRUNCATED' ELSE 'COMPLETE' END AS status FROM walk GROUP BY seed)"""

ORACLE_SQL = {
    "case_distances": f"{_C} SELECT * FROM hops4",
    "bounded_trace": f"{_traced(4, 40)} SELECT case_id, edge_id, hop, rank FROM r",
    "bounded_trace_summary": f"""{_traced(2, 40)},
        n AS (SELECT case_id, count(*) AS n_edges, max(hop) AS total_hops FROM r GROUP BY case_id),
        ids AS (SELECT case_id, source_id AS node FROM r UNION SELECT case_id, target_id FROM r UNION SELECT case_id, node FROM hops0),
        l AS (SELECT case_id, string_agg(node, ',' ORDER BY node) AS nodes FROM ids GROUP BY case_id),
        i AS (SELECT case_id, count(*) AS n FROM case_edges GROUP BY case_id)
        SELECT case_id, coalesce(n_edges, 0) AS n_edges, i.n > coalesce(n_edges, 0) AS truncated, coalesce(total_hops, 0) AS total_hops, nodes
        FROM i JOIN l USING (case_id) LEFT JOIN n USING (case_id)""",
    "fund_trace": f"{_traced(3, 100)} SELECT case_id, edge_id, hop, rank FROM r",
    "canvas_initial": f"{_SCOPE} SELECT * FROM vw",
    "canvas_initial_summary": f"""{_SCOPE},
        a AS (SELECT case_id, count(*) AS n_scope, min(event_time) AS first_time, max(event_time) AS last_time,
                     count(*) FILTER (event_time IS NULL) AS n_unknown_time FROM sc GROUP BY case_id),
        b AS (SELECT case_id, count(*) AS n_view FROM vw GROUP BY case_id)
        SELECT a.*, coalesce(n_view, 0) AS n_view, n_scope > coalesce(n_view, 0) AS truncated FROM a LEFT JOIN b USING (case_id)""",
    "canvas_expand_status": f"{_EXPAND} SELECT request_id, case_id, status FROM st",
    "canvas_expand_edges": f"""{_EXPAND}
        SELECT st.request_id, sc.edge_id, sc.source_id, sc.target_id,
               (row_number() OVER (PARTITION BY st.request_id ORDER BY sc.event_time NULLS LAST, sc.edge_id))::INTEGER AS rank
        FROM st JOIN sc ON sc.case_id = st.case_id AND (sc.source_id = st.node OR sc.target_id = st.node) AND sc.edge_id <> st.edge_id
        WHERE st.status = 'OK' QUALIFY rank <= 5""",
    "trace_candidates": f"""{_WALK}
        SELECT w.seed, status, w.edge_id, source_id, target_id, amount, CASE WHEN w.n > 0 THEN hop END AS hop, CASE WHEN w.n > 0 THEN w.n END AS rank
        FROM walk w JOIN ends USING (seed) LEFT JOIN edges g ON g.edge_id = w.edge_id WHERE w.n > 0 OR ends.n = 0""",
    "trace_candidates_one_hop": f"""WITH {EDGES},
        r AS (SELECT source_id AS seed, edge_id, source_id, target_id, amount, 1 AS hop,
                     (row_number() OVER (PARTITION BY source_id ORDER BY amount DESC, edge_id))::INTEGER AS rank,
                     count(*) OVER (PARTITION BY source_id) AS n FROM edges)
        SELECT seed, CASE WHEN n > 20 THEN 'TRACE_TRUNCATED' ELSE 'COMPLETE' END AS status, edge_id, source_id, target_id, amount, hop, rank
        FROM r WHERE rank <= 20
        UNION ALL SELECT DISTINCT target_id, 'COMPLETE', NULL, NULL, NULL, NULL, NULL, NULL FROM edges WHERE target_id NOT IN (SELECT source_id FROM edges)""",
    "focus_depth": f"""{_FOCUS} SELECT case_id, node, depth FROM pt WHERE step = 1""",
    "focus_path": f"""{_FOCUS} SELECT case_id, node, depth, step, edge_id, end_node FROM pt""",
    "focus_elements": f"""{_FOCUS},
        nb AS (SELECT t.case_id, t.node, e.edge_id, e.source_id, e.target_id FROM tg t
               JOIN case_edges e ON e.case_id = t.case_id AND (e.source_id = t.node OR e.target_id = t.node))
        SELECT case_id, node, 'edge' AS kind, edge_id AS id FROM nb UNION SELECT case_id, node, 'node', source_id FROM nb UNION SELECT case_id, node, 'node', target_id FROM nb
        UNION SELECT case_id, node, 'node', node FROM tg
        UNION SELECT case_id, node, 'edge', edge_id FROM pt UNION SELECT case_id, node, 'node', end_node FROM pt UNION SELECT case_id, node, 'node', onward FROM pt""",
    "funding_candidates": f"""{_FUND}
        SELECT DISTINCT a.case_id, a.target_id, a.ms AS first_ms, string_agg(DISTINCT b.source_id, '|' ORDER BY b.source_id) AS senders
        FROM e a JOIN e b ON b.case_id = a.case_id AND b.target_id = a.target_id AND b.ms BETWEEN a.ms AND a.ms + {HOUR24}
        GROUP BY a.case_id, a.target_id, a.ms HAVING count(DISTINCT b.source_id) >= 5""",
    "funding_clusters": f"""{_FUND.replace("WITH ", "WITH RECURSIVE ", 1)},
        w AS (SELECT a.case_id, a.target_id, a.ms AS first_ms, list(DISTINCT b.source_id ORDER BY b.source_id) AS senders
              FROM e a JOIN e b ON b.case_id = a.case_id AND b.target_id = a.target_id AND b.ms BETWEEN a.ms AND a.ms + {HOUR24}
              GROUP BY a.case_id, a.target_id, a.ms HAVING count(DISTINCT b.source_id) >= 5),
        o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY target_id, first_ms, array_to_string(senders, '|')) AS i FROM w),
        fold AS (
            SELECT DISTINCT case_id, 0::BIGINT AS i, []::VARCHAR[] AS taken, []::VARCHAR[] AS free FROM o
            UNION ALL SELECT case_id, i, CASE WHEN len(free) >= 5 THEN list_concat(taken, free) ELSE taken END, free
            FROM (SELECT o.case_id, o.i, fold.taken, list_filter(o.senders, lambda x: NOT list_contains(fold.taken, x)) AS free
                  FROM fold JOIN o ON o.case_id = fold.case_id AND o.i = fold.i + 1)),
        ch AS (SELECT case_id, target_id, first_ms, free, unnest(free) AS source_id FROM fold JOIN o USING (case_id, i) WHERE len(free) >= 5),
        j AS (SELECT ch.case_id, ch.target_id, array_to_string(free, '|') AS senders, c.amount, c.event_time
              FROM ch JOIN case_edges c ON c.case_id = ch.case_id AND c.target_id = ch.target_id AND c.source_id = ch.source_id
              WHERE c.currency = 'VND' AND c.amount > 0 AND c.amount < 50 AND c.event_time <= TIMESTAMP '{CUTOFF}'
                AND epoch_ms(c.event_time) BETWEEN first_ms AND first_ms + {HOUR24})
        SELECT case_id, 'cluster:' || target_id || ':' || replace(senders, '|', '%7C') AS cluster_id, target_id, senders, count(*) AS n_edges,
               sum(amount::DECIMAL(38,2))::DOUBLE AS total, min(event_time) AS first_time, max(event_time) AS last_time
        FROM j GROUP BY case_id, target_id, senders""",
    "project_view": f"""{_C}
        SELECT case_id, edge_id, CASE WHEN event_time IS NULL THEN 'unknown_time' WHEN event_time > TIMESTAMP '{CUTOFF}' THEN 'future'
            WHEN substr(edge_id, 2)::BIGINT % 10 = 0 THEN 'hidden'
            WHEN currency = 'VND' AND amount < 40 AND substr(edge_id, 2)::BIGINT % 6 <> 0 THEN 'small' ELSE 'visible' END AS state FROM case_edges""",
    "hidden_flow": f"""{_C},
        s AS (SELECT * FROM case_edges WHERE event_time <= TIMESTAMP '{CUTOFF}' AND substr(edge_id, 2)::BIGINT % 10 <> 0
              AND currency = 'VND' AND amount < 40 AND substr(edge_id, 2)::BIGINT % 6 <> 0),
        n AS (SELECT case_id, source_id AS node, edge_id, amount FROM s UNION SELECT case_id, target_id, edge_id, amount FROM s)
        SELECT case_id, node, string_agg(edge_id, ',' ORDER BY edge_id) AS edge_ids, sum(amount::DECIMAL(38,2))::DOUBLE AS total FROM n GROUP BY case_id, node""",
    "cluster_bundles": f"""{_C},
        o AS (SELECT DISTINCT case_id, source_id AS node, 'cl' || (substr(source_id, 2)::INTEGER % 8) AS cl FROM case_edges WHERE substr(source_id, 2)::INTEGER % 4 = 0),
        e AS (SELECT c.*, coalesce(s.cl, c.source_id) AS source, coalesce(g.cl, c.target_id) AS target FROM case_edges c
              LEFT JOIN o s ON s.case_id = c.case_id AND s.node = c.source_id LEFT JOIN o g ON g.case_id = c.case_id AND g.node = c.target_id
              WHERE s.cl IS NOT NULL OR g.cl IS NOT NULL)
        SELECT case_id, source, target, currency, string_agg(edge_id, ',' ORDER BY edge_id) AS edge_ids, sum(amount::DECIMAL(38,2))::DOUBLE AS total,
               min(event_time) AS first_time, max(event_time) AS last_time
        FROM e WHERE source <> target GROUP BY case_id, source, target, currency, CASE WHEN currency = 'VND' THEN '' ELSE edge_id END""",
}
