"""Features and traversals: small examples, and plain versions on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from fundweave.operators import features, traversal, typology
from fundweave.plans import graph, tables
from tests import oracle

EDGE = "edge_id string, source_id string, target_id string, amount double, event_time timestamp"


def _edges(spark, rows):
    df = spark.createDataFrame([(*r[:4], r[4] if len(r) > 4 else "2024-01-01 10:00:00") for r in rows], EDGE.replace("timestamp", "string"))
    return df.withColumn("event_time", F.col("event_time").cast("timestamp"))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("k1", "p", "b", 12.5), ("k2", "b", "q", 5.0)], (1, 1, 12.5, 5.0, 0.4)),
        ([("k1", "p", "b", 0.25), ("k2", "b", "q", 31.0), ("k3", "b", "p", 2.0)], (1, 2, 0.25, 33.0, 1.0)),
        ([("k1", "b", "q", 6.0)], (0, 1, 0.0, 6.0, 0.0)),
        ([("e1", "b", "b", 3.0), ("e2", "a", "b", 1.0), ("e3", "a", "b", 1.0)], (3, 1, 5.0, 3.0, 0.6)),
        ([("e1", "a", "c", 1.0)], (0, 0, 0.0, 0.0, 0.0)),
    ],
)
def test_account_features(spark, rows, want):
    asked = spark.createDataFrame([("b",)], "account_id string")
    r = features.account_features(_edges(spark, rows), "2024-01-01 10:00:00", asked).first()
    assert tuple(r)[1:] == want


def test_cutoff_is_inclusive_and_duplicate_ids_fail_even_after_it(spark):
    e = _edges(spark, [("e1", "a", "b", 1.0), ("e2", "a", "b", 1.0, "2024-01-01 10:00:01"), ("e2", "a", "b", 1.0, "2024-01-02")])
    assert features.at_or_before(e, "2024-01-01 10:00:00").count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        features.build_graph(e, "2024-01-01 10:00:00")


def test_features_do_not_depend_on_partitions(spark):
    r = random.Random(0)
    rows = [(f"e{i}", f"a{r.randrange(9)}", f"a{r.randrange(9)}", r.randrange(1, 10**9) / 100) for i in range(500)]
    got = [sorted(map(tuple, features.account_features(_edges(spark, rows).repartition(n)).collect())) for n in (1, 8)]
    assert got[0] == got[1]


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_order_of_arrival_in_blocks(spark, block):
    r = random.Random(block)
    rows = [(i, f"e{r.randrange(30):02d}", f"2024-01-01 10:{r.randrange(9):02d}:00") for i in range(60)]
    df = spark.createDataFrame(rows, "n int, edge_id string, event_time string").withColumn("event_time", F.col("event_time").cast("timestamp")).repartition(3)
    want = [b[0] for a, b in zip(rows, rows[1:]) if (a[2], a[1]) >= (b[2], b[1])]
    assert sorted(x.n for x in features.monotonic_violations(df, "n", block=block).collect()) == want
    assert sorted(x.n for x in features.monotonic_violations(df.withColumn("s", F.lit(1)), "n", "s").collect()) == want


def _case(spark, rows, case="c"):
    return spark.createDataFrame([(case, *r) for r in rows], "case_id string, edge_id string, source_id string, target_id string")


def _plain_trace(edges, seed, hops, most):
    """Hop by hop over edges in order, undirected, cut at most edges."""
    near, left, out, total = {seed}, list(edges), [], 0
    for hop in range(1, hops + 1):
        found = [e for e in left if e[1] in near or e[2] in near]
        if not found or len(out) == most:
            break
        total = hop
        left = [e for e in left if e not in found]
        out += [(e[0], hop) for e in found[: most - len(out)]]
        near |= {x for e in found for x in e[1:]}
    return out, total, len(edges) > len(out)


def test_bounded_trace_equals_the_plain_version(spark):
    r = random.Random(7)
    rows, want, seeds = [], {}, []
    for k in range(60):
        n = r.randrange(1, 12)
        edges = sorted((f"e{i:02d}", f"n{r.randrange(7)}", f"n{r.randrange(7)}") for i in range(n))
        rows += [(f"c{k}", *e) for e in edges]
        seeds.append((f"c{k}", "n0"))
        want[f"c{k}"] = _plain_trace(edges, "n0", 3, 5)
    e = spark.createDataFrame(rows, "case_id string, edge_id string, source_id string, target_id string")
    returned, summary = traversal.bounded_trace(e, spark.createDataFrame(seeds, "case_id string, node string"), 3, 5)
    got: dict = {k: [] for k in want}
    for x in returned.orderBy("case_id", "rank").collect():
        got[x.case_id].append((x.edge_id, x.hop))
    sums = {x.case_id: (x.total_hops, x.truncated) for x in summary.collect()}
    assert {k: (v, *sums[k]) for k, v in got.items()} == {k: (a, b, c) for k, (a, b, c) in want.items()}


def _plain_best_first(edges, seed, hops, most):
    """Scans all queued edges for the next one; no heap, no pruning."""
    order = lambda e: (-e[0][3], e[0][0], e[0][2], e[1])
    queued = [(e, 1) for e in edges if e[1] == seed]
    found = []
    while queued and len(found) < most:
        edge, hop = min(queued, key=order)
        queued = [q for q in queued if q[0][0] != edge[0]]
        found.append((edge[0], hop))
        if len(found) < most and hop < hops:
            known = {i for i, _ in found}
            queued += [(e, hop + 1) for e in edges if e[1] == edge[2] and e[0] not in known]
    return found, "TRACE_TRUNCATED" if queued else "COMPLETE"


TRACE = "edge_id string, source_id string, target_id string, amount double"


def _traces(spark, rows, seeds, hops, most):
    df = traversal.trace_candidates(spark.createDataFrame(rows, TRACE), spark.createDataFrame([(s,) for s in seeds], "seed string"), hops, most)
    got: dict = {}
    for x in df.orderBy("seed", "rank").collect():
        found, status = got.setdefault(x.seed, ([], x.status))
        assert status == x.status
        if x.edge_id is not None:
            found.append((x.edge_id, x.hop))
    return got


@pytest.mark.parametrize(
    ("rows", "hops", "most", "want", "status"),
    [
        # The budget ends with the first edge: what lies behind it is not queued.
        ([("k1", "s", "p", 8.0), ("k2", "p", "q", 9.0)], 2, 1, ["k1"], "COMPLETE"),
        ([("k1", "s", "p", 8.0), ("k2", "p", "q", 9.0), ("k3", "s", "r", 1.0)], 2, 1, ["k1"], "TRACE_TRUNCATED"),
        # A small edge that no budget reaches is still queued.
        ([("k1", "s", "p", 8.0), ("k2", "s", "q", 0.5)] + [(f"m{i}", "p", f"t{i}", 5.0 + i) for i in range(4)], 2, 3, ["k1", "m3", "m2"], "TRACE_TRUNCATED"),
        ([("k1", "s", "s", 2.0), ("k2", "s", "p", 2.0), ("k3", "p", "s", 3.0)], 4, 9, ["k1", "k2", "k3"], "COMPLETE"),
        ([("k1", "p", "s", 8.0)], 3, 9, [], "COMPLETE"),
        ([("k1", "p", "q", 8.0)], 3, 9, [], "COMPLETE"),
    ],
)
def test_trace_candidates_examples(spark, rows, hops, most, want, status):
    found, got = _traces(spark, rows, ["s"], hops, most)["s"]
    assert [i for i, _ in found] == want and got == status


@pytest.mark.parametrize(("hops", "most"), [(1, 1), (1, 5), (2, 1), (2, 3), (2, 9), (3, 2), (3, 9), (4, 1), (4, 12)])
def test_trace_candidates_equal_a_plain_search(spark, hops, most):
    r = random.Random(10 * hops + most)
    rows, seeds = [], []
    for k in range(12):  # apart from each other, sparse and dense
        n = r.choice([3, 8, 25])
        rows += [(f"e{k:02d}-{i:03d}", f"{k}n{r.randrange(n)}", f"{k}n{r.randrange(n)}", float(r.randrange(1, 15))) for i in range(r.choice([4, 12, 60]))]
        seeds += [f"{k}n{i}" for i in range(n)]
    got = _traces(spark, rows, seeds, hops, most)
    assert got == {s: _plain_best_first(rows, s, hops, most) for s in seeds}


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_trace_amounts_must_be_finite(spark, bad):
    with pytest.raises(Exception, match="not finite"):
        _traces(spark, [("k1", "s", "p", 8.0), ("k2", "s", "q", bad)], ["s"], 2, 5)


def test_trace_candidates_query_traces_every_account(spark):
    accounts = {x for r in tables.edges(spark, oracle.DATA).select("source_id", "target_id").collect() for x in r}
    assert {x.seed for x in graph.QUERIES["trace_candidates"](spark, oracle.DATA).select("seed").distinct().collect()} == accounts


def _path_from(edges, node, seed):
    """[(edge, its end on the node's side)] from the node to the seed; None if it is out of reach."""
    parent, order = {node: None}, [node]
    for at in order:
        for b, i in sorted((b, i) for i, s, t in edges for a, b in ((s, t), (t, s)) if a == at):
            if b not in parent:
                parent[b] = (at, i)
                order.append(b)
    if seed not in parent:
        return None
    path, at = [], seed
    while parent[at]:
        path.append((parent[at][1], parent[at][0]))
        at = parent[at][0]
    return path  # from the seed on


def test_focus_paths_are_those_of_a_search_from_the_node(spark):
    r = random.Random(9)
    rows, seeds, targets, want, elements = [], [], [], {}, {}
    cases = [[(f"e{i:02d}", f"n{r.randrange(8)}", f"n{r.randrange(8)}") for i in range(r.randrange(1, 14))] for _ in range(25)]
    cases.append([("e1", "n0", "a"), ("e2", "a", "z"), ("e3", "z", "t"), ("e4", "n0", "b"), ("e5", "b", "y"), ("e6", "y", "t"), ("e0", "y", "t")])
    cases.append([(f"e{i:02d}", f"n{i}", f"n{i + 1}") for i in range(15)])  # far beyond any fixed depth
    for k, edges in enumerate(cases):
        rows += [(f"c{k}", *e) for e in edges]
        seeds.append((f"c{k}", "n0"))
        for node in sorted({x for e in edges for x in e[1:]} | {"n0", "lonely"}):
            targets.append((f"c{k}", node))
            path = _path_from(edges, node, "n0")
            if path:
                want[f"c{k}", node] = path
            near = [e for e in edges if node in e[1:]]
            elements[f"c{k}", node] = {("node", node)} | {("edge", e[0]) for e in near} | {("node", x) for e in near for x in e[1:]}
            if path:
                elements[f"c{k}", node] |= {("edge", i) for i, _ in path} | {("node", x) for _, x in path} | {("node", "n0")}
    e = spark.createDataFrame(rows, "case_id string, edge_id string, source_id string, target_id string")
    pairs = "case_id string, node string"
    s, t = spark.createDataFrame(seeds, pairs), spark.createDataFrame(targets, pairs)
    got: dict = {}
    for x in traversal.focus(e, s, t).orderBy("case_id", "node", "step").collect():
        got.setdefault((x.case_id, x.node), []).append((x.edge_id, x.end_node))
    assert got == want
    assert [i for i, _ in got["c25", "t"]] == ["e4", "e5", "e0"]
    found: dict = {}
    for x in traversal.focus_elements(e, s, t).collect():
        found.setdefault((x.case_id, x.node), set()).add((x.kind, x.id))
    assert found == elements


FUND = "case_id string, seed string, edge_id string, source_id string, target_id string, amount double, currency string, event_time string"


def _fund(spark, rows):
    return spark.createDataFrame(rows, FUND).withColumn("event_time", F.col("event_time").cast("timestamp"))


def test_funding_clusters(spark):
    amounts = [11e6, 4e6, 49e6, 37e6, 8e6]
    rows = [("five", "h", f"e{i}", f"s{i}", "h", a, "VND", f"2024-01-01 08:{30 + 8 * i % 30}:00") for i, a in enumerate(amounts)]
    rows += [("four", "h", f"e{i}", f"s{i % 4}", "h", 1e6, "VND", "2024-01-01 08:30:00") for i in range(8)]
    rows += [("fifty", "h", f"e{i}", f"s{i}", "h", 50e6 if i == 0 else 1e6, "VND", "2024-01-01 08:30:00") for i in range(5)]
    rows += [("seed", "s0", f"e{i}", f"s{i}", "h", 1e6, "VND", "2024-01-01 08:30:00") for i in range(5)]
    rows += [("late", "h", f"e{i}", f"s{i}", "h", 1e6, "VND", f"2024-01-01 {8 + i // 4 * 2}:30:00") for i in range(5)]
    got = typology.funding_clusters(_fund(spark, rows), F.lit("2024-01-02").cast("timestamp")).collect()
    assert [(x.case_id, x.total, x.n_edges) for x in got] == [("five", 109e6, 5)]
    assert got[0].cluster_id == "cluster:h:s0%7Cs1%7Cs2%7Cs3%7Cs4"


def test_funding_clusters_equal_a_plain_fold(spark):
    r = random.Random(12)
    rows, want = [], []
    for k in range(12):
        edges = []
        for i in range(r.randrange(20, 120)):
            at = 1_704_067_200 + r.randrange(4 * 3600)
            edges.append((f"c{k}", "s0", f"e{i:03d}", f"s{r.randrange(14)}", f"t{r.randrange(3)}", float(r.choice([1, 5, 9, 60])), r.choice(["VND", "VND", "VND", None]), at))
        rows += edges
        small = [e for e in edges if e[6] == "VND" and e[5] < 50 and e[3] != "s0"]
        windows = {(e[4], e[7] * 1000, tuple(sorted({x[3] for x in small if x[4] == e[4] and e[7] <= x[7] <= e[7] + 3600}))) for e in small}
        taken: set = set()
        for target, first, senders in sorted(windows, key=lambda w: (w[0], w[1], "|".join(w[2]))):
            free = [x for x in senders if x not in taken]
            if len(senders) >= 5 and len(free) >= 5:
                taken |= set(free)
                own = [e for e in small if e[4] == target and e[3] in free and first <= e[7] * 1000 <= first + 3_600_000]
                want.append((f"c{k}", target, tuple(free), len(own), sum(e[5] for e in own)))
    df = spark.createDataFrame([(*x[:7], str(x[7])) for x in rows], FUND).withColumn("event_time", F.timestamp_seconds(F.col("event_time").cast("long")))
    got = typology.funding_clusters(df, F.lit("2025-01-01").cast("timestamp"), below=50).collect()
    assert sorted((x.case_id, x.target_id, tuple(x.senders), x.n_edges, x.total) for x in got) == sorted(want) and len(want) > 10


def test_greedy_senders_join_one_cluster():
    rows = [("b", 1, list("vwxyz")), ("a", 1, list("uvwxy")), ("b", 2, list("abcde")), ("b", 3, list("abcdef"))]
    assert typology.greedy_clusters(rows, 5) == [("a", 1, list("uvwxy")), ("b", 2, list("abcde"))]


def test_greedy_rounds_equal_the_fold_on_one_large_case(spark):
    r = random.Random(3)
    rows = {(f"t{r.randrange(20_000):05d}", r.randrange(1000), tuple(sorted(r.sample([f"s{k}" for k in range(g * 40, g * 40 + 40)], r.randint(5, 9))))) for g in r.choices(range(5000), k=100_000)}
    df = spark.createDataFrame([("c", t, f, list(s)) for t, f, s in rows], "case_id string, target_id string, first_ms long, senders array<string>")
    got = typology.greedy_rounds(df, 5).collect()
    want = typology.greedy_clusters([(t, f, list(s)) for t, f, s in rows], 5)
    assert sorted((x.target_id, x.first_ms, x.senders) for x in got) == sorted(want) and len(want) > 10_000
    assert typology.greedy_rounds(df.limit(0), 5).collect() == []


def test_windows_of_distinct_senders_equal_sets(spark):
    r = random.Random(9)
    rows = [("c", "x", f"e{i}", f"s{r.randrange(9)}", f"t{r.randrange(2)}", 1.0, "VND", str(1_704_067_200 + r.randrange(0, 5 * 3600, 7))) for i in range(600)]
    df = spark.createDataFrame(rows, FUND).withColumn("event_time", F.timestamp_seconds(F.col("event_time").cast("long")))
    for window in (0, 60, 1500, 3600):
        got = typology.funding_candidates(df, F.lit("2025-01-01").cast("timestamp"), window_ms=max(1, window * 1000), senders=3).collect()
        want = {(e[4], int(e[7]) * 1000, tuple(sorted({x[3] for x in rows if x[4] == e[4] and int(e[7]) <= int(x[7]) <= int(e[7]) + window}))) for e in rows}
        assert {(g.target_id, g.first_ms, tuple(g.senders)) for g in got} == {w for w in want if len(w[2]) >= 3} and len(got) == len({(g.target_id, g.first_ms) for g in got})


def test_manual_hide_beats_override_and_self_loops_count_once(spark):
    rows = [("c", "s", f"e{i}", "a", "a", 5.0, "VND", "2024-01-01") for i in range(3)]
    ids = lambda *x: spark.createDataFrame([("c", i) for i in x], "case_id string, edge_id string")
    v = typology.project_view(_fund(spark, rows), F.lit("2024-01-01").cast("timestamp"), 10, ids("e0", "e1"), ids("e0"))
    assert {x.edge_id: x.state for x in v.collect()} == {"e0": "hidden", "e1": "visible", "e2": "small"}
    assert [tuple(x) for x in typology.hidden_flow_by_node(v).collect()] == [("c", "a", ["e2"], 5.0)]
    assert {x.state for x in typology.project_view(_fund(spark, rows), F.lit(None).cast("timestamp"), 10, ids("e0"), ids("e1")).collect()} == {"future"}
