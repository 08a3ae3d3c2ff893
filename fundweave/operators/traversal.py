"""Bounded traversals of transfer graphs, for all seeds or cases in one job.

Every traversal is a number of joins of a frontier (case, node, distance) with the edges,
at most four. Hub accounts make one side of such a join skewed, which adaptive execution
splits; frontiers are kept at one row a case and node.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from math import isqrt
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundweave.shared import staged

#: Work bounds of a traversal and of a canvas.
MAX_HOPS, MAX_EDGES, CANVAS_HOPS = 4, 100, 3
_TRACE = pa.schema(
    [("seed", pa.string()), ("status", pa.string()), ("edge_id", pa.string()), ("source_id", pa.string()), ("target_id", pa.string())]
    + [("amount", pa.float64()), ("hop", pa.int32()), ("rank", pa.int32())]
)


def _bounds(max_hops: int, max_edges: int) -> None:
    if not 1 <= max_hops <= MAX_HOPS or not 1 <= max_edges <= MAX_EDGES:
        raise ValueError("max_hops is 1..4 and max_edges 1..100")


def both_ways(edges: DataFrame) -> DataFrame:
    """case_id, a, b: distinct undirected neighbours."""
    ends = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    return edges.select("case_id", F.explode(ends).alias("e")).select("case_id", "e.a", "e.b").distinct()


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """case_id, node, d: undirected distance from the case's seed, up to max_hops.

    edges (case_id, source_id, target_id); seeds (case_id, node).
    """
    pairs = both_ways(edges)
    reached = seeds.select("case_id", "node", F.lit(0).alias("d")).distinct()
    for hop in range(1, max_hops + 1):
        last = reached.where(F.col("d") == hop - 1)
        step = last.join(pairs, (last["case_id"] == pairs["case_id"]) & (last["node"] == pairs["a"]))
        step = step.select(last["case_id"], F.col("b").alias("node"), F.lit(hop).alias("d"))
        reached = reached.unionByName(step).groupBy("case_id", "node").agg(F.min("d").alias("d"))
    return reached


def _edge_hops(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """edges with d_source and d_target (null where out of reach)."""
    s = dist.select("case_id", F.col("node").alias("source_id"), F.col("d").alias("d_source"))
    t = dist.select("case_id", F.col("node").alias("target_id"), F.col("d").alias("d_target"))
    return edges.join(s, ["case_id", "source_id"], "left").join(t, ["case_id", "target_id"], "left")


def bounded_trace(edges: DataFrame, seeds: DataFrame, max_hops: int = 4, max_edges: int = 100, order: str = "edge_id") -> tuple[DataFrame, DataFrame]:
    """(returned, summary) of hop-synchronous undirected traces.

    returned: case_id, edge_id, source_id, target_id, hop, rank. An edge's hop is one more
    than the nearer end's distance; inside a hop edges keep their order, and the first
    max_edges are returned. summary: case_id, n_edges, truncated (any edge of the case not
    returned, reachable or not), total_hops (the hop in which the trace ended), nodes.
    """
    _bounds(max_hops, max_edges)
    dist = distances(edges, seeds, max_hops - 1)
    e = _edge_hops(edges, dist).withColumn("hop", F.least("d_source", "d_target") + 1)
    near = e.where(F.col("hop") <= max_hops)
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("hop", order))
    returned = near.withColumn("rank", rank).where(F.col("rank") <= max_edges)
    returned = returned.select("case_id", "edge_id", "source_id", "target_id", "hop", "rank")
    counts = edges.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_input"))
    sums = returned.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.max("hop").alias("total_hops"),
        F.collect_set("source_id").alias("s"), F.collect_set("target_id").alias("t"),  # max_edges at most
    )
    all_cases = seeds.select("case_id", "node").distinct().join(counts, "case_id", "left").join(sums, "case_id", "left")
    nodes = F.array_sort(F.array_distinct(F.concat(F.coalesce("s", F.array().cast("array<string>")), F.coalesce("t", F.array().cast("array<string>")), F.array("node"))))
    n_edges = F.coalesce("n_edges", F.lit(0).cast("long"))
    return returned, all_cases.select(
        "case_id", n_edges.alias("n_edges"), (F.coalesce("n_input", F.lit(0)) > n_edges).alias("truncated"),
        F.coalesce("total_hops", F.lit(0)).alias("total_hops"), nodes.alias("nodes"),
    )


def fund_trace(cases: DataFrame, edges: DataFrame, max_hops: int = 4, max_edges: int = 100) -> tuple[DataFrame, DataFrame]:
    """bounded_trace over each case's own edges: cases (case_id, seed_entity, trace_edge_ids)."""
    ids = cases.select("case_id", F.explode("trace_edge_ids").alias("edge_id"))
    own = ids.join(edges, "edge_id")
    return bounded_trace(own, cases.select("case_id", F.col("seed_entity").alias("node")), max_hops, max_edges)


def canvas_scope(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distances up to three hops, the case edges with both ends that near)."""
    dist = distances(edges, seeds, CANVAS_HOPS)
    return dist, _edge_hops(edges, dist).where("d_source is not null and d_target is not null")


def scope_stats(scope: DataFrame) -> DataFrame:
    """case_id, n_scope, first_time, last_time, n_unknown_time."""
    return scope.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_scope"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
        F.count_if(F.col("event_time").isNull()).alias("n_unknown_time"),
    )


def _adjacency_order():
    return F.col("event_time").asc_nulls_last(), F.col("edge_id").asc()


def canvas_initial(edges: DataFrame, seeds: DataFrame, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(first view, summary): edges at the seed, known times first; stats of the three-hop scope."""
    dist, scope = canvas_scope(edges, seeds)
    at = scope.join(seeds.select("case_id", F.col("node").alias("seed_node")), "case_id")
    at = at.where((F.col("source_id") == F.col("seed_node")) | (F.col("target_id") == F.col("seed_node")))
    view = at.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*_adjacency_order()))).where(F.col("rank") <= max_edges)
    view = view.select("case_id", "edge_id", "source_id", "target_id", "d_source", "d_target", "rank")
    summary = scope_stats(scope).join(view.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_view")), "case_id", "left").fillna(0, ["n_view"])
    return view, summary.withColumn("truncated", F.col("n_scope") > F.col("n_view"))


def canvas_expand(edges: DataFrame, seeds: DataFrame, requests: DataFrame, snapshots: DataFrame, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(status of each request, edges it adds).

    requests (request_id, case_id, node, known_edges array, snapshot_hash); snapshots
    (case_id, snapshot_hash). A stale hash is SNAPSHOT_CONFLICT. Known edges must be
    distinct, at most max_edges, of the case and within three hops, and the node the seed
    or an end of a known edge; else INVALID_EXPANSION. Then the node's edges in scope are
    added up to max_edges in all.
    """
    _, scope = canvas_scope(edges, seeds)
    scope = staged(scope, "canvas-scope")
    known = requests.select("request_id", "case_id", F.explode("known_edges").alias("edge_id"))
    found = known.join(scope.select("case_id", "edge_id", "source_id", "target_id"), ["case_id", "edge_id"])
    sums = found.groupBy("request_id").agg(
        F.countDistinct("edge_id").alias("n_found"), F.collect_set("source_id").alias("s"), F.collect_set("target_id").alias("t")
    )
    r = requests.join(snapshots.withColumnRenamed("snapshot_hash", "current_hash"), "case_id", "left")
    r = r.join(seeds.select("case_id", F.col("node").alias("seed_node")), "case_id", "left").join(sums, "request_id", "left")
    n = F.size("known_edges")
    ends = F.coalesce(F.array_contains("s", F.col("node")) | F.array_contains("t", F.col("node")), F.lit(False))
    valid = (n <= max_edges) & (F.size(F.array_distinct("known_edges")) == n) & (F.coalesce("n_found", F.lit(0)) == n)
    valid = valid & ((F.col("node") == F.col("seed_node")) | ends)
    status = F.when(~F.col("snapshot_hash").eqNullSafe(F.col("current_hash")), "SNAPSHOT_CONFLICT").when(~F.coalesce(valid, F.lit(False)), "INVALID_EXPANSION").otherwise("OK")
    r = r.withColumn("status", status)
    ok = r.where(F.col("status") == "OK").select("request_id", "case_id", "node", "known_edges")
    ends_of = F.explode(F.array_distinct(F.array("source_id", "target_id")))
    incident = scope.select("case_id", ends_of.alias("node"), "edge_id", "source_id", "target_id", "event_time")
    new = ok.join(incident, ["case_id", "node"]).where(~F.array_contains("known_edges", F.col("edge_id")))
    w = Window.partitionBy("request_id").orderBy(*_adjacency_order())
    new = new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(max_edges) - F.size("known_edges"))
    return r.select("request_id", "case_id", "status"), new.select("request_id", "edge_id", "source_id", "target_id", "rank")


def best_first(edges: list[tuple], seed: str, max_hops: int, max_edges: int) -> tuple[list[tuple], bool]:
    """Edges (edge_id, source, target, amount, out-degree of the source) in the order popped.

    The largest amount first, then edge id, target and hop. The search ends with the last
    edge of the budget, whose target is not entered any more; the flag tells whether a node
    entered has an edge that was not visited.
    """
    by_source: dict[str, list] = {}
    for e in edges:
        by_source.setdefault(e[1], []).append(e)
    heap: list = []
    entered: dict[str, int] = {}

    def enter(node: str, hop: int) -> None:
        entered[node] = max((e[4] for e in by_source.get(node, ())), default=0)
        for e in by_source.get(node, ()):
            heapq.heappush(heap, (-e[3], e[0], e[2], hop, e))

    enter(seed, 1)
    out, visited = [], set()
    while heap and len(out) < max_edges:
        _, edge_id, target, hop, e = heapq.heappop(heap)
        if edge_id in visited:
            continue
        visited.add(edge_id)
        out.append((edge_id, e[1], target, e[3], hop))
        if hop < max_hops and len(out) < max_edges:
            enter(target, hop + 1)
    return out, sum(entered.values()) > len(out)


def _two_hop_floors(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """seed, floor: the largest amount over which a seed reaches `most` of the edges in one or two hops.

    nodes (seed, floor): the floor, where there is one, bounds the edges that are followed.
    Seeds that reach fewer are absent. A node that several edges lead to is followed once,
    over the largest of them.
    """
    enough = F.col("floor").isNull() | (F.col("amount") >= F.col("floor"))
    one = nodes.join(edges, nodes["seed"] == edges["source_id"]).where(enough).select("seed", "floor", "edge_id", F.col("target_id").alias("node"), "amount")
    entered = one.groupBy("seed", "floor", "node").agg(F.max("amount").alias("before"))
    two = entered.join(edges, entered["node"] == edges["source_id"]).where(enough)
    paths = one.select("seed", "edge_id", "amount").unionByName(two.select("seed", "edge_id", F.least("before", "amount").alias("amount")))
    # Dealt by seed alone, so that the edges and their ranks need one shuffle.
    paths = paths.repartition("seed").groupBy("seed", "edge_id").agg(F.max("amount").alias("amount"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("amount")))
    return paths.withColumn("_r", rank).where(F.col("_r") == most).select("seed", F.col("amount").alias("floor"))


def _raised(nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """nodes (seed, floor) with the larger of both floors."""
    higher = F.greatest("floor", "_floor")  # of a null and a number, the number
    return staged(nodes.join(floors.withColumnRenamed("floor", "_floor"), "seed", "left").select("seed", higher.alias("floor")), "candidate-floors")


def _fold(batches: Iterator[pa.RecordBatch], max_hops: int, max_edges: int) -> Iterator[pa.RecordBatch]:
    """The traces of rows (seed, edge_id, source_id, target_id, amount, _n) that are sorted by seed."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    found: list[tuple] = []
    for seed, group in groupby(rows, key=itemgetter(0)):
        out, left = best_first([x[1:] for x in group], seed, max_hops, max_edges)
        status = "TRACE_TRUNCATED" if left else "COMPLETE"
        found += [(seed, status, *e, i) for i, e in enumerate(out, 1)]
        if len(found) >= 10_000:
            yield _trace_batch(found)
            found = []
    if found:
        yield _trace_batch(found)


def _trace_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TRACE, strict=True)], schema=_TRACE)


def trace_candidates(edges: DataFrame, seeds: DataFrame, max_hops: int = 4, max_edges: int = 100) -> DataFrame:
    """seed, status, edge_id, source_id, target_id, amount, hop, rank of best-first traces.

    edges (edge_id, source_id, target_id, amount); seeds (seed). Directed; an edge is
    visited once, a node may be entered again. Status is TRACE_TRUNCATED if an unvisited
    edge was still queued when max_edges were found, else COMPLETE. A seed without edges
    returns one COMPLETE row whose edge is null. A null or non-finite amount is an error.

    No trace can visit more than max_edges edges, so of a source's edges only the
    max_edges + 1 best can matter: they are kept before any join. Where max_edges + 1 edges
    are reached in one or two hops over amounts of at least x, one of them is queued
    whenever an edge is popped, so that no smaller amount is popped: each seed goes on over
    edges of at least its x, and its part, reached within max_hops, is folded by a heap as
    the rows go by, sorted by seed. The largest x is found in two steps, as any smaller one
    holds as well: first among the few best edges of each source, about as many as lead to
    max_edges in two hops, then among all that are not below what that gave. The best edge
    of each source stays, whatever its amount, and carries the number of edges kept for the
    source, so that the status counts smaller ones as well.
    """
    _bounds(max_hops, max_edges)
    sound = F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs("amount") < float("inf"))
    amount = F.when(sound, F.col("amount")).otherwise(F.raise_error(F.lit("an edge amount is missing or not finite")).cast("double"))
    best = Window.partitionBy("source_id").orderBy(F.desc("amount"), "edge_id")
    kept = edges.withColumn("amount", amount).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max_edges + 1)
    kept = kept.withColumn("_n", F.max("_r").over(Window.partitionBy("source_id")))
    kept = staged(kept.select("edge_id", "source_id", "target_id", "amount", "_r", "_n"), "candidate-edges")
    asked = seeds.select("seed").distinct()
    if max_hops > 1:
        asked = staged(asked, "candidate-seeds")
        floors = kept.where(F.col("_r") == max_edges + 1).select(F.col("source_id").alias("seed"), F.col("amount").alias("floor"))
        nodes = asked.join(floors, "seed", "left")
        few = kept.where(F.col("_r") <= isqrt(max_edges) + 3)
        nodes = _raised(nodes, _two_hop_floors(nodes, few.drop("_r", "_n"), max_edges + 1))
        nodes = _raised(nodes, _two_hop_floors(nodes, kept.drop("_r", "_n"), max_edges + 1))
        enough = F.col("floor").isNull() | (F.col("amount") >= F.col("floor"))
        nodes = nodes.select("seed", "floor", F.col("seed").alias("node"))
        reached, slim = nodes, kept.select("source_id", "target_id", "amount")
        for _ in range(max_hops - 1):
            nodes = nodes.join(slim, nodes["node"] == slim["source_id"]).where(enough).select("seed", "floor", F.col("target_id").alias("node")).distinct()
            reached = reached.unionByName(nodes).distinct()
        part = reached.join(kept, reached["node"] == kept["source_id"]).where(enough | (F.col("_r") == 1))
    else:
        part = asked.join(kept, F.col("seed") == kept["source_id"])
    part = part.select("seed", "edge_id", "source_id", "target_id", "amount", "_n")
    # The fold takes far more time than its bytes tell: partitions by the number of sources' edges, which are not put together again.
    n = kept.count() // 50_000 + edges.sparkSession.sparkContext.defaultParallelism
    schema = "seed string, status string, edge_id string, source_id string, target_id string, amount double, hop int, rank int"
    found = part.repartition(n, "seed").sortWithinPartitions("seed").mapInArrow(partial(_fold, max_hops=max_hops, max_edges=max_edges), schema)
    absent = asked.join(kept.select(F.col("source_id").alias("seed")).distinct(), "seed", "left_anti").withColumn("status", F.lit("COMPLETE"))
    return found.unionByName(absent, allowMissingColumns=True)


def _links(edges: DataFrame) -> DataFrame:
    """case_id, a, b, edge_id: neighbours in both directions, with the least edge between them."""
    ends = F.array(
        F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    )
    links = edges.select("case_id", F.explode(ends).alias("e"), "edge_id").select("case_id", "e.a", "e.b", "edge_id")
    return links.groupBy("case_id", "a", "b").agg(F.min("edge_id").alias("edge_id")).where("a <> b")


def steps_to_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """case_id, node, depth, next, edge_id: from each node the step of its shortest link to the seed.

    A breadth-first search from a node that takes neighbours in the order of their id, then
    edge id, finds of its shortest paths to the seed that with the least sequence of nodes.
    Every node nearer to the seed lies on some shortest path, so the next node is the least
    neighbour that is one step nearer, whatever node the search began at: one search from
    the seed, without a limit of depth, serves all nodes of the case.
    """
    links = staged(_links(edges), "focus-links")
    last = staged(seeds.select("case_id", "node", F.lit(0).alias("depth")).distinct(), "focus")
    reached, depth = last, 0
    while True:
        depth += 1
        step = last.join(links, (last["case_id"] == links["case_id"]) & (last["node"] == links["a"])).select(last["case_id"], F.col("b").alias("node"), F.lit(depth).alias("depth"))
        last = staged(step.distinct().join(reached, ["case_id", "node"], "left_anti"), "focus")
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    far = reached.select("case_id", F.col("node").alias("a"), "depth")
    near = reached.select("case_id", F.col("node").alias("b"), (F.col("depth") + 1).alias("depth"))
    best = links.join(far, ["case_id", "a"]).join(near, ["case_id", "b", "depth"])
    best = best.groupBy("case_id", F.col("a").alias("node"), "depth").agg(F.min(F.struct("b", "edge_id")).alias("m"))
    return staged(best.select("case_id", "node", "depth", F.col("m.b").alias("next"), F.col("m.edge_id").alias("edge_id")), "focus-steps")


def focus(edges: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """case_id, node, depth, step, edge_id, end_node: one shortest undirected path between seed and each target.

    Among shortest paths it is the one that a search from the target finds (see
    steps_to_seed). step counts from the seed; end_node is the end of the edge on the target's side.
    """
    steps = steps_to_seed(edges, seeds)
    path = targets.select("case_id", "node").distinct().join(steps, ["case_id", "node"])
    path = staged(path.select("case_id", "node", "depth", F.col("depth").alias("step"), "edge_id", F.col("node").alias("end_node"), "next"), "focus-path")
    out = path
    onward = steps.select("case_id", F.col("node").alias("end_node"), F.col("next").alias("n"), F.col("edge_id").alias("e"))
    while not path.isEmpty():
        path = path.drop("end_node", "edge_id").withColumnRenamed("next", "end_node").join(onward, ["case_id", "end_node"])
        path = path.select("case_id", "node", "depth", (F.col("step") - 1).alias("step"), F.col("e").alias("edge_id"), "end_node", F.col("n").alias("next"))
        path = staged(path, "focus-path")
        out = out.unionByName(path)
    return out.drop("next")


def focus_elements(edges: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """case_id, node, kind (edge, node), id: a node's closed neighbourhood and its path to the seed."""
    asked = targets.select("case_id", "node").distinct()
    ends = edges.select("case_id", "edge_id", "source_id", "target_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"))
    at = ends.join(asked, ["case_id", "node"])
    pair = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("id"))
    near = at.select("case_id", "node", F.explode(F.array(pair("edge", "edge_id"), pair("node", "source_id"), pair("node", "target_id"))).alias("x"))
    path = focus(edges, seeds, asked).select("case_id", "node", F.explode(F.array(pair("edge", "edge_id"), pair("node", "end_node"))).alias("x"))
    own = asked.select("case_id", "node", pair("node", "node").alias("x"))
    # The seed ends the path of every node that reaches it.
    seed = seeds.select("case_id", F.col("node").alias("s")).distinct()
    seed = path.select("case_id", "node").distinct().join(seed, "case_id").select("case_id", "node", pair("node", "s").alias("x"))
    return near.unionByName(path).unionByName(own).unionByName(seed).select("case_id", "node", "x.*").distinct()
