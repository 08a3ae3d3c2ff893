"""Many-small-senders clusters, hidden flows, bundles and the view of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundweave.functions.scalars import url_component
from fundweave.shared import staged, with_ordinal

#: Fixed values of the typology: largest amount, window and number of senders.
SMALL_VND, WINDOW_MS, LEAST_SENDERS = 50_000_000, 3_600_000, 5


def funding_candidates(
    edges: DataFrame, cutoff: Column, *, below: float = SMALL_VND, window_ms: int = WINDOW_MS, senders: int = LEAST_SENDERS
) -> DataFrame:
    """case_id, target_id, first_ms, senders: windows that begin at an edge and hold enough senders.

    edges (case_id, seed, edge_id, source_id, target_id, amount, currency, event_time). A
    window is closed at both ends. Small edges are filtered first; then time is cut into
    blocks of the window's length and each edge is copied to the block before its own, as a
    window never reaches past the next block: a target's edges are dealt by block.
    """
    e = edges.where(
        (F.col("currency") == "VND") & (F.col("amount") > 0) & (F.col("amount") < below) & (F.col("source_id") != F.col("target_id"))
        & (F.col("source_id") != F.col("seed")) & (F.col("event_time") <= cutoff)
    ).withColumn("ms", F.unix_millis("event_time"))
    e = e.select("case_id", "target_id", "source_id", "ms").distinct()
    e = e.withColumn("before", F.lag("ms").over(Window.partitionBy("case_id", "target_id", "source_id").orderBy("ms")))
    own = F.floor(F.col("ms") / window_ms)
    e = e.withColumn("own", own).withColumn("block", F.explode(F.array(own, own - 1)))
    near = F.coalesce(F.col("ms") - F.col("before") <= window_ms, F.lit(False))
    keys, one, none = ["case_id", "target_id", "block"], F.lit(1), F.lit(0)
    starts = e.select(*keys, "own", F.col("ms").alias("at"), one.alias("edge"), near.cast("int").alias("again"), none.alias("first"))
    firsts = e.where(near).select(*keys, F.lit(None).cast("long").alias("own"), F.col("before").alias("at"), none.alias("edge"), none.alias("again"), one.alias("first"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto, under = order.rangeBetween(Window.unboundedPreceding, window_ms), order.rangeBetween(Window.unboundedPreceding, -1)
    repeats = F.sum("again").over(upto) - F.coalesce(F.sum("first").over(under), none)
    n = F.sum("edge").over(upto) - F.coalesce(F.sum("edge").over(under), none) - repeats
    kept = starts.unionByName(firsts).withColumn("n", n).where((F.col("own") == F.col("block")) & (F.col("edge") == 1) & (F.col("n") >= senders))
    kept = kept.select(*keys, F.col("at").alias("first_ms")).distinct()
    inside = kept.join(e.select(*keys, "source_id", "ms"), keys).where(F.col("ms").between(F.col("first_ms"), F.col("first_ms") + window_ms))
    return inside.groupBy("case_id", "target_id", "first_ms").agg(F.array_sort(F.collect_set("source_id")).alias("senders"))


def greedy_clusters(rows: list[tuple[str, int, list[str]]], least: int) -> list[tuple[str, int, list[str]]]:
    """Candidates in order of target, first time and senders; each sender joins one cluster."""
    taken: set[str] = set()
    out = []
    for target, first, senders in sorted(rows, key=lambda r: (r[0], r[1], "|".join(r[2]))):
        free = [s for s in senders if s not in taken]
        if len(free) >= least:
            taken.update(free)
            out.append((target, first, free))
    return out


def greedy_rounds(candidates: DataFrame, least: int) -> DataFrame:
    """greedy_clusters() of every case, in rounds: case_id, target_id, first_ms, senders.

    In each round the candidates that come first at all of their free senders are settled
    at once: nothing before them can take any of those. They take them, and what is left
    with too few goes. A round is a few groups and joins by sender and by candidate; no task
    holds a case. The least candidate of each case is settled in every round.
    """
    order = F.concat_ws("|", "senders").alias("joined")
    ranked = staged(with_ordinal(candidates.select("*", order), "case_id", "target_id", "first_ms", "joined", name="rank").drop("joined"), "cluster-candidates")
    members = ranked.select("case_id", "rank", F.explode("senders").alias("source_id"))
    taken = None
    while True:
        enough = members.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("rank")
        alive = staged(members.join(enough, "rank"), "cluster-members")
        if alive.isEmpty():
            break
        first = alive.groupBy("case_id", "source_id").agg(F.min("rank").alias("first"))
        settled = alive.join(first, ["case_id", "source_id"]).groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("first")).alias("all")).where("all").select("rank")
        now = staged(alive.join(settled, "rank"), "cluster-taken")
        taken = now if taken is None else taken.unionByName(now)
        members = alive.join(now.select("case_id", "source_id"), ["case_id", "source_id"], "left_anti").select("case_id", "rank", "source_id")
    if taken is None:
        return ranked.limit(0).drop("rank")
    lists = taken.groupBy("rank").agg(F.array_sort(F.collect_set("source_id")).alias("senders"))
    return ranked.drop("senders").join(lists, "rank").select("case_id", "target_id", "first_ms", "senders")


def funding_clusters(edges: DataFrame, cutoff: Column, *, below: float = SMALL_VND, window_ms: int = WINDOW_MS, senders: int = LEAST_SENDERS) -> DataFrame:
    """case_id, cluster_id, target_id, senders, n_edges, total, first_time, last_time.

    The greedy choice within a case is made in rounds; totals come from the member edges by
    a join.
    """
    chosen = greedy_rounds(funding_candidates(edges, cutoff, below=below, window_ms=window_ms, senders=senders), senders)
    name = F.concat(F.lit("cluster:"), url_component(F.col("target_id")), F.lit(":"), url_component(F.array_join("senders", "|")))
    chosen = chosen.withColumn("cluster_id", name)
    m = chosen.select("case_id", "cluster_id", "target_id", "senders", "first_ms", F.explode("senders").alias("source_id"))
    e = edges.where((F.col("currency") == "VND") & (F.col("amount") > 0) & (F.col("amount") < below) & (F.col("event_time") <= cutoff))
    j = m.join(e.drop("seed"), ["case_id", "target_id", "source_id"])
    j = j.where(F.unix_millis("event_time").between(F.col("first_ms"), F.col("first_ms") + window_ms))
    return j.groupBy("case_id", "cluster_id", "target_id", "senders").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("total"),
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
    )


def project_view(edges: DataFrame, cutoff: Column, min_amount: float, overridden: DataFrame, hidden: DataFrame) -> DataFrame:
    """edges with state: visible, future, unknown_time, hidden (by hand) or small (by amount).

    overridden and hidden (case_id, edge_id). Hiding by hand beats an override; the amount
    rule holds for VND alone; without a cutoff nothing is visible.
    """
    e = edges.join(overridden.select("case_id", "edge_id", F.lit(True).alias("_o")).distinct(), ["case_id", "edge_id"], "left")
    e = e.join(hidden.select("case_id", "edge_id", F.lit(True).alias("_h")).distinct(), ["case_id", "edge_id"], "left")
    small = (F.col("currency") == "VND") & (F.col("amount") < min_amount) & F.col("_o").isNull()
    state = (
        F.when(F.col("event_time").isNull(), "unknown_time").when(F.coalesce(F.col("event_time") > cutoff, F.lit(True)), "future")
        .when(F.col("_h"), "hidden").when(F.coalesce(small, F.lit(False)), "small").otherwise("visible")
    )
    return e.withColumn("state", state).drop("_o", "_h")


def hidden_flow_by_node(view: DataFrame) -> DataFrame:
    """case_id, node, edge_ids, total of the edges that only their amount hides; a self-loop counts once."""
    ends = F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node")
    e = view.where(F.col("state") == "small").select("case_id", ends, "edge_id", "amount")
    return e.groupBy("case_id", "node").agg(
        F.array_sort(F.collect_list("edge_id")).alias("edge_ids"), F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("total")
    )


def cluster_bundles(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """case_id, source, target, currency, edge_ids, total, first_time, last_time.

    owners (case_id, node, cluster_id) of collapsed clusters. Edges with an end in a cluster
    are drawn to it, those within one are dropped; VND edges between the same ends are one
    bundle, others one each.
    """
    s = owners.select("case_id", F.col("node").alias("source_id"), F.col("cluster_id").alias("cs"))
    t = owners.select("case_id", F.col("node").alias("target_id"), F.col("cluster_id").alias("ct"))
    e = edges.join(s, ["case_id", "source_id"], "left").join(t, ["case_id", "target_id"], "left").where("cs is not null or ct is not null")
    e = e.withColumn("source", F.coalesce("cs", "source_id")).withColumn("target", F.coalesce("ct", "target_id")).where("source <> target")
    own = F.when(F.coalesce(F.col("currency") == "VND", F.lit(False)), F.lit("")).otherwise(F.col("edge_id"))
    return e.groupBy("case_id", "source", "target", "currency", own.alias("_own")).agg(
        F.array_sort(F.collect_list("edge_id")).alias("edge_ids"), F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("total"),
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
    ).drop("_own")
