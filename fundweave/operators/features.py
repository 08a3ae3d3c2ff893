"""Point-in-time account features of a transfer graph, given as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundweave.functions.scalars import pass_through
from fundweave.shared import with_ordinal

MONEY = "decimal(18,2)"


def at_or_before(edges: DataFrame, cutoff: Column | str) -> DataFrame:
    """Edges of the graph at a cutoff, inclusive."""
    cut = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    return edges.where(F.col("event_time") <= cut)


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """edge_id, n of ids that stand twice or more, anywhere in time."""
    return edges.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def build_graph(edges: DataFrame, cutoff: str) -> DataFrame:
    """Edges up to the cutoff; an id that stands twice, even after it, is an error."""
    if duplicate_edges(edges).limit(1).count():
        raise ValueError("duplicate edge_id")
    return at_or_before(edges, cutoff)


def _ends(edges: DataFrame) -> DataFrame:
    """Two rows an edge, one for each end, from one scan."""
    money = F.col("amount").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    out = F.struct(F.col("source_id").alias("account_id"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out"), zero.alias("amount_in"), money.alias("amount_out"))
    into = F.struct(F.col("target_id").alias("account_id"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), money.alias("amount_in"), zero.alias("amount_out"))
    return edges.select(F.explode(F.array(out, into)).alias("e")).select("e.*")


def account_features(edges: DataFrame, cutoff: str | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """One row an account: degrees, amounts and pass-through of the edges up to the cutoff.

    Parallel edges and self-loops count. Sums run on decimals, so they are the same in any
    order. With accounts (account_id), those alone are returned, absent ones with zeros.
    The sums are partial before the shuffle, so a hub account costs a row a task.
    """
    at = edges if cutoff is None else at_or_before(edges, cutoff)
    f = _ends(at).groupBy("account_id").agg(
        F.sum("n_in").alias("in_degree"), F.sum("n_out").alias("out_degree"),
        F.sum("amount_in").cast("double").alias("amount_in"), F.sum("amount_out").cast("double").alias("amount_out"),
    )
    if accounts is not None:
        f = accounts.select("account_id").distinct().join(f, "account_id", "left").fillna(0).fillna(0.0)
    return f.withColumn("pass_through_ratio", pass_through(F.col("amount_in"), F.col("amount_out")))


def neighbor_edge_groups(edges: DataFrame) -> DataFrame:
    """account_id, direction, neighbor_id, amounts (by time and edge id), ordinal (first seen)."""
    first = F.struct("event_time", "edge_id")
    ends = F.array(
        F.struct(F.col("source_id").alias("account_id"), F.lit("out").alias("direction"), F.col("target_id").alias("neighbor_id")),
        F.struct(F.col("target_id").alias("account_id"), F.lit("in").alias("direction"), F.col("source_id").alias("neighbor_id")),
    )
    e = edges.select(F.explode(ends).alias("e"), "event_time", "edge_id", "amount").select("e.*", "event_time", "edge_id", "amount")
    groups = e.groupBy("account_id", "direction", "neighbor_id").agg(
        F.array_sort(F.collect_list(F.struct("event_time", "edge_id", "amount"))).alias("items"), F.min(first).alias("first")
    )
    order = Window.partitionBy("account_id", "direction").orderBy("first")
    return groups.select(
        "account_id", "direction", "neighbor_id", F.transform("items", lambda x: x["amount"]).alias("amounts"),
        (F.row_number().over(order) - 1).alias("ordinal"),
    )


def monotonic_violations(edges: DataFrame, arrival: str, stream: str | None = None, block: int = 1 << 20) -> DataFrame:
    """Rows whose (time, edge id) does not exceed that of the row that arrived before.

    stream: a column (partition, topic) within which arrivals are ordered; without it one
    stream holds all rows, which are compared in blocks of `block` rows.
    """
    key = F.struct(F.col("event_time"), F.col("edge_id"))
    if stream:
        w = Window.partitionBy(stream).orderBy(arrival)
        return edges.withColumn("__before", F.lag(key).over(w)).where(F.col("__before") >= key).drop("__before")
    # One order over all rows is compared in blocks; the last row of a block also begins the next.
    at = F.col("__nth")
    rows = with_ordinal(edges, arrival, name="__nth").withColumn("__own", F.floor(at / block))
    last = F.when(at % block == block - 1, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    w = Window.partitionBy("__block").orderBy("__nth")
    found = rows.withColumn("__block", F.explode(last)).withColumn("__before", F.lag(key).over(w))
    return found.where((F.col("__block") == F.col("__own")) & (F.col("__before") >= key)).select(*edges.columns)


def neighbor_sample(edges: DataFrame, seeds: DataFrame, fanouts: tuple[int, ...] = (15, 10)) -> DataFrame:
    """seed_id, hop, node_id, neighbor_id: undirected neighbours, a bounded number each hop.

    The sample is the first by edge id, so it is the same in every engine and run.
    """
    both = edges.select(F.explode(F.array(
        F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbor_id")),
        F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbor_id")),
    )).alias("e"), "edge_id").select("e.*", "edge_id")
    pairs = both.groupBy("node_id", "neighbor_id").agg(F.min("edge_id").alias("edge_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id", "neighbor_id"))).where(F.col("rank") <= max(fanouts))
    frontier = seeds.select(F.col("account_id").alias("seed_id"), F.col("account_id").alias("node_id")).distinct()
    out = None
    for hop, fan in enumerate(fanouts, 1):
        step = frontier.join(ranked.where(F.col("rank") <= fan), "node_id").select("seed_id", F.lit(hop).alias("hop"), "node_id", "neighbor_id")
        out = step if out is None else out.unionByName(step)
        frontier = step.select("seed_id", F.col("neighbor_id").alias("node_id")).distinct()
    return out


def neighborhood_features(edges: DataFrame, features: DataFrame, columns: list[str], rounds: int = 2, fanout: int = 15) -> DataFrame:
    """Features averaged over sampled neighbours, `rounds` times: self and mean of each round."""
    hop = neighbor_sample(edges, features.select("account_id"), (fanout,)).select("node_id", "neighbor_id")
    out = features.select("account_id", *columns)
    now = list(columns)
    for r in range(1, rounds + 1):
        values = out.select(F.col("account_id").alias("neighbor_id"), *now)
        means = hop.join(values, "neighbor_id").groupBy(F.col("node_id").alias("account_id")).agg(
            *[(F.sum(F.col(c).cast("decimal(28,6)")).cast("double") / F.count(F.lit(1))).alias(f"{base}_mean{r}") for c, base in zip(now, columns, strict=True)]
        )
        out = out.join(means, "account_id", "left").fillna(0.0)
        now = [f"{c}_mean{r}" for c in columns]
    return out
