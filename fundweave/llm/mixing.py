"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source gets a share of a word budget in proportion to its weight. No share exceeds
max_epochs times the source's size; what is cut off is dealt again by weight among the
others until no share is above its cap. A document is then taken whole as often as its
source's target holds the source (whole repetitions), and the rest of the target is a
seeded sample of whole documents (the fractional repetition).

Scale: sources and hash buckets are summed map-side, so a source that holds a third of
all rows is a third of the scan and one row of the sums. The fractional sample is a
threshold on a seeded hash: prefix sums run over 4,096 buckets a source, and only the one
bucket in which the threshold falls is sorted. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_names, like, staged

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_INT = "decimal(20,0)"


def _source_plan(sums: DataFrame, weights: Sequence[int] | DataFrame, max_epochs: int) -> DataFrame:
    """source, source_size -> and target, whole, rest. One row a source."""
    every = Window.partitionBy()
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("int").alias("weight"))
        t = sums.join(w, sums["source"].eqNullSafe(w["_s"]), "left").drop("_s").fillna(0, ["weight"])
    else:
        cycle = F.array(*[F.lit(int(x)) for x in weights])
        at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        t = sums.withColumn("weight", F.get(cycle, F.pmod(at, F.lit(len(weights))).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * max_epochs)
    before = Window.orderBy(
        F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).asc_nulls_last(),
        F.col("source").asc_nulls_last(),
    ).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(every).alias("all"),
        F.sum("weight").over(every).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("w_before"),
    )
    left = (F.col("all") - F.col("cap_before")).cast(_INT)
    full = F.col("cap").cast(_INT) * (F.col("all_w") - F.col("w_before")).cast("decimal(12,0)") <= left * F.col(
        "weight"
    ).cast("decimal(12,0)")
    t = t.withColumn("full", (F.col("weight") > 0) & full)
    t = t.withColumn("full_size", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    t = t.withColumn("full_w", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every))
    level = (F.col("weight").cast("double") * (F.col("all") - F.col("full_size")).cast("double")) / (
        F.col("all_w") - F.col("full_w")
    ).cast("double")
    t = t.withColumn(
        "target",
        F.when(F.col("full"), F.col("cap").cast("double")).when(F.col("weight") > 0, level).otherwise(F.lit(0.0)),
    )
    whole = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs).cast("long")),
    ).otherwise(F.lit(0).cast("long"))
    t = t.withColumn("whole", whole)
    rest = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    return t.select("source", "source_size", "target", "whole", rest.alias("rest"))


def _sample_key(id_col: Column, size: Column, seed: int) -> Column:
    """Seeded order of a document; rows that agree in id and size share it."""
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(md5, F.lpad(size.cast("string"), 15, "0"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] | DataFrame = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): one row a document (id, source, size, key) and one row a source.

    weights: repeated over the sources in code point order (null last), or a table
    (source, weight); a source that table lacks weighs 0. plan: source, source_size,
    target, whole, cut; a document is taken `whole` times, and once more if its key <= cut.

    Null or empty text has size 0. A null source is a source of its own, the last. A null
    id is sampled like any other id. Rows that repeat an id and a size are sampled
    together. An empty table gives two empty tables. Extra columns play no part.
    """
    d = like(docs, id_col, text_col, source_col).toDF("id", "text", "source")
    d = d.select("id", "source", word_count(F.col("text")).alias("size"))
    sizes = staged(d.withColumn("key", _sample_key(F.col("id"), F.col("size"), seed)), "mix-sizes")
    buckets = staged(
        sizes.groupBy("source", F.substring("key", 1, 3).alias("bucket")).agg(F.sum("size").alias("size")),
        "mix-buckets",
    )
    sums = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = _source_plan(sums, weights, max_epochs)
    # The bucket in which the rest of a source's target runs out.
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    b = buckets.withColumn("before", F.sum("size").over(run) - F.col("size"))
    p = plan.withColumnRenamed("source", "_s")
    b = b.join(p, b["source"].eqNullSafe(p["_s"])).where(F.col("before").cast("double") <= F.col("rest"))
    cut = (
        b.groupBy("source")
        .agg(
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("whole").alias("whole"),
            F.first("rest").alias("rest"),
            F.max(F.struct("bucket", "before")).alias("at"),
        )
        .select("source", "source_size", "target", "whole", "rest", "at.bucket", "at.before")
    )
    cut = staged(cut, "mix-cut")
    c = cut.select(F.col("source").alias("_s"), "bucket", "before", "rest")
    near = sizes.withColumn("_b", F.substring("key", 1, 3))
    near = near.join(c, near["source"].eqNullSafe(c["_s"]) & (near["_b"] == c["bucket"]))
    near = near.groupBy("source", "bucket", "key", "before", "rest").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(order))
    fits = (2 * F.col("upto") - F.col("size")).cast("double") <= 2 * F.col("rest")
    last = near.where(fits).groupBy(F.col("source").alias("_s")).agg(F.max("key").alias("last"))
    plan = cut.join(last, cut["source"].eqNullSafe(last["_s"]), "left").select(
        "source", "source_size", "target", "whole",
        F.when(F.col("rest") > 0, F.coalesce("last", "bucket")).alias("cut"),
    )
    return sizes, staged(plan, "mix-plan")


def taken(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """id, source, size, source_size, target, repeats, taken. One row a document."""
    p = plan.withColumnRenamed("source", "_s")
    d = sizes.join(p, sizes["source"].eqNullSafe(p["_s"]))
    repeats = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return d.select(
        "id", "source", "size", "source_size", "target",
        repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] | DataFrame = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The mixed rows of docs, each as often as the mixture takes it, all columns kept.

    See mixture() for null, empty and repeated values. The text stays where it is read:
    the plan, one row a source, is joined to the scan.
    """
    _, plan = mixture(
        docs, id_col=id_col, text_col=text_col, source_col=source_col,
        weights=weights, max_epochs=max_epochs, seed=seed,
    )
    of, whole, cut, key, copy = free_names(docs, "mix_source", "mix_whole", "mix_cut", "mix_key", "mix_copy")
    p = plan.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("cut").alias(cut))
    d = docs.withColumn(key, _sample_key(docs[f"`{id_col}`"], word_count(docs[f"`{text_col}`"]), seed))
    d = d.join(p, d[f"`{source_col}`"].eqNullSafe(F.col(of)))
    repeats = F.col(whole) + F.when(F.col(key) <= F.col(cut), 1).otherwise(0)
    d = d.where(repeats > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), repeats)))
    return d.select(*[d[f"`{c}`"] for c in docs.columns])
