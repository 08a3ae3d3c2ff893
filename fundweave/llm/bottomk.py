"""MinHash near-dedup over bottom-k sketches of one hash function.

A text's set of word shingles is hashed once; its sketch is the k least hashes. Retained
values are posted to inverted lists, texts that meet in a list are candidates. The k least
values of the union of two sketches estimate the similarity; candidates far below the
threshold go, the others are verified on the whole sets.

What is posted: the gaps of a sketch, that is pairs of retained values next to each other.
Texts that have a single word pair in common, as more and more have in a larger table, share
no gap. Two texts within the similarity have a number of gaps in common at least, so they
meet in a list even if each posts all but that number, less one, of its gaps, those that the
fewest texts have. Gaps that many texts share (those of a passage) are therefore not posted
unless a text has hardly any others. For sets of up to similarity x k shingles the sketch is
the set, and the number is exact; beyond, 14 of 65 gaps are missed by a pair at exactly 0.8
with a probability below 1e-7.

Scale: equal sets are one node. The texts of a list of more than eight are compared with
two leaders a list; what the leaders leave apart is compared block by block on the whole
sets, so that a group of near copies never emits all of its pairs and loses none. The many
lists of such a group have few leaders, and those with the same one are compared as one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .components import components
from .simhash import _ALL_PAIRS_UPTO, _band_pairs, _rest_links, _verify, shingle_hashes
from .staging import join_unique, like, staged

#: Values retained of a set, and those of them that the sketches of two near sets share at least.
RETAINED, LEAST = 64, 32
#: Probability with which a pair at exactly the similarity may have fewer gaps in common.
MISSED = 1e-7
_KEYS = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def sketch_of(text: str | None, words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the whole set of hashes, its k least), ascending as signed integers."""
    whole = np.unique(shingle_hashes(text, words).view(np.int64))
    return whole, whole[:k]


def _key_batches(batches: Iterator[pa.RecordBatch], words: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, 1):
        h1, h2, sizes, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            whole, sketch = sketch_of(text, words, k)
            a, b = np.frombuffer(hashlib.blake2b(whole.tobytes(), digest_size=16).digest(), "<i8").tolist()
            h1.append(a)
            h2.append(b)
            sizes.append(len(whole))
            sketches.append(sketch)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
        flat = pa.array(np.concatenate([*sketches, np.zeros(0, np.int64)]))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (h1, h2, sizes)), pa.ListArray.from_arrays(pa.array(offsets), flat)]
        yield pa.RecordBatch.from_arrays(columns, schema=_KEYS)


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, 1):
        sets = [sketch_of(t, words, 0)[0].tobytes() for t in batch.column(1).to_pylist()]
        h = [np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), "<i8").tolist() for s in sets]
        columns = [pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SETS)


def union_estimate(x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, int]:
    """(values in both, values) among the k least of two sketches' union."""
    union = np.union1d(x, y)[:k]
    return int((np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)).sum()), len(union)


def _estimate(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) -> pairs whose sketches share enough of their union's."""
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            both, n = union_estimate(x, y, k)
            good.append(both * k >= least * n)
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], schema=_PAIRS)


def shared_gaps(similarity: float, k: int) -> int:
    """Gaps that sketches of k values share at least, but for a probability of MISSED.

    Each of the k least values of the union is in both sets with the similarity as its
    probability; a gap is shared where that holds of both its ends. The first value has a
    gap before it.
    """
    common, other = np.ones(1), np.zeros(1)  # by the number of shared gaps so far: the last value is in both, or not
    for _ in range(k):
        common, other = np.append(0, similarity * common) + np.append(similarity * other, 0), np.append((1 - similarity) * (common + other), 0)
    return max(1, int((np.cumsum(common + other) < MISSED).sum()))


def shared_gaps_of_sets(n: int, similarity: float) -> int:
    """Gaps that a set of n values shares at least with any set within the similarity, if both are held whole.

    A value that only one of the sets has breaks one gap between those that both have.
    """
    unions = range(n, math.floor(n / similarity) + 1)
    return max(1, min(u + 1 - 2 * (u - math.ceil(similarity * u)) for u in unions))


def _gaps(k: int) -> Column:
    """A hash of each gap of a sketch: before its first value, between values, and behind the last one of a set held whole."""
    none = F.array(F.lit(None).cast("long"))
    every = F.zip_with(F.concat(none, "sketch"), F.concat("sketch", none), lambda a, b: F.xxhash64(a, a.isNull(), b))
    return F.slice(every, F.lit(1), F.size("sketch") + (F.col("size") <= k).cast("int"))


def _posted(nodes: DataFrame, similarity: float, k: int) -> DataFrame:
    """(node, value): the rarest gaps of each node, as many as guarantee a meeting."""
    whole = math.floor(similarity * k)
    exact = F.array(*[F.lit(shared_gaps_of_sets(n, similarity)) for n in range(1, whole + 1)])
    need = F.when(F.col("size") <= whole, F.get(exact, F.col("size").cast("int") - 1)).otherwise(F.lit(shared_gaps(similarity, k)))
    every = nodes.select("node", need.alias("need"), _gaps(k).alias("gaps"))
    every = every.select("node", F.size("gaps").alias("held"), (F.size("gaps") - F.col("need") + 1).alias("most"), F.explode("gaps").alias("value"))
    shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(shared.withColumn("df", F.col("n")), "sketch-values")
    rows = nodes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    of = join_unique(every, shared, ["value"], rows).groupBy("node", "held", "most")
    # At most k + 1 gaps a node; those that no other node has are its rarest, and lead nowhere.
    ranked = of.agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("l"))
    post = F.greatest(F.col("most") - (F.col("held") - F.size("l")), F.lit(0)).cast("int")
    return ranked.select("node", F.explode(F.slice("l", F.lit(1), post)).alias("v")).select("node", F.col("v.value").alias("value"))


def _whole_sets(d: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the asked nodes, from the texts of their first ids."""
    # The lists of ids in both joins with the texts grow with the table: never broadcast.
    ids = asked.select("first_id").distinct()
    texts = d.join(ids.hint("merge"), d["id"] == ids["first_id"], "left_semi")
    sets = texts.mapInArrow(partial(_set_batches, words=words), "h1 long, h2 long, shingles binary")
    return sets.join(asked.hint("merge"), ["h1", "h2"]).select("node", "shingles").dropDuplicates(["node"])


def _lists(posted: DataFrame) -> DataFrame:
    """(band, key, node, n, low, high) of the lists of two and more nodes; low and high lead.

    The order of the leaders is one for all lists, so that the many lists of a group have few leaders.
    """
    posted = staged(posted, "sketch-posted")
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    lists = posted.groupBy("value").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("low"), F.max(order).alias("high")).where("rows > 1")
    lists = staged(lists.withColumn("n", F.col("rows")), "sketch-lists")
    at = join_unique(posted, lists, ["value"], posted.count(), "rows")
    return at.select(F.lit(0).alias("band"), F.col("value").alias("key"), "node", "n", "low", "high")


def _merged(at: DataFrame) -> DataFrame:
    """(band, key, node, n) of the long lists, those with the same low leader as one list of band 1.

    A text that stands in many lists of a group of near copies stands once in the merged
    one. Lists are merged only where that makes no more pairs than they have by themselves,
    as leaders may also stand in lists that have nothing else in common.
    """
    long = at.where(F.col("n") > _ALL_PAIRS_UPTO).select("key", "node", F.col("low.node").alias("lead"), "n")
    once = staged(long.groupBy("lead", "node").agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("pairs")), "sketch-merged")
    leads = once.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum("lists").alias("rows"), F.sum("pairs").alias("pairs"))
    leads = staged(leads.select("lead", "n", "rows", (F.col("n") * F.col("n") <= F.col("pairs")).alias("one")), "sketch-leads")
    merged = leads.where("one").select("lead", "n", F.col("n").alias("of"))
    merged = join_unique(once.select("lead", "node"), merged, ["lead"], once.count())
    apart = join_unique(long, leads.where("not one").select("lead", "rows"), ["lead"], at.count(), "rows")
    return merged.select(F.lit(1).alias("band"), F.col("lead").alias("key"), "node", F.col("of").alias("n")).unionByName(
        apart.select(F.lit(0).alias("band"), "key", "node", "n")
    )


def near_sets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, k: int = RETAINED, least: int = LEAST
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Texts whose sets of word shingles have a Jaccard similarity of at least `similarity` are
    linked; component_id is the least id reachable, its own included. A text of fewer words
    is one shingle. Null, empty and blank texts have the empty set, which is linked with
    nothing: their component is their own id. Repeated rows each return a row. A row with a
    null id links nothing; its component is that of its set, or null where no row with an
    id has it. An empty table gives no rows; other columns play no part.
    """
    d = like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    keys = d.mapInArrow(partial(_key_batches, words=words, k=k), "id long, h1 long, h2 long, size long, sketch array<long>")
    keys = staged(keys, "sketches")
    sets = keys.where("size > 0").groupBy("h1", "h2")
    copies = sets.agg(F.min("id").alias("first_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"))
    # Written before use, so that the numbers stay as they are.
    nodes = staged(copies.where("first_id is not null").withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    at = staged(_lists(_posted(nodes, similarity, k)), "sketch-meetings")
    pairs = _band_pairs(at).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    sketches = nodes.select("node", "sketch")
    x = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")).hint("merge"), "a")
    x = x.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    likely = staged(x.mapInArrow(partial(_estimate, k=k, least=least), "a long, b long"), "sketch-pairs")
    asked = likely.select(F.explode(F.array("a", "b")).alias("node")).unionByName(at.where(F.col("n") > _ALL_PAIRS_UPTO).select("node")).distinct()
    asked = staged(nodes.join(asked.hint("merge"), "node").select("node", "h1", "h2", "first_id"), "sketch-asked")
    whole = staged(_whole_sets(d, asked, words), "sketch-sets")
    v = likely.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    v = v.join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    stars = staged(components(v.mapInArrow(partial(_verify, similarity=similarity), "a long, b long")), "sketch-stars")
    rest = _rest_links(staged(_merged(at), "sketch-groups"), whole, stars, similarity)
    of = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    classes = staged(nodes.join(of, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("class"), "first_id", "n"), "sketch-classes")
    least_id = staged(classes.groupBy("class").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "sketch-components")
    classes = join_unique(classes, least_id, ["class"], classes.count(), "rows").select("h1", "h2", "component_id", "n")
    linked = keys.where("size > 0").select("id", "h1", "h2", F.col("size").alias("n_shingles"))
    out = join_unique(linked, staged(classes, "sketch-ids"), ["h1", "h2"], keys.count()).select("id", "n_shingles", "component_id")
    nameless = keys.where("size > 0 and id is null").join(nodes.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    alone = keys.where("size = 0").select("id", "size").unionByName(nameless.select("id", "size"))
    return out.unionByName(alone.select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id")))
