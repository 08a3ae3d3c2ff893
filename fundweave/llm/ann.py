"""Approximate nearest neighbours by cosine with an inverted multi-index.

Normalised vectors are cut in two halves and each half is quantised by a codebook of its
own, so that a vector's cell is a pair of centroids. A query walks the pairs in the order
of its summed distances to both centroids, with a heap (multi-sequence traversal), until
the cells passed hold a given share of all vectors; what they hold is reranked exactly.

Scale: the codebooks are fitted on a bounded sample; every vector is indexed. Equal vectors
are indexed once with their least ids, of which a query needs no more than k + 1. Cells are
packed into blocks of at most block_rows vectors, a larger cell being split; a task holds
one block and streams the queries that visit it: each cell is multiplied with the queries
that visit that cell, so that cells not visited cost nothing, and each query returns its
best k of the block. The share visited is the least at which vectors of the fitted sample
find their true neighbours. A share, not a number, of vectors is visited, so the work of a
query grows with the table: vectors without structure do not allow less.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import like, staged

_SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Codebooks(NamedTuple):
    left: np.ndarray
    right: np.ndarray


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm; a centroid without points stays where it was."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cells_of(x: np.ndarray, books: Codebooks) -> np.ndarray:
    half = books.left.shape[1]
    x = _unit(x)
    return _distances(x[:, :half], books.left).argmin(1) * len(books.right) + _distances(x[:, half:], books.right).argmin(1)


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, need: int) -> list[int]:
    """Cells in the order of left[i] + right[j], until they hold `need` vectors."""
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[by_left].tolist(), right[by_right].tolist()
    at_left, at_right, n = by_left.tolist(), by_right.tolist(), len(right)
    heap, seen, out, have = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and have < need:
        _, i, j = heapq.heappop(heap)
        cell = at_left[i] * n + at_right[j]
        if sizes[cell]:
            out.append(cell)
            have += int(sizes[cell])
        for x in ((i + 1, j), (i, j + 1)):
            if x[0] < len(a) and x[1] < len(b) and x not in seen:
                seen.add(x)
                heapq.heappush(heap, (a[x[0]] + b[x[1]], *x))
    return out


def pack(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each cell, and how many blocks there are."""
    first, many = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > block_rows:
            block += held > 0
            first[cell], many[cell] = block, -(-n // block_rows)
            block, held = block + int(many[cell]), 0
            continue
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[cell], held = block, held + n
    return first, many, block + (held > 0)


def _assign(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell = cells_of(_matrix(batch.column(1), dim), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["ids", "vector", "cell"])


def _probe(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int, sizes: np.ndarray, need: int, first: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each query and block it visits, with the cells it visits there."""
    half = dim // 2
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(_matrix(batch.column(1), dim))
        left, right = _distances(x[:, :half], books.left), _distances(x[:, half:], books.right)
        row, block, cells = [], [], []
        for i in range(batch.num_rows):
            by_block: dict[int, list[int]] = {}
            for c in traverse(left[i], right[i], sizes, need):
                for k in range(int(many[c])):
                    by_block.setdefault(int(first[c]) + k, []).append(c)
            row += [i] * len(by_block)
            block += by_block
            cells += by_block.values()
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(cells, pa.list_(pa.int32()))],
            names=["block", "query_id", "vector", "cells"],
        )


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1): exact, and its cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _length(a: np.ndarray) -> float:
    return math.sqrt(math.fsum((a * a).tolist()))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision; sums are rounded once, so the order of components is none. No finite vectors are too long or too short."""
    a, b = _scaled(a), _scaled(b)
    return math.fsum((a * b).tolist()) / (_length(a) * _length(b))


def _score(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sorted by block, entries before queries -> each query's best k of the cells it visits there."""
    block, parts, ready = None, [], None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for s, e in zip(edges, edges[1:], strict=False):
            if s == e:
                continue
            part = batch.slice(s, e - s)
            if blocks[s] != block:
                block, parts, ready = blocks[s], [], None
            is_query = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n = int((~is_query).sum())
            if n:
                parts.append((part.column(3).slice(0, n).to_pylist(), _matrix(part.column(4).slice(0, n), dim), part.column(5).slice(0, n).flatten().to_numpy()))
            if n == len(part) or not parts:
                continue
            ready = ready or _by_cell(parts)
            q = part.slice(n)
            for i in range(0, q.num_rows, 1024):
                some = q.slice(i, 1024)
                yield _best(some.column(2).to_pylist(), _matrix(some.column(4), dim), some.column(5), ready, k)


def _by_cell(parts: list[tuple]) -> tuple:
    """(ids, vectors, unit vectors, cells, starts of the cells), sorted by cell."""
    cell = np.concatenate([p[2] for p in parts])
    order = np.argsort(cell, kind="stable")
    every = sum((p[0] for p in parts), [])
    x = np.concatenate([p[1] for p in parts])[order]
    cells, starts = np.unique(cell[order], return_index=True)
    return [every[i] for i in order.tolist()], x, _unit(x), cells, np.append(starts, len(x))


def _best(query_ids: list[int], queries: np.ndarray, visited: pa.ListArray, ready: tuple, k: int) -> pa.RecordBatch:
    """Multiplies each cell with the queries that visit it alone, keeping what may be among each query's nearest.

    That is every entry not below the (k + 1)-th score (one may be the query itself), however
    many are as near as that; products differ from the exact scores by far less than 1e-9.
    The block bounds them.
    """
    ids, x, unit, cells, starts = ready
    q = _unit(queries)
    top = np.full((len(q), k + 1), -np.inf)
    rows_of, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    wanted = np.searchsorted(cells, visited.flatten().to_numpy())
    of = np.repeat(np.arange(len(q)), np.diff(visited.offsets.to_numpy()))
    order = np.argsort(wanted, kind="stable")
    bounds = np.searchsorted(wanted[order], np.arange(len(cells) + 1))
    for c in range(len(cells)):
        rows = of[order[bounds[c] : bounds[c + 1]]]
        if not len(rows):
            continue
        near = q[rows] @ unit[starts[c] : starts[c + 1]].T
        better = near.max(1) >= top[rows].min(1) - 1e-9
        rows, near = rows[better], near[better]
        top[rows] = -np.partition(-np.concatenate([top[rows], near], 1), k, axis=1)[:, : k + 1]
        r, e = np.nonzero(near >= top[rows].min(1)[:, None] - 1e-9)
        rows_of.append(rows[r])
        places.append(starts[c] + e)
        scores.append(near[r, e])
    row, place, score = np.concatenate(rows_of), np.concatenate(places), np.concatenate(scores)
    kept = score >= top.min(1)[row] - 1e-9
    order = np.argsort(row[kept], kind="stable")
    row, place = row[kept][order], place[kept][order]
    # Each vector is scaled and measured once.
    used, place = np.unique(place, return_inverse=True)
    entries, asked = _scaled(x[used]), _scaled(queries)
    lengths, own = [_length(v) for v in entries], [_length(v) for v in asked]
    out = []
    bounds = np.searchsorted(row, np.arange(len(q) + 1))
    for j, query in enumerate(query_ids):
        found = []
        at = place[bounds[j] : bounds[j + 1]]
        for t, products in zip(at.tolist(), (asked[j] * entries[at]).tolist(), strict=True):
            exact = math.fsum(products) / (own[j] * lengths[t])
            found += [(-exact, v) for v in ids[used[t]] if v != query]
        out += [(query, v, -s) for s, v in sorted(found)[:k]]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)


def visit_share(x: np.ndarray, books: Codebooks, *, recall: float, k: int = 5, asked: int = 400, seed: int = 42) -> float:
    """The share of all vectors that must be visited to pass `recall` of the k nearest of some of the sample.

    Each of `asked` vectors of the sample is compared with all of it; for each of its true
    neighbours the share visited up to the end of the neighbour's cell is noted.
    """
    if len(x) <= k + 1:
        return 1.0
    half, cell = books.left.shape[1], cells_of(x, books)
    sizes = np.bincount(cell, minlength=len(books.left) * len(books.right))
    chosen = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
    shares = []
    for i in range(0, len(chosen), 100):
        rows = chosen[i : i + 100]
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        true = np.argpartition(-near, k - 1, axis=1)[:, :k]
        left, right = _distances(x[rows, :half], books.left), _distances(x[rows, half:], books.right)
        for r in range(len(rows)):
            order = np.argsort((left[r][:, None] + right[r][None]).ravel(), kind="stable")
            passed = np.zeros(len(sizes))
            passed[order] = np.cumsum(sizes[order])
            shares += (passed[cell[true[r]]] / len(x)).tolist()
    return float(np.quantile(shares, recall))


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 50,
    k: int = 5,
    codes: int = 32,
    visit: float | None = None,
    recall: float = 0.98,
    sample_rows: int = 20_000,
    block_rows: int = 4096,
    seed: int = 42,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Queries are the rows whose id is divisible by query_every; candidates all rows but the
    query's own id; ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id, nor vectors of another
    length than most have. visit: the share of the vectors that a query's cells hold; if
    not given, the least at which some of the fitted sample find `recall` of their true
    neighbours in the sample. An id that repeats is several candidates, and a query once for
    each different vector; equal results of theirs are listed once. Fewer candidates than
    k are all returned. An empty table gives no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    v = like(vectors, id_col, vector_col).toDF("id", "vector").select(F.col("id").cast("long"), "vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    dims = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return nothing
    dim = dims.d
    v = v.where(F.size("vector") == dim)
    # Of equal vectors only the k + 1 least ids can be among anyone's nearest.
    least = Window.partitionBy("vector").orderBy("id")
    few = v.distinct().withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
    distinct = staged(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "vector"), "ann-vectors")
    sample = distinct.orderBy(F.xxhash64("vector", F.lit(seed)), F.col("ids")[0]).limit(sample_rows).select("vector").toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks(), dim))
    books = Codebooks(kmeans(x[:, : dim // 2], codes, seed), kmeans(x[:, dim // 2 :], codes, seed + 1))
    visit = visit_share(x, books, recall=recall, k=k, seed=seed) if visit is None else visit
    kind = dict(distinct.dtypes)["vector"]
    entries = staged(distinct.mapInArrow(partial(_assign, books=books, dim=dim), f"ids array<long>, vector {kind}, cell int"), "ann-cells")
    sizes = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row a cell at most
        sizes[r.cell] = r["count"]
    total = int(sizes.sum())
    need = min(total, max(math.ceil(visit * total), 4 * (k + 1)))
    first, many, blocks = pack(sizes, block_rows)
    queries = v.where(F.col("id") % query_every == 0).distinct()
    probes = queries.mapInArrow(
        partial(_probe, books=books, dim=dim, sizes=sizes, need=need, first=first, many=many),
        f"block long, query_id long, vector {kind}, cells array<int>",
    )
    # A row a cell at most.
    place = spark.createDataFrame([(int(c), int(first[c]), int(many[c])) for c in np.flatnonzero(sizes)], "cell int, first long, many long")
    held = entries.join(F.broadcast(place), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vector"), F.col("many")))
    rows = held.select("block", F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("query_id"), "ids", "vector", F.array("cell").alias("cells"))
    rows = rows.unionByName(probes.select("block", F.lit(True).alias("is_query"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "vector", "cells"))
    dealt = rows.repartition(max(1, blocks), "block").sortWithinPartitions("block", "is_query")
    found = dealt.mapInArrow(partial(_score, dim=dim, k=k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
