"""Multi-index search: exact scores and order, recall against brute force, traversal order."""

import math

import numpy as np
import pyarrow as pa
import pytest

from fundweave.llm import ann


def _brute(rows, k, every):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            found = sorted((-ann.cosine(a, b), i) for i, b in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def _got(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100] = x[150] = x[151] = x[2]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(5000, None), (5010, []), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32), (None, x[3].tolist()), (5200, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cells int").repartition(4)
    got, want = _got(ann.search(df, codes=16, block_rows=500)), _brute([(i, v) for i, v in rows if v is None or len(v) != 2], 5, 50)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9  # the share visited follows from the sample
    score = {q: dict(w) for q, w in want.items()}
    for q, found in got.items():
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(score[q].get(i, s) == s for i, s in found)
    assert [i for i, _ in got[100]][:3] == [2, 150, 151]
    whole = _got(ann.search(df, codes=16, block_rows=500, visit=1.0))
    assert whole == want


@pytest.mark.parametrize("n", [0, 1, 3, 12])
def test_few_rows(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 50, v) for i, v in enumerate(rng.normal(size=(n, 4)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert _got(ann.search(df, visit=1.0)) == {q: w for q, w in _brute(rows, 5, 50).items() if w}


@pytest.mark.parametrize("visit", [None, 1.0])
def test_one_component(spark, visit):
    rows = [(i * 25, [float(v)]) for i, v in enumerate([3, -1, 2, 0.5, -4, 9, 0])] + [(175, [5.0]), (200, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q: sorted(v) for q, v in _got(ann.search(df, visit=visit)).items()}
    ok = [(i, v[0]) for i, v in rows if v[0]]
    want: dict = {}
    for q, a in set(ok):
        if q % 50 == 0:
            want.setdefault(q, set()).update((i, 1.0 if a * b > 0 else -1.0) for i, b in set(ok) if i != q)
    assert got == {q: sorted(sorted(v, key=lambda x: (-x[1], x[0]))[:5]) for q, v in want.items()}


def test_ties_of_any_number_go_to_the_smaller_ids(spark):
    """Forty copies of one direction in different lengths, in no order, and fifty at one angle."""
    direction = np.array([1.0, 2.0, -1.0, 0.5])
    rows = [(i, (direction * 2.0 ** (i % 11)).tolist()) for i in range(1, 41)] + [(100, direction.tolist())]
    rows += [(150, [0.0, 0.0, 0.0, -3.0])] + [(200 + i, [0.0, 0.0, float(2**i), 0.0]) for i in range(0, 49)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").orderBy("embedding").repartition(3)
    got = _got(ann.search(df, visit=1.0, block_rows=30))
    assert got == _brute(rows, 5, 50)
    assert [i for i, _ in got[100]] == [1, 2, 3, 4, 5]


def test_very_long_and_very_short_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 10.0 ** float(p)).tolist()) for i, p in zip(range(0, 300, 5), [-310, -200, 0, 154, 200, 307] * 10, strict=True)]
    rows += [(1000, [5e-324] * 6), (1005, [1e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = _got(ann.search(df, visit=1.0))
    assert got == _brute(rows, 5, 50)
    assert got[1000][0] == (1005, pytest.approx(1.0, abs=1e-15))
    a, b = np.array([1e-200, 2e-200]), np.array([2e-200, 1e-200])
    assert ann.cosine(a, b) == ann.cosine(a * 2.0**900, b) == pytest.approx(0.8)
    assert ann.cosine(np.full(40, 1e154), np.full(40, 1e200)) == pytest.approx(1.0)


def test_only_visited_cells_are_searched():
    rng = np.random.default_rng(3)
    x = ann._unit(rng.normal(size=(60, 4)))
    cell = np.repeat(np.arange(6, dtype=np.int32), 10)
    ready = ann._by_cell([([[i] for i in range(60)], x, cell)])
    visited = pa.array([[1, 4], [0], []], pa.list_(pa.int32()))
    found = ann._best([100, 101, 102], x[[15, 3, 7]], visited, ready, 5).to_pydict()
    for query, row, cells in ((100, 15, [1, 4]), (101, 3, [0])):
        inside = np.flatnonzero(np.isin(cell, cells))
        want = sorted(((-ann.cosine(x[row], x[i]), i) for i in inside))[:5]
        assert [v for q, v in zip(found["query_id"], found["vec_id"], strict=True) if q == query] == [i for _, i in want]
    assert 102 not in found["query_id"]


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    left, right = rng.random(7), rng.random(5)
    order = ann.traverse(left, right, np.ones(35, np.int64), 35)
    assert order == np.argsort((left[:, None] + right[None]).ravel()).tolist()
    assert len(ann.traverse(left, right, np.ones(35, np.int64), 4)) == 4


def test_packing_splits_large_cells():
    first, many, blocks = ann.pack(np.array([3, 0, 4, 25, 2, 9, 1]), 10)
    assert blocks == 6 and many.tolist() == [1, 1, 1, 3, 1, 1, 1] and first.tolist() == [0, 0, 0, 1, 4, 5, 5]
