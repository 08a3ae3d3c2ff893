"""Queries against their SQL, near duplicates against all pairs, the pipeline stage by stage."""

import random

import corpus_pipeline
import pytest

from fundweave.llm import mixing, queries, simhash
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLE_SQL[name])


def _sets(text):
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, " "), (2, "one two"), (3, "One  two")]
    for k in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([30, 80, 300]))]
        for c in range(6):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            rows.append((10 + 10 * k + c, " ".join(ws)))
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, component_id string").repartition(3)
    sets = {i: _sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    got = {x.id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in ids}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_large_group_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 64, raising=False)  # several blocks a list
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    base = [r.choice(vocab) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        ws = list(base)
        for at in r.sample(range(300), r.choice([4, 5, 6, 9])):
            ws[at] = r.choice(vocab)
        rows.append((i, " ".join(ws)))
    sets = {i: _sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    want = {i: root(i) for i in sets}
    assert sum(c == 0 for c in want.values()) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.id: x.component_id for x in simhash.near_duplicates(docs).collect()} == want


def test_each_group_keeps_a_document_where_ids_repeat_with_different_texts(spark):
    x, y = "one two three four five six", "red green blue grey black white"
    docs = spark.createDataFrame([(5, x), (5, y), (2, y), (9, x), (7, "alone")], "doc_id long, text string")
    found = {(r.id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(5, 2), (2, 2), (9, 2), (7, 7)}
    kept = {r.doc_id for r in simhash.dedup(docs).collect()}
    assert kept == {c for _, c in found}


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = mixing.staged(stage(spark, docs, oracle.DATA), f"test-{i}")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    again = corpus_pipeline.STAGES[1][1](spark, docs, oracle.DATA)
    assert again.count() == docs.count()  # nothing near is left
    clean = corpus_pipeline.STAGES[2][1](spark, docs, oracle.DATA)
    assert clean.count() == docs.count()
    mixed = mixing.staged(corpus_pipeline.STAGES[3][1](spark, docs, oracle.DATA), "test-mix")
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, oracle.DATA)
    assert ids.count() == mixed.count() and ids.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
