"""Mixing: plans against a plain water-filling, samples near their targets, edges."""

import random
import re

from fundweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int").repartition(3)


def _water(sizes: dict, weights: dict, most: int) -> dict:
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        level = (total - sum(full.values())) / sum(rest.values()) if rest else 0
        over = {s: most * sizes[s] for s, w in rest.items() if w * level > most * sizes[s]}
        if not over:
            return full | {s: w * level for s, w in rest.items()}
        full |= over


def _rows(seed, n):
    r = random.Random(seed)
    names = ["a", "b", "c", "Z", "é", None, "d", "hot"]
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else r.choice(names)
        out.append((i if i % 50 else None, r.choice([None, "", " \t ", "x " * r.randrange(1, 60), "one two　three\x1cfour"]) if i % 7 else "w " * 300, source))
    return out


def test_targets_and_samples(spark):
    rows = _rows(1, 1500) + [(7, "w " * 20, "a")] * 3
    sizes, plan = mixing.mixture(_docs(spark, rows))
    by: dict = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in by if s is not None)) + [None]
    want = _water(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    got = {r.source: r for r in plan.collect()}
    assert {s: r.source_size for s, r in got.items()} == by
    assert all(abs(got[s].target - want[s]) < 1e-6 for s in by)
    taken = [r.asDict() for r in mixing.taken(sizes, plan).collect()]
    assert len(taken) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in taken)
    for s in by:
        assert abs(sum(r["taken"] for r in taken if r["source"] == s) - want[s]) <= 300
    again = mixing.taken(*mixing.mixture(_docs(spark, rows))).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.taken(sizes, plan).collect())


def test_mixed_rows_are_the_plan(spark):
    rows = _rows(2, 300)
    docs = _docs(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = {(r.id, r.source, r.size): r.repeats for r in mixing.taken(*mixing.mixture(docs)).collect() if r.id is not None}
    got: dict = {}
    for r in mixed.where("doc_id is not null").collect():
        k = (r.doc_id, r.source, len(WORD.findall(r.text or "")))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_columns_of_any_name_and_a_very_long_text(spark):
    rows = [(1, "w " * 2_000_000, "a", 1, 2, 3), (2, "w", "a", 1, 2, 3), (3, "x y", "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key int, `__mix_key` int, Mix_Source int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r)[3:] for r in mixed.collect()} == {(1, 2, 3)}
    assert {r.id: r.size for r in mixing.mixture(docs)[0].collect()} == {1: 2_000_000, 2: 1, 3: 2}


def test_weight_table_and_empty(spark):
    docs = _docs(spark, [(1, "a b c d", "x"), (2, "a b", "y"), (3, "a", "z")])
    w = spark.createDataFrame([("x", 1), ("y", 3)], "source string, weight int")
    plan = {r.source: r.target for r in mixing.mixture(docs, weights=w, max_epochs=2)[1].collect()}
    assert plan == {"x": 3.0, "y": 4.0, "z": 0.0}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(_docs(spark, [(1, None, None), (2, "", "x")])).count() == 0
