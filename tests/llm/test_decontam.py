"""Decontamination against every window looked up in every text."""

import random
import re

import pytest

from fundweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(t):
    return WORD.findall((t or "").translate(LOWER))


def _brute(text, items, n):
    ws, hit, found = _words(text), set(), set()
    for item, t in items:
        b = _words(t)
        size = min(n, len(b))
        for i in range(len(b) - size + 1 if size else 0):
            for j in range(len(ws) - size + 1):
                if ws[j : j + size] == b[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(item)
    return len(ws), len(hit), sorted(found)


def _data(spark):
    r = random.Random(3)
    vocab = "alpha Beta gamma Délta eps zeta 42".split()
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 10, 14, 25]))) for i in range(12)] + [(None, "null item words here now"), (5, None), (6, "x y z"), (6, "x y z"), (20, "!!!")]
    docs = [None, "", "ÉALPHA beta", "x-y Z", "null item WORDS here now"] + [text(r.randrange(60)) for _ in range(60)]
    docs += [text(5) + " " + (items[i % 12][1] or "") + " " + text(5) for i in range(24)]
    rows = [(i if i % 11 else None, t, [1]) for i, t in enumerate(docs)] + [(3, docs[3], [1])] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string, items array<int>").repartition(3), bench


@pytest.mark.parametrize("limit", [16 << 20, 3000])
def test_documents_equal_brute_force(spark, limit):
    rows, items, docs, bench = _data(spark)
    got = decontam.contamination(docs, bench, n=4, held_bytes=limit).collect()
    got = sorted(((r.doc_id, r["__n_words"], r["__n_hit"], list(r["__items"])) for r in got), key=str)
    assert got == sorted(((i, *_brute(t, items, 4)) for i, t, _ in rows), key=str)
    assert (decontam._blocks(bench.where("text is not null"), 4, limit) > 1) == (limit == 3000)


def test_removal_of_documents_and_spans(spark):
    _, items, docs, bench = _data(spark)
    kept = decontam.decontaminate(docs, bench, n=4)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cut = decontam.decontaminate(docs, bench, n=4, remove="spans")
    assert cut.count() == docs.count()
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Keep ÉÉ: one, TWO\nthree four! rest"), (2, None)], "doc_id long, text string")
    assert [r.text for r in decontam.decontaminate(d, b, n=4, remove="spans").orderBy("doc_id").collect()] == ["Keep ÉÉ: ! rest", None]


@pytest.mark.parametrize("limit", [16 << 20, 400])
def test_columns_that_have_the_names_of_new_ones(spark, limit):
    b = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight nine")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x one two THREE four y", 7, 8, 9, "k"), (2, "other", 7, 8, 9, "k")], "doc_id long, text string, __hits int, __N_Words int, ___x int, key string")
    kept = decontam.decontaminate(d, b, n=4, held_bytes=limit)
    assert [tuple(r) for r in kept.collect()] == [(2, "other", 7, 8, 9, "k")] and kept.columns == d.columns
    cut = decontam.decontaminate(d, b, n=4, remove="spans", held_bytes=limit)
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "x  y", 7, 8, 9, "k"), (2, "other", 7, 8, 9, "k")]
    found = decontam.contamination(d, b, n=4, held_bytes=limit)
    assert sorted((r.doc_id, r["__n_words"], r["__n_hit"], r.key) for r in found.collect()) == [(1, 6, 4, "k"), (2, 1, 0, "k")]


def test_a_very_long_text(spark):
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    text = " ".join(["word one two"] * 400_000 + ["one two three four"] * 3)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontam.contamination(d, b, n=4).first()
    assert (r["__n_words"], r["__n_hit"], list(r["__items"])) == (1_200_012, 12, [1])


def test_empty_tables(spark):
    _, _, docs, bench = _data(spark)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("__n_hit > 0").count() == 0
