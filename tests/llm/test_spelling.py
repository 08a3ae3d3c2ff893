"""Spelling variants against edit distances of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fundweave.llm import spelling
from fundweave.llm.queries import ORACLE_SQL, op12_spelling
from tests.oracle import compare, connection

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = next((i for i, (x, y) in enumerate(zip(u, v)) if x != y), len(u))  # noqa: B905
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def plain(rows):
    count = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, near_of = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        near_of[w] = len(near)
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n[w], near_of[w], n[form[w]] if form.get(w) else None))
    return sorted(out, key=str)


def made_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abçÉs") for _ in range(rng.randint(4, 7))) for _ in range(25)] + ["Häuser", "hauser", "colour", "color", "colours", "×÷×÷×"]
    rows = [(None, "colour colour"), (1, None), (2, ""), (3, "12 ,;"), (3, "12 ,;"), (4, "Colour COLOUR colöur " * 3)]
    rows += [(5, "nnnnaa " * 3), (6, "nnnnab " * 6 + "nnnncb " * 12)]  # a chain: the first is not near the last
    for i in range(300):
        text = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(words[: rng.randint(1, len(words))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abçE") + w[k:], w[:k] + rng.choice("abçE") + w[k + 1 :]])
            text.append(w)
        rows.append((rng.randint(0, 200), rng.choice([" ", "\n", "-", "2"]).join(text)))
    return rows


@pytest.mark.parametrize("longest", [128, 2])
def test_variants_equal_all_pairs(spark, longest):
    rows = made_rows(longest)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = spelling.variants(docs.repartition(3), longest=longest)
    want = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 10 and ("nnnnaa", "nnnnab", "nnnncb", 3, 1, 6) in want


def test_query_equals_sql(spark):
    compare(spark, connection(), op12_spelling, ORACLE_SQL["op12_spelling"])


@pytest.mark.parametrize("n1, n2", [(1, 4), (1, 7), (2, 3), (3, 1)])
def test_near_multisets_share_a_signature(spark, n1, n2):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        u = "".join(rng.choice("abcdeaaé") for _ in range(rng.randint(5, 9)))
        k = rng.randrange(len(u))
        pairs.append((u, rng.choice([u[:k] + u[k + 1 :], u[:k] + "b" + u[k:], u[:k] + "z" + u[k + 1 :]])))
    words = spark.createDataFrame([(w,) for w in {w for p in pairs for w in p}], "word string")
    rows = {r.word: r for r in spelling.with_signatures(words, n1, n2).collect()}
    assert all(set(rows[u].sigs) & set(rows[v].sigs) for u, v in pairs)
    assert all(((rows[u].mask ^ rows[v].mask) & (1 << 64) - 1).bit_count() <= 2 for u, v in pairs)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("a", "b"), ("c", "b")]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "b" if w in "ac" else "w20" for w, _ in chain}


def test_empty_table_and_ratio(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, ratio=1)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "abcde abcdf " * 300_000)], "doc_id long, text string")
    assert {(r.word, r.n_near) for r in spelling.variants(docs, one_in=10**9).collect()} == {("abcde", 1), ("abcdf", 1)}


def test_lists_give_a_near_pair_in_one_order(spark):
    words = spark.createDataFrame([(w, n) for n, w in enumerate(["house", "mouse", "horse", "houses", "hoses", "table", "tables", "stable"], 1)], "word string, n long")
    found, hot = spelling._by_signature(words, 128)
    pairs = {(r.word, r.near) for r in found.collect()}
    assert hot.count() == 0 and pairs and all(a < b for a, b in pairs)
    both = [(r.word, r.n, r.near, r.near_n) for r in spelling.near_words(words).collect()]
    assert len(both) == len(set(both)) == 2 * len(pairs)
    assert {(a, c) for a, _, c, _ in both} == pairs | {(b, a) for a, b in pairs}
    assert {(a, c) for a, _, c, _ in spelling.near_words(words, 1).select("word", "n", "near", "near_n").collect()} == {(a, c) for a, _, c, _ in both}
