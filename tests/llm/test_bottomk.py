"""Bottom-k near-dedup against the similarity of all pairs of sets."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundweave.llm import bottomk, staging
from fundweave.llm.queries import ORACLE_SQL, op13_minhash
from tests.oracle import compare, connection


def shingle_set(text, words):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    ws = [w for w in ws if w]
    return {" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)} or ({" ".join(ws)} if ws else set())


def plain(rows, words, similarity):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and len(a & b) >= similarity * len(a | b):
                label[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    of = {frozenset(s): least[root(x)] for x, (i, s) in enumerate(sets) if i is not None and s}
    return sorted([(i, len(s), of.get(frozenset(s)) if s else i) for i, s in sets], key=str)


def check(spark, rows, words=2, similarity=0.8, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    got = bottomk.near_sets(docs.repartition(3), words=words, similarity=similarity, **options)
    assert sorted(map(tuple, got.select("id", "n_shingles", "component_id").collect()), key=str) == plain(rows, words, similarity)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_edge_cases(spark):
    rows = [
        (9, None), (8, ""), (7, " \t\n"), (6, "One"), (5, "one"), (4, "one two"), (3, "ONE  two"), (2, "x y z v w"), (2, "x y z v w"), (1, "x y z v w u"),
        (None, "one two"), (None, "only here"), (None, None), (11, "a b c d e f"), (12, "b c d e f g"), (10, "A b c d e f"),
    ]
    check(spark, rows)
    check(spark, [])


def test_an_id_with_two_texts(spark):
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(1)
    check(spark, [(5, " ".join(base)), (5, "quite another text of words"), (2, edited(rng, base, 3)), (3, "quite another text of words")])


def test_groups_passages_and_copies_equal_all_pairs(spark):
    """A group of copies that are near their base but not always each other, and a passage in many texts."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, rng.choice([2, 6, 14, 16]))) for i in range(150)]
    passage = [f"p{i}" for i in range(200)]
    rows += [(200 + i, " ".join(passage + [f"o{i}-{k}" for k in range(rng.choice([15, 25, 60, 200]))])) for i in range(120)]
    rows += [(400 + i, " ".join(f"s{rng.randrange(12)}" for _ in range(rng.randint(1, 6)))) for i in range(100)]
    rows += [(600 + i, rows[rng.randrange(300)][1]) for i in range(30)]
    rng.shuffle(rows)
    check(spark, rows)


def test_borderline_pairs_of_long_texts_are_found(spark):
    """Pairs of 1,000 shingles and more at a similarity of 0.8 exactly, and just below."""
    rows = []
    for p in range(60):
        common = [f"c{p}-{i}" for i in range(801)]
        ends = (100, 100) if p % 2 else (100, 101)
        for side, n in enumerate(ends):
            rows.append((2 * p + side, " ".join(common + [f"{side}-{p}-{i}" for i in range(n)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in bottomk.near_sets(docs, words=2).collect()}
    assert got == {d: (d - d % 2 if (d // 2) % 2 else d) for d, _ in rows}


@pytest.mark.parametrize("words, similarity", [(5, 0.8), (1, 0.9)])
def test_other_parameters(spark, words, similarity):
    rng = random.Random(words)
    base = [f"w{i}" for i in range(150)]
    check(spark, [(i, edited(rng, base[: rng.choice([20, 150])], rng.randint(0, 8))) for i in range(80)], words, similarity)


def lists_of(spark, rows):
    """(rows of the lists, rows of the merged long lists) of near_sets() at 0.8 and two words."""
    docs = spark.createDataFrame(rows, "id long, text string")
    keys = docs.mapInArrow(partial(bottomk._key_batches, words=2, k=64), "id long, h1 long, h2 long, size long, sketch array<long>")
    nodes = keys.select(F.col("id").alias("node"), "size", "sketch")
    at = staging.staged(bottomk._lists(bottomk._posted(nodes, 0.8, 64)), "test-meetings")
    return at, bottomk._merged(at)


def test_texts_that_share_word_pairs_alone_do_not_meet(spark):
    """Most word pairs of a text are in others as well; no two texts are near each other."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(200))) for i in range(400)]
    at, _ = lists_of(spark, rows)
    assert at.count() < 2 * len(rows)  # lists of single values have more than 20 rows a text
    check(spark, rows)


def test_a_group_of_near_copies_is_compared_once(spark):
    """A text stands in some thirty lists of its group, and in a few merged ones that lose no pair."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, rng.choice([6, 10, 14]))) for i in range(200)]
    at, merged = lists_of(spark, rows)
    lists = at.where("n > 8").count()
    assert lists > 20 * len(rows) and merged.count() * 3 < lists
    where = {}
    for r in merged.collect():
        where.setdefault(r.node, set()).add((r.band, r.key))
    met = {}
    for r in at.where("n > 8").collect():
        met.setdefault(r.key, []).append(r.node)
    assert all(where[a] & where[b] for nodes in met.values() for a in nodes for b in nodes)
    check(spark, rows)


def test_lists_that_share_a_leader_alone_stay_apart(spark):
    """Node 0 leads two lists that have no other text in common."""
    order = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("node"))
    at = spark.range(40).select(F.explode(F.array(F.col("id") + 1, F.when(F.col("id") % 20 == 0, F.lit(0)))).alias("node"), F.when(F.col("id") < 20, 7).otherwise(8).cast("long").alias("key"))
    at = at.where("node is not null").withColumns({"n": F.lit(21), "low": order})
    got = bottomk._merged(at).collect()
    assert sorted((r.band, r.key, r.node) for r in got) == sorted([(0, 7, 0), (0, 8, 0), *((0, 7 if i < 20 else 8, i + 1) for i in range(40))])


def test_gaps_of_small_sets_are_a_bound():
    """No two sets within 0.8 share fewer gaps than they are said to."""
    gaps = lambda x: set(zip([None, *sorted(x)], [*sorted(x), None], strict=True))
    rng = random.Random(5)
    for _ in range(3000):
        x = set(rng.sample(range(60), rng.randint(1, 40)))
        y = (x - set(rng.sample(sorted(x), rng.randint(0, len(x) // 8)))) | set(rng.sample(range(60), rng.randint(0, 5)))
        if len(x & y) >= 0.8 * len(x | y):
            assert len(gaps(x) & gaps(y)) >= max(bottomk.shared_gaps_of_sets(len(s), 0.8) for s in (x, y))
    assert bottomk.shared_gaps(0.8, 64) == 14


def test_query_equals_sql(spark):
    compare(spark, connection(), op13_minhash, ORACLE_SQL["op13_minhash"])


def test_estimate_of_sketches():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = (np.unique(rng.integers(0, 400, 200)) for _ in "ab")
        both, n = bottomk.union_estimate(x[:64], y[:64], 64)
        union = sorted(set(x) | set(y))[:64]
        assert (both, n) == (sum(v in x and v in y for v in union), 64)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(400_000))
    got = bottomk.near_sets(spark.createDataFrame([(2, text), (1, text + " end")], "doc_id long, text string"), words=2)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 50_001, 1), (2, 50_000, 1)]
