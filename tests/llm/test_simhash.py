"""SimHash fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fundweave.llm import simhash
from fundweave.llm.components import components


def _fingerprint(text, words):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_span_all_pairs_within_the_bound(spark, bits):
    r = random.Random(bits)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for s in seeds[:3]:
        for _ in range(40):
            x = s
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    for _ in range(150):  # one list above the small size
        fps.add(seeds[3] ^ (r.randrange(65536) << 8))
    fps = sorted(fps)
    got = simhash.fingerprint_links(spark.createDataFrame([(_signed(f), i) for i, f in enumerate(fps)], "fp long, node long"), bits)
    links = {(min(a, b), max(a, b)) for a, b in got.collect()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 8 * bits for a, b in links)
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= bits
    assert _roots(range(len(fps)), near) == _roots(range(len(fps)), lambda a, b: (min(a, b), max(a, b)) in links)


def test_documents_equal_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(120)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "a b c"), (6, "A b  C"), (7, "naïve x y z"), (None, base[0]), (None, "alone in the world")]
    i = 10
    for b in base:
        for _ in range(6):
            ws = b.split()
            for _ in range(r.randrange(3)):
                ws[r.randrange(len(ws))] = r.choice("alpha beta".split())
            rows.append((i, " ".join(ws)))
            i += 1
    rows += [(12, base[1]), (12, base[1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted((tuple(x) for x in simhash.simhash_components(docs).collect()), key=str)
    fps = [_fingerprint(t, 3) for _, t in rows]
    ids: dict = {}
    for (doc, _), f in zip(rows, fps, strict=True):
        if doc is not None:
            ids[f] = min(doc, ids.get(f, doc))
    roots = _roots(ids, lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict = {}
    for f, x in roots.items():
        least[x] = min(ids[f], least.get(x, ids[f]))
    want = sorted(((d, _signed(f), least[roots[f]] if f in roots else None) for (d, _), f in zip(rows, fps, strict=True)), key=str)
    assert got == want


def test_a_very_long_text(spark):
    r = random.Random(9)
    text = " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(300_000))
    docs = spark.createDataFrame([(4, text), (9, text + " "), (5, "alpha")], "doc_id long, text string")
    got = {r.id: (r.fp, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got[4] == got[9] == (_signed(_fingerprint(text, 3)), 4)


@pytest.mark.parametrize("shape", ["star", "chain of stars"])
def test_components_of_hubs(spark, shape):
    links = [(0, i) for i in range(1, 3000)] if shape == "star" else [(10_000 * k, 10_000 * k + i) for k in range(5) for i in range(1, 500)] + [(10_000 * k + 7, 10_000 * (k + 1) + 9) for k in range(4)]
    links = [(7_000_000 - a, 7_000_000 - b) for a, b in links]
    got = dict(tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert set(got.values()) == {min(min(x) for x in links)} and len(got) == len({n for x in links for n in x})


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect())
    known = {x for ab in links if None not in ab and ab[0] != ab[1] for x in ab}
    pairs = {frozenset(ab) for ab in links}
    assert got == _roots(known, lambda a, b: frozenset((a, b)) in pairs)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    assert np.array_equal(simhash.shingle_hashes(None, 3), np.zeros(0, np.uint64))
