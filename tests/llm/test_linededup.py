"""Line dedup against a plain version, over many and few partitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fundweave.llm import linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def _brute(rows):
    docs: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(_key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [len(_key(x)) < 10 or min(docs[_key(x)], key=lambda d: (d is None, d or 0)) == i for x in lines]
        kept = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        out.append((i, len(lines), keep.count(False), kept))
    return sorted(out, key=str)


def _zeros(keep, n):
    return int((np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n) == 0).sum())


def _rows(seed):
    r = random.Random(seed)
    pool = ["the common line here", " The Common LINE here\t", "short", "éééééééééé", "ééééééééé", "x" * 40, "another line of text", "\r"] + [f"rare line number {i}" for i in range(40)]
    rows = [(i, None if i % 13 == 0 else "\n".join(r.choice(pool) for _ in range(r.randrange(8)))) for i in range(120)]
    rows += [(None, "the common line here\nnull line of its own"), (None, "null line of its own"), (5, "the common line here"), (5, "the common line here"), (130, "a\n" * 50_000 + "the common line here")]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_documents_equal_the_plain_version(spark, partitions):
    rows = _rows(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        names = ["doc_id", "text", "keep", "doc", "row", "n_dropped", "_doc", "c0"]
        docs = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6) for x in rows], "doc_id long, text string" + "".join(f", {n} int" for n in names[2:])).repartition(partitions)
        got = sorted((tuple(x) for x in linededup.kept_texts(docs).collect()), key=str)
        assert got == _brute(rows)
        bits = linededup.keep_bitmaps(docs).collect()
        assert sorted(((r.doc, r.n_lines, r.n_dropped) for r in bits), key=str) == [g[:3] for g in sorted(got, key=lambda g: str(g[:3]))]
        assert all(_zeros(r.keep, r.n_lines) == r.n_dropped for r in bits)
        renamed = linededup.keep_bitmaps(docs.drop("doc").withColumnRenamed("doc_id", "doc"), id_col="doc")
        assert renamed.columns == ["doc", "row", "n_lines", "n_dropped", "keep"] and renamed.count() == len(rows)
        whole = linededup.dedup_lines(docs)
        assert whole.columns == docs.columns
        assert {tuple(r)[2:] for r in whole.collect()} == {(1, 2, 3, 4, 5, 6)}
        assert sorted((str(r.doc_id), r.text) for r in whole.collect()) == sorted((str(g[0]), g[3]) for g in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_an_id_and_one_line_everywhere(spark):
    line = "this line stands in every text"
    rows = [(i if i % 2 else None, f"own words of text {i}\n{line}\n{line}") for i in range(400)] + [(None, line)] * 3
    got = sorted((tuple(x) for x in linededup.kept_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert got == _brute(rows)


def test_bitmaps_are_compressed_bits(spark):
    docs = spark.createDataFrame([(1, "a line that is long\nx"), (2, "y\na line that is long")], "doc_id long, text string")
    bits = {r.doc: np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=2).tolist() for r in linededup.keep_bitmaps(docs).collect()}
    assert bits == {1: [1, 1], 2: [1, 0]}
    assert linededup.keep_bitmaps(docs.limit(0)).count() == 0


def test_keys():
    n, found = linededup.line_keys(" ABCDEFGHIJ \nabcdefghi\n", 10)
    assert n == 3 and found == [(0, hashlib.blake2b(b"abcdefghij", digest_size=16).digest())]
