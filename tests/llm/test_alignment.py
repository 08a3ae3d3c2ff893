"""Alignment of two tokenizers against plain overlaps of all tokens."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fundweave.llm import alignment
from fundweave.llm.queries import op11_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Plain words, and more words.", "  two  blanks ", "tabs\tand\n\nlines\r\n end", "café Ω ﬁ ½ 漢字 🙂 é", "a ▁ b", "▁x",
    "<|endoftext|> is text", "<s> </s> <0x41>", "\x00 \x1c nul", "x y  z", "aaaa " * 700, "nowhitespace" * 300, "e ́f", "don't 12345 it's",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(text, tokenizers):
    """(A ids, B ids, links, groups) by comparing every token with every other."""
    a, b = tokenizers
    alphabet = alignment.byte_alphabet()
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell_a = [bytes(alphabet[c] for c in a.id_to_token(i)) if i != 50256 else b"?" for i in x]
    spell_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(s) for s in spell_a]).tolist(), np.cumsum([len(s) for s in spell_b]).tolist()
    span_a, span_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))  # noqa: B905
    links = [(i, j) for i, (s, e) in enumerate(span_a) for j, (t, f) in enumerate(span_b) if s < f and t < e]
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = [
        ([x[i] for i, (s, e) in enumerate(span_a) if low <= s and e <= high], [y[j] for j, (s, e) in enumerate(span_b) if low <= s and e <= high])
        for low, high in zip([0, *cuts], cuts)  # noqa: B905
    ]
    return x, y, links, groups


def digest(groups):
    text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def expected(rows, tokenizers):
    found = [(i, *plain(t, tokenizers)) for i, t in rows]
    counts = Counter((x[i], y[j]) for _, x, y, links, _ in found for i, j in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc, x, y, links, groups in found:
        n = [(counts[x[i], y[j]], top[y[j]]) for i, j in links]
        out.append((doc, len(x), len(y), len(groups), len(links), sum(c == t for c, t in n), sum(c for c, _ in n), digest(groups)))
    return sorted(out, key=str)


def test_whole_query_equals_plain_overlaps(spark, tmp_path, tokenizers):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "and more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("A", F.lit("x"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, tokenizers)


def test_documents_equal_plain_overlaps(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, tokenizers)
    for held in (alignment.HELD_PAIRS, 10):  # pairs held by workers, pairs joined
        got = alignment.aligned_sums(docs, path_a=A, path_b=B, held_pairs=held)
        got = got.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_tokens_links_and_cuts(spark, tokenizers):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in alignment.align(docs, path_a=A, path_b=B).collect():
        x, y, links, groups = plain(TEXTS[r.id], tokenizers)
        assert (r.a, r.b, sorted(zip(r.link_a, r.link_b, strict=True))) == (x, y, links)
        assert np.diff([0, *r.cut_a]).tolist() == [len(a) for a, _ in groups]
        assert np.diff([0, *r.cut_b]).tolist() == [len(b) for _, b in groups]


def test_lanes_of_any_length_give_the_same_links():
    rng = np.random.default_rng(5)
    for _ in range(50):
        total = int(rng.integers(1, 400))
        ends = [np.append(np.sort(rng.choice(np.arange(1, total), int(rng.integers(0, total)), replace=False)) if total > 1 else [], total).astype(np.int64) for _ in "ab"]
        want = alignment.lockstep(*ends, total, 10**6)
        for lane in (1, 3, 64):
            for x, y in zip(alignment.lockstep(*ends, total, lane), want, strict=True):
                assert x.tolist() == y.tolist()


def test_group_text_of_large_ids():
    a, b = np.array([1, 200_000, 3]), np.array([7, 8])
    cut_a, cut_b = np.array([False, True, True]), np.array([True, True])
    assert alignment.group_text(a, b, cut_a, cut_b) == b"1,200000|7;3|8"
    assert alignment.group_text(a[[0, 0, 2]], b, cut_a, cut_b) == b"1,1|7;3|8"


def test_very_long_text_and_empty_table(spark):
    text = "lorem ipsum, dolor " * 60_000
    one = alignment.aligned_sums(spark.createDataFrame([(1, text)], "doc_id long, text string"), path_a=A, path_b=B).first()
    assert one.n_links >= max(one.n_a, one.n_b) > 200_000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_sums(empty, path_a=A, path_b=B).collect() == []


def test_counts_are_summed_in_bounded_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 3], [2]], pa.list_(pa.int64())), pa.array([[1, 1, 5], [4]], pa.list_(pa.int32()))], names=["pairs", "links"])
    total = Counter()
    for part in alignment._count_batches(iter([batch] * 5), most=4):
        for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            total[k] += v
    assert total == {1: 5, 2: 25, 3: 25}
