"""Token files: encoders against whole-text encoding, codes and files as exact round trips."""

import json
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fundweave.llm import encoding, huffman, tokenfile
from fundweave.llm.encoding import SpanEncoder, WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "Hello  World", "a\tb\nc\r\n d", "it's <|endoftext|> we've", "<|startoftext|>x", "é é ß ΑΣ İ",
    "a b c　d", "x\x1cy \x1f z", "# ## a#b", "\n\n  two\n\n", "naïve 😀😀 " * 50, "word " * 3000, " lead", "trail ",
    "a  b   c", "tab\t x", "ÀÉß ÿ×÷ ½ ²x ªº µm DON'T don'ts 'RE", "İstanbul ΑΣΣ. ŉ ﬁ K", "Ǆ 12345 6", "́start", "Hello, world. (Yes); no!?", "one. two, (three) four: é;\nfive ! six", "end..", "(a.) b",
]


def _random_texts(n):
    r = random.Random(3)
    alphabet = "ab cdEFÉß×ª'st  \n\t'.#é́ \x1c\x1d😀12 <|>"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_word_encoder_equals_whole_text_encoding():
    texts = TEXTS + _random_texts(400)
    plain = Tokenizer.from_file(WORDS)
    encoder = WordEncoder(WORDS)
    got = encoder.encode_batch(texts, 2)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], repr(text)


def test_span_encoder_equals_whole_text_encoding():
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    encoder = SpanEncoder(BYTES)
    for text in TEXTS + _random_texts(400):
        want = plain.encode(text or "", add_special_tokens=False)
        ids, starts, ends = encoder.encode(text)
        assert ids.tolist() == want.ids, repr(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets, repr(text)


def _other_file(tmp_path, source, change):
    found = json.loads(Path(source).read_text(encoding="utf-8"))
    change(found)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("change", [
    lambda d: d.update(normalizer=None),
    lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"),
    lambda d: d.update(added_tokens=[*d["added_tokens"], {**d["added_tokens"][0], "id": 49408, "content": "two words"}]),
])
def test_words_of_another_tokenizer_are_those_of_whole_texts(tmp_path, change):
    path = _other_file(tmp_path, WORDS, change)
    plain, encoder = Tokenizer.from_file(path), WordEncoder(path)
    assert not encoder.known and WordEncoder(WORDS).known
    texts = ["Hello World 123", "it's two words, DON'T", None, "", "a  b\n"]
    for text, ids in zip(texts, encoder.encode_batch(texts, 2), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_spans_of_another_tokenizer_are_those_of_whole_texts(tmp_path):
    path = _other_file(tmp_path, BYTES, lambda d: d["pre_tokenizer"].update(use_regex=False))
    plain, encoder = Tokenizer.from_file(path), SpanEncoder(path)
    assert not encoder.known and SpanEncoder(BYTES).known
    for text in ("Hello World 123", "it's  two words", "", "é x"):
        want = plain.encode(text, add_special_tokens=False)
        ids, starts, ends = encoder.encode(text)
        assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


@pytest.mark.parametrize("limit", [4, 9, 20])
def test_code_round_trip(limit):
    r = np.random.default_rng(limit)
    for n in (1, 2, 3, 9, 16):
        counts = (r.pareto(0.4, n) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        ids = r.choice(n, 5000, p=counts / counts.sum()).astype(np.uint32)
        marks, _, data = huffman.encode(ids, lengths, huffman.codes(lengths), 64)
        assert (huffman.Decoder(lengths).decode(data, marks, len(ids), 64) == ids).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0, 40], np.int64)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts, 20) * counts).sum()) == cost


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files_round_trip(spark):
    r = random.Random(1)
    rows = [(i * 3 if i % 17 else None, t, "x") for i, t in enumerate(TEXTS + _random_texts(100))]
    rows += [(6, "again", "x"), (6, "again", "x"), (9, "other", "y")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    tokens = tokenfile.staged(tokenfile.encoded(docs, id_col="doc_id", text_col="text", tokenizer_path=WORDS, end_id=2), "t")
    folder = tokenfile.shared_dir(spark, "f")
    files = tokenfile.write_ids(tokens, folder, block=64, every=16, file_tokens=700)
    assert files.count() > 3
    plain = Tokenizer.from_file(WORDS)
    want = [(i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, _ in rows]
    got = [tuple(x) for x in tokenfile.read_ids(files, folder).orderBy("start").collect()]
    order = {(i, bytes(ids)): k for k, (i, _, _, ids) in enumerate(got)}  # rows of an id may come in any fixed order
    tokens_of = sorted(want, key=lambda x: (x[0] is None, x[0] or 0, order[x[0], x[1].tobytes()]))
    start, expected, digests = 0, [], []
    for i, ids in tokens_of:
        expected.append((i, start, len(ids), bytearray(ids.tobytes())))
        digests.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert _rows(tokenfile.document_digests(files, folder)) == sorted(digests, key=str)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files, folder = tokenfile.token_output(docs, tokenizer_path=WORDS)
    assert files.count() == 0 and tokenfile.document_digests(files, folder).count() == 0


def test_pieces_of_all_plain_letters_are_those_of_whole_texts():
    """Byte letters stand in for the tokenizer's byte level in all plain letters and signs."""
    encoder = WordEncoder(WORDS)
    letters = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    texts = [x + y for x in letters for y in ("", "a", "\xdf\xe0", "\xed1", ".")] + [" ".join(letters)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode_batch(texts) == [np.array(e.ids, encoder.kind).tobytes() for e in whole]


def test_documents_are_counted_and_blocks_decoded_together(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 3000, n).astype("<u2") for n in rng.integers(0, 90, 600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([len(x) for x in docs], pa.int64()), pa.array([x.tobytes() for x in docs], pa.binary())], schema=tokenfile._IDS)
    calls = []
    for owner, name in ((np, "bincount"), (huffman.Decoder, "decode")):
        monkeypatch.setattr(owner, name, lambda *a, f=getattr(owner, name), name=name: calls.append(name) or f(*a))
    (counts,) = tokenfile._count(iter([batch]))
    assert calls == ["bincount"]
    freq = np.zeros(3000, np.int64)
    freq[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    writer = tokenfile._Writer(huffman.code_lengths(freq, 20), 700, 64)  # 700 is not a multiple of 64
    for i, x in enumerate(docs):
        writer.add(i, x)
    data = writer.finish()
    blocks = -(-sum(map(len, docs)) // 700)
    assert [(i, x.tolist()) for i, x in tokenfile.read_file(data)] == [(i, x.tolist()) for i, x in enumerate(docs)]
    assert blocks > 30 and calls.count("decode") == -(-blocks // 16)


def test_codes_are_canonical():
    """By length, then id: each code is the one before plus one, with as many noughts as it is longer."""
    for lengths in ([], [0], [1], [2, 0, 1, 3, 3], huffman.code_lengths(np.random.default_rng(7).zipf(1.3, 500).clip(0, 10**6), 14)):
        lengths = np.array(lengths, np.uint8)
        code, last, want = 0, 0, {}
        for size, symbol in sorted((int(x), i) for i, x in enumerate(lengths) if x):
            code, last = ((code + 1) << (size - last) if last else 0), size
            want[symbol] = code
        assert {i: int(c) for i, c in enumerate(huffman.codes(lengths)) if lengths[i]} == want


def test_plain_texts_are_cut_by_the_tokenizers_pattern():
    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
    r = random.Random(8)
    texts = ["", " ", "'", "a'", "'s", "'l", "'ll", "'r", "don't've", "''s", ".'s", "'s's'", "'re.", "'d1", "'v e", "7'm'"]
    texts += ["".join(r.choice("''stmdrevlla1.é \n") for _ in range(r.randrange(30))) for _ in range(3000)]
    got = encoding._cut("".join(t + "\0" for t in texts).encode("latin-1")).to_pylist()
    assert [p.decode("latin-1") for p in got] == [p for t in texts for p in [*pattern.findall(t), "\0"]]
    assert encoding._cut(b"").to_pylist() == []


def test_pieces_are_made_again_once_they_are_forgotten(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_ROWS", 20)
    plain, encoder = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    for k in range(12):
        texts = [f"the word{chr(97 + k)} {chr(97 + i)}x'{i}" for i in range(k, k + 8)] + [None, "the caf\xe9"]
        for text, ids in zip(texts, encoder.encode_batch(texts, 2), strict=True):
            assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert len(encoder.pieces.known) == len(encoder.pieces.ids) <= 40


def test_known_pieces_of_a_plain_text_are_no_objects_of_their_own():
    """Lists of str took 141 bytes a piece, arrays take 30."""
    encoder, n = WordEncoder(WORDS), 400_000
    text = "ab Cd " * (n // 2)
    whole = encoder.encode_batch([text[:6]])[0]
    tracemalloc.start()
    try:
        (ids,) = encoder.encode_batch([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids == whole * (n // 2)
    assert peak < 60 * n
