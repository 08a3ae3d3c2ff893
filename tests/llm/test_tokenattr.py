"""Token attribution against a walk over each token's characters."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fundweave.llm import tokenattr

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _plain(text, spans, rule):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    owner, at = [-1] * len(text), 0
    for k, (a, b) in sorted(enumerate(spans), key=lambda x: (x[1], x[0])):
        a, b = max(a, at), min(b, len(text))
        for i in range(a, b):
            owner[i] = k
        at = max(at, b) if b > a else at
    part, last, n = [], None, -1
    for o in owner:  # neighbouring characters of one owner are one interval
        n, last = (n, last) if o == last else (n + 1, o)
        part.append(n)
    counts, crossing, off = [0] * len(spans), 0, 0
    offsets = t.encode(text, add_special_tokens=False).offsets if text else []
    for a, b in offsets:
        chars = list(range(a, max(b, a + 1)))
        parts = [part[i] for i in chars]
        crossing += len(set(parts)) > 1
        if rule == "first":
            at = chars[0]
        elif rule == "last":
            at = chars[-1]
        else:
            best = max(sorted(set(parts)), key=parts.count)
            at = chars[parts.index(best)]
        if owner[at] < 0:
            off += 1
        else:
            counts[owner[at]] += 1
    return len(offsets), crossing, off, counts


@pytest.mark.parametrize("rule", tokenattr.RULES)
def test_sections_equal_the_plain_walk(spark, rule):
    r = random.Random(1)
    rows = [(1, None, [(0, 3)]), (2, "", None), (3, "hello\n\n\nworld  tab\t", [(0, 7), (7, 8), (8, 30)]), (4, "abc", [(2, 2), (0, 1)])]
    for i in range(60):
        text = "".join(r.choice(["word", " ", "\n", "é", "😀", "Long", "12", "."]) for _ in range(r.randrange(40)))
        cuts = sorted(r.randrange(50) for _ in range(4))
        rows.append((10 + i, text, [(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[2], cuts[3])]))
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, parts array<struct<start: int, end: int>>, n_tokens int").repartition(2)
    got = {x.doc_id: (x.n_tokens, x.n_crossing, x.n_unassigned, x.section_tokens) for x in tokenattr.attribute(df, tokenizer_path=PATH, sections_col="parts", rule=rule).collect()}
    assert got == {i: _plain(t or "", s or [], rule) for i, t, s in rows}


def test_lines_and_sums(spark):
    texts = ["a b\nc\n\n\nd e f", "", None, "one line"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokenattr.attribute(df, tokenizer_path=PATH, rule="most").collect():
        assert len(r.section_tokens) == len((texts[r.doc_id] or "").split("\n")) and sum(r.section_tokens) + r.n_unassigned == r.n_tokens
    assert tokenattr.attribute(df.limit(0), tokenizer_path=PATH).count() == 0
    with pytest.raises(ValueError):
        tokenattr.attribute(df, tokenizer_path=PATH, rule="other")
