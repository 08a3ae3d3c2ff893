"""Whole-text encoding with public tokenizers, one distinct piece at a time.

Both encoders cut a text where its tokenizer can form no token across the cut, encode each
distinct piece once with the tokenizers library and put the pieces' ids together. The ids
are those of encoding the whole text; tests compare the two. A worker keeps its encoders,
and the pieces they know, from task to task. The word encoder cuts plain texts, and puts
their ids together, a batch at a time in numpy and Arrow: no piece becomes a Python object
but a new one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces remembered in each of two generations.
REMEMBERED = 150_000
#: Distinct pieces remembered in Arrow arrays, about 30 bytes each.
REMEMBERED_ROWS = 400_000

_SEPARATORS = re.compile("[\x1c-\x1f]")
#: A single blank between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts of these characters alone are normalised by _LOWER and cut by _cut(), in Latin-1.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_WHITE = b"\t\n\x0b\x0c\r "
#: Ends a text. It is not plain.
_MARK = b"\0"
#: What a letter of lower-case plain text is, by its byte of Latin-1: 0 white space, 1 a letter, 2 a sign, 3 a piece of its own.
_KINDS = bytes(
    0 if b in _WHITE else 1 if re.match("[a-zß-öø-ÿ]", chr(b)) else 3 if chr(b) in "0123456789\0" else 2 for b in range(256)
)

#: The byte-level tokenizer's own pattern, for plain text; its pieces follow each other without gaps.
_BYTE_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+"
)

#: The byte level's letters for bytes that do not stand for themselves. Below 128 those of plain pieces all do.
_BYTE_LETTERS = [(chr(b), chr(256 + i)) for i, b in enumerate([*range(33), *range(127, 161), 173]) if b >= 128]
_ID = attrgetter("id")


@cache
def _description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _steps(part: dict | None) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer, one after the other."""
    if part is None:
        return []
    return [step for p in part.get("normalizers") or part.get("pretokenizers") or [part] for step in ([p] if p is part else _steps(p))]


#: Fixed value: the pattern that the word encoder stands in for.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_word_bpe(found: dict) -> bool:
    """Whether the file's normaliser and pattern are those that WordEncoder stands in for."""
    norm, pre = _steps(found["normalizer"]), _steps(found["pre_tokenizer"])
    return (
        [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"]
        and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and (pre[0]["pattern"], pre[0]["behavior"], pre[0]["invert"]) == ({"Regex": _WORD_PATTERN}, "Removed", True)
        and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        and found["post_processor"] is None and found["truncation"] is None and found["model"]["type"] == "BPE"
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in found["added_tokens"])
    )


def _is_byte_bpe(found: dict) -> bool:
    """Whether the file's pre-tokenizer is the byte-level one that SpanEncoder stands in for."""
    pre = _steps(found["pre_tokenizer"])
    return (
        not _steps(found["normalizer"]) and [x["type"] for x in pre] == ["ByteLevel"] and not pre[0]["add_prefix_space"] and pre[0]["use_regex"]
        and found["post_processor"] is None and found["truncation"] is None and found["model"]["type"] == "BPE"
        and all(t["special"] for t in found["added_tokens"])
    )


class Memory:
    """What pieces become, in two generations: the older one is dropped when the newer is full."""

    def __init__(self, make: Callable[[list[str]], Iterable]):
        self.make, self.new, self.old = make, {}, {}

    def of(self, pieces: set[str]) -> dict:
        """A mapping that holds all the pieces."""
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        order = []
        for p in pieces.difference(self.new):
            if p in self.old:
                self.new[p] = self.old[p]
            else:
                order.append(p)
        for i in range(0, len(order), 5000):
            part = order[i : i + 5000]
            self.new.update(zip(part, self.make(part), strict=True))
        return self.new


@cache
def tokenizer(path: str, special_as_text: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return t


def _cut(data: bytes) -> pa.LargeBinaryArray:
    """The pieces of lower-case plain texts in Latin-1, each with a mark after it; marks are pieces.

    The tokenizer's own pattern: 's|'t|'re|'ve|'m|'ll|'d|[letters]+|[digit]|[signs]+.
    """
    kind = np.frombuffer(data.translate(_KINDS), np.uint8)
    first = kind == 3
    first[:1] = True
    first[1:] |= kind[1:] != kind[:-1]
    letters = np.frombuffer(data + _MARK, np.uint8)
    at = np.flatnonzero(letters[:-1] == ord("'"))
    at = at[first[at]]  # within signs it is one of them
    one, two = letters[at + 1], letters[at + 2]
    three = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, size in ((at[np.isin(one, list(b"stmd"))], 2), (at[three], 3)):
        first[found + 1], first[found + size] = False, True
    starts = np.flatnonzero(first[kind > 0])
    dense = data.translate(None, _WHITE)
    offsets = np.append(starts, len(dense)).astype(np.int64, copy=False)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(dense)])


class PieceIds:
    """The ids of pieces as bytes, in arrays that new pieces are added to.

    When there are too many, those of the last batch stay.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]]):
        self.make = make
        self.known, self.ids = pa.array([_MARK], pa.large_binary()), pa.array([b""], pa.large_binary())

    def of(self, pieces: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each piece; a mark has none."""
        found = pieces.dictionary_encode()
        at = pc.index_in(found.dictionary, value_set=self.known)
        new = found.dictionary.filter(at.is_null())
        text, cuts = b"".join(new.to_numpy(zero_copy_only=False)).decode("latin-1"), np.cumsum(pc.binary_length(new)).tolist()
        order = [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        made = [ids for i in range(0, len(order), 5000) for ids in self.make(order[i : i + 5000])]
        where = at.fill_null(-1).to_numpy().copy()
        where[where < 0] = len(self.known) + np.arange(len(new))
        known, ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, pa.array(made, pa.large_binary())])
        mine = ids.take(pa.array(where))
        self.known, self.ids = (known, ids) if len(known) <= REMEMBERED_ROWS else (found.dictionary, mine)
        return mine.take(found.indices)


class WordEncoder:
    """For the word BPE: lower case, white space separates words for good and is dropped.

    A plain text is lower-cased and cut by the tokenizer's pattern here; its pieces are
    encoded by the tokenizer's model without the normaliser and the pattern. Other texts are cut
    at white space and their words go through the whole tokenizer. str.split() also cuts at
    \\x1c-\\x1f, which the tokenizer takes for symbols: texts with those are encoded as
    they are.

    All that holds for a tokenizer with the normaliser and the pattern that _is_word_bpe()
    asks for. Any other encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.known = _is_word_bpe(_description(path))
        self.model = Tokenizer.from_file(path)
        #: How ids are returned: two bytes an id where the vocabulary allows it.
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"
        if not self.known:
            return
        self.pieces, self.words = PieceIds(self._of_pieces), Memory(self._of_words)

    @property
    def tokenizer(self):
        """The whole tokenizer, loaded once a text needs it."""
        return tokenizer(self.path, False)

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _of_words(self, words: list[str]) -> Iterable[bytes]:
        return (self._raw(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def _of_pieces(self, pieces: list[str]) -> Iterable[bytes]:
        """Pieces go through the tokenizer's model alone, which costs half of a text of them."""
        text = "\n".join(pieces).encode().decode("latin-1")  # a letter a byte; no piece has white space
        for byte, letter in _BYTE_LETTERS:
            text = text.replace(byte, letter)
        tokens, ids, size, cuts = self.model.model.tokenize, [], np.dtype(self.kind).itemsize, [0]
        for p in text.split("\n"):
            ids.extend(map(_ID, tokens(p)))
            cuts.append(len(ids) * size)
        raw = self._raw(ids)
        return (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def encode_batch(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """For each text, its ids as little-endian unsigned integers of self.kind."""
        end = b"" if end_id is None else self._raw([end_id])
        if not self.known:
            return [self._raw(e.ids) + end for e in self.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        easy = [not t or (_PLAIN.fullmatch(t) is not None and "<|" not in t) for t in texts]
        other = [None if e or _SEPARATORS.search(t) else t.split() for t, e in zip(texts, easy, strict=True)]
        plain = self._of_plain([t or "" for t, e in zip(texts, easy, strict=True) if e])
        words = self.words.of(set().union(*(w for w in other if w))).__getitem__
        out = []
        for text, e, w in zip(texts, easy, other, strict=True):
            if e:
                out.append(next(plain) + end)
            elif w is not None:
                out.append(b"".join(map(words, w)) + end)
            else:
                out.append(self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids) + end)
        return out

    def _of_plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        if not texts:
            return
        pieces = _cut("\0".join([*texts, ""]).encode("latin-1").translate(_LOWER))
        starts, letters = (np.frombuffer(b, kind) for b, kind in zip(pieces.buffers()[1:], (np.int64, np.uint8), strict=True))
        ends = np.flatnonzero(letters[starts[:-1]] == 0)
        _, offsets, raw = self.pieces.of(pieces).buffers()
        data, a = memoryview(raw) if raw else b"", 0
        for b in np.frombuffer(offsets, np.int64)[ends].tolist():
            yield bytes(data[a:b])
            a = b


class SpanEncoder:
    """Ids and character spans of a byte-level BPE whose words carry their leading blank.

    Plain texts are split by the tokenizer's pattern here. Others are cut before a single
    blank between two characters that are not white space: that blank always begins a word.
    All that holds for a tokenizer of that pattern; any other encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path, True)
        self.known = _is_byte_bpe(_description(path))
        self.pieces = Memory(self._entries)

    def _entries(self, texts: list[str]) -> Iterable[tuple[bytes, bytes, int]]:
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            yield np.array(e.ids, "<i8").tobytes(), np.array(e.offsets, "<i8").tobytes(), len(text)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of the whole text, in characters."""
        if not text:
            return (np.zeros(0, np.int64),) * 3
        if not self.known:
            found = self._entries([text])
        else:
            if _PLAIN.fullmatch(text):
                pieces = _BYTE_PIECES.findall(text)
            else:
                pieces = _CUT.split(text)
                pieces[1:] = [" " + p for p in pieces[1:]]
            found = map(self.pieces.of(set(pieces)).__getitem__, pieces)
        ids, spans, sizes = zip(*found, strict=True)
        sizes = np.array(sizes)
        base = np.repeat(np.cumsum(sizes) - sizes, np.array([len(x) for x in ids]) // 8)
        span = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
        return np.frombuffer(b"".join(ids), "<i8"), span[:, 0] + base, span[:, 1] + base


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@cache
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)
