"""Cross-tokenizer alignment: two token sequences of one text, merged by their byte ends.

Both tokenizers spell the same bytes, so each token is a byte range. Two tokens are linked
if their ranges overlap; where tokens of both end at the same byte, a cut divides the
sequences into groups that can be exchanged for each other.

All documents of a batch are merged in lockstep: one state vector holds a pointer into A
and one into B for each of them, a step links the tokens that all pointers stand on, records
the cuts where both end, advances the side that ends first (both at a cut) and drops the
documents that are done. A long document takes several lanes of the vector, each for the
pairs whose overlap begins in its own stretch of bytes; so the number of steps depends on
the stretch and not on the longest document.

Scale: documents never leave the task that reads them, and return their distinct id pairs
with numbers. Counts of id pairs are summed by task before they are shuffled. To look
counts up, workers hold the pairs and counts up to a number of pairs (12 bytes each);
beyond, the pairs of documents are joined to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .encoding import _CUT, Memory, _description, _is_byte_bpe, tokenizer
from .staging import join_unique, like, staged

#: Bytes of a lane, and id pairs that a worker holds.
LANE, HELD_PAIRS = 512, 8_000_000
#: Neither end is white space, and nothing in it stands for a blank.
_WORDLIKE = re.compile(r"[^\s▁](?:[^▁]*[^\s▁])?")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Ids of a text by a byte-level BPE (A, of blank + text) and a piece model (B, which adds the blank).

    Texts are cut before a single blank between two characters that are not white space. No
    token of either goes across: A's words carry their leading blank, and B has no piece
    with its blank sign behind another character. Distinct pieces are encoded once. With
    files of which that does not hold, texts are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = tokenizer(path_a, True), SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        spelled = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (max((i for i, _ in spelled), default=-1) + 1)
        for i, t in spelled:
            self.bytes_a[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.known = _is_byte_bpe(_description(path_a)) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.pieces = Memory(self._entries)

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        want = (" " + text).encode("utf-8", "replace")
        return b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))

    def _alone(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        left = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, e, b in zip(texts, left, self.b.encode(texts, num_threads=1), strict=True):
            yield np.array(e.ids, "<u4").tobytes(), np.array(b, "<u4").tobytes(), self._same(text, e.ids, b)

    def _entries(self, pieces: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of each piece. Pieces that white space cannot reach out of are encoded as one text, which costs less than a text each."""
        joined = [i for i, p in enumerate(pieces) if _WORDLIKE.fullmatch(p)] if self.known else []
        text = " ".join([pieces[i] for i in joined])
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids if joined else [], self.b.encode(text) if joined else []
        out: dict[int, tuple[bytes, bytes, bool]] = {}
        if joined and self._same(text, a, b):
            ends, cut = np.cumsum([len(pieces[i].encode("utf-8", "replace")) + 1 for i in joined]), []
            for ids, sizes in ((a, self.size_a), (b, self.size_b)):
                ids = np.array(ids, "<u4")
                at = np.cumsum(sizes[ids])
                last = np.searchsorted(at, ends)
                cut.append((ids.tobytes(), [0, *((last + 1) * 4).tolist()], (at[last] == ends).all()))
            if cut[0][2] and cut[1][2]:
                (raw_a, x, _), (raw_b, y, _) = cut
                out = {i: (raw_a[x[k] : x[k + 1]], raw_b[y[k] : y[k + 1]], True) for k, i in enumerate(joined)}
        rest = [i for i in range(len(pieces)) if i not in out]
        out.update(zip(rest, self._alone([pieces[i] for i in rest]), strict=True))
        return [out[i] for i in range(len(pieces))]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Both sequences of ids as 32-bit integers; empty where one of them does not spell blank + text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """encode() of each text; the pieces that are new in any of them are encoded together."""
        cut = [_CUT.split(t) if t and self.known else [] for t in texts]
        entries, out = self.pieces.of(set().union(*cut)), []
        for text, pieces in zip(texts, cut, strict=True):
            a, b, same = zip(*map(entries.__getitem__, pieces), strict=True) if pieces else ((), (), ())
            if text and not (pieces and all(same)):
                x, y, spelled = next(self._alone([text]))
                a, b = ([x], [y]) if spelled else ((), ())
            out.append((b"".join(a), b"".join(b)))
        return out


@cache
def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    return PairEncoder(path_a, path_b)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, total: int, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of overlapping tokens of all documents of a batch, laid out one after the other.

    end_a, end_b: ascending byte ends of the tokens, over all documents; total: bytes of all.
    Documents end at the same byte on both sides, which is a cut, so no pair goes across.
    """
    if not total:
        return (np.zeros(0, np.int64),) * 2
    first = np.arange(0, total, lane)
    # A lane begins with the tokens that hold its first byte.
    i, j = np.searchsorted(end_a, first, side="right"), np.searchsorted(end_b, first, side="right")
    stop = np.minimum(first + lane, total)
    # An overlap that began before belongs to the lane before: there the shorter token is left at once.
    begin = np.maximum(np.where(i > 0, end_a[i - 1], 0), np.where(j > 0, end_b[j - 1], 0))
    skip = np.flatnonzero(begin < first)
    at = np.minimum(end_a[i[skip]], end_b[j[skip]])
    i[skip] += end_a[i[skip]] == at
    j[skip] += end_b[j[skip]] == at
    begin[skip] = at
    live = begin < stop
    i, j, stop = i[live], j[live], stop[live]
    left, right = [], []
    while len(i):
        left.append(i)
        right.append(j)
        ends_a, ends_b = end_a[i], end_b[j]
        at = np.minimum(ends_a, ends_b)
        i, j = i + (ends_a == at), j + (ends_b == at)
        live = at < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((j, i))
    return i[order], j[order]


@cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of numbers below 2^17, ten to a row, and how many there are."""
    text = np.arange(1 << 17).astype("S10")
    return text.view(np.uint8).reshape(-1, 10), np.char.str_len(text).astype(np.int64)


def group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3` of one document: ids, and whether a group ends with each."""
    if not len(a):
        return b""
    if max(a.max(), b.max()) >= 1 << 17:  # a larger vocabulary than the table of digits
        at_a, at_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        sides = zip(np.split(a, at_a[:-1]), np.split(b, at_b[:-1]), strict=True)
        return ";".join(f"{','.join(map(str, x.tolist()))}|{','.join(map(str, y.tolist()))}" for x, y in sides).encode()
    digits, lengths = _digits()
    group = np.concatenate([np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * group + side, kind="stable")
    ids = np.concatenate([a, b])[order]
    mark = np.where(np.concatenate([cut_a, cut_b])[order], np.where(side[order] == 0, ord("|"), ord(";")), ord(","))
    size = lengths[ids]
    start = np.cumsum(size + 1) - size - 1
    out = np.empty(int(start[-1] + size[-1] + 1), np.uint8)
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        out[start[some] + k] = digits[ids[some], k]
    out[start + size] = mark
    return out[:-1].tobytes()


class Aligned:
    """The alignment of a batch of documents, laid out one after the other."""

    def __init__(self, encoder: PairEncoder, texts: list[str | None]):
        a, b = zip(*encoder.encode_all(texts), strict=True) if texts else ((), ())
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum([len(t) // 4 for t in x])]).astype(np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(encoder.size_a[self.a]), np.cumsum(encoder.size_b[self.b])
        self.i, self.j = lockstep(end_a, end_b, int(end_a[-1]) if len(end_a) else 0)
        both = end_a[self.i] == end_b[self.j]
        self.cut_a, self.cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.cut_a[self.i[both]] = True
        self.cut_b[self.j[both]] = True
        #: Where the links and the groups of each document begin.
        self.first_link = np.searchsorted(self.i, self.first_a)
        self.first_group = np.concatenate([[0], np.cumsum(self.cut_a)])[self.first_a]

    def groups_text(self, d: int) -> bytes:
        x, y = slice(*self.first_a[d : d + 2]), slice(*self.first_b[d : d + 2])
        return group_text(self.a[x], self.b[y], self.cut_a[x], self.cut_b[y])

    def pairs(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs of a document's links, as A * 2^32 + B, and how many links each has."""
        s = slice(*self.first_link[d : d + 2])
        return np.unique((self.a[self.i[s]] << 32) | self.b[self.j[s]], return_counts=True)


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0)]).astype(kind)))


_TOKENS = "id long, a array<int>, b array<int>, link_a array<int>, link_b array<int>, cut_a array<int>, cut_b array<int>"
_SUMS = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def _tokens(found: Aligned, ids: pa.Array) -> list[pa.Array]:
    n = range(len(ids))
    a, b = found.first_a, found.first_b
    s = [slice(*found.first_link[d : d + 2]) for d in n]
    return [
        ids, _lists([found.a[a[d] : a[d + 1]] for d in n], np.int32), _lists([found.b[b[d] : b[d + 1]] for d in n], np.int32),
        _lists([found.i[s[d]] - a[d] for d in n], np.int32), _lists([found.j[s[d]] - b[d] for d in n], np.int32),
        _lists([np.flatnonzero(found.cut_a[a[d] : a[d + 1]]) + 1 for d in n], np.int32),
        _lists([np.flatnonzero(found.cut_b[b[d] : b[d + 1]]) + 1 for d in n], np.int32),
    ]


def _sums(found: Aligned, ids: pa.Array) -> list[pa.Array]:
    texts = [found.groups_text(d) for d in range(len(ids))]
    pairs, links = zip(*map(found.pairs, range(len(ids))), strict=True) if len(ids) else ((), ())
    numbers = [np.diff(x).astype(np.int64) for x in (found.first_a, found.first_b, found.first_group, found.first_link)]
    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
    return [ids, *map(pa.array, numbers), pa.array(digests, pa.string()), _lists(list(pairs), np.int64), _lists(list(links), np.int32)]


def _align_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, out) -> Iterator[pa.RecordBatch]:
    encoder = pair_encoder(path_a, path_b)
    names = [c.split()[0] for c in (_TOKENS if out is _tokens else _SUMS).split(", ")]
    for batch in by_size(batches, 1):
        yield pa.RecordBatch.from_arrays(out(Aligned(encoder, batch.column(1).to_pylist()), batch.column(0)), names=names)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")


def align(docs: DataFrame, *, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, link_a, link_b, cut_a, cut_b) of every row.

    a, b: token ids; link_a, link_b: places, from 0, of the tokens of each link; cut_a,
    cut_b: numbers of tokens up to the end of each group. Null and empty texts, and texts
    that one of the tokenizers does not spell byte by byte, have no tokens. Repeated rows
    each return a row; a null id stays null; other columns play no part.
    """
    return _documents(docs, id_col, text_col).mapInArrow(partial(_align_batches, path_a=path_a, path_b=path_b, out=_tokens), _TOKENS)


def _count_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Sums links of equal pairs, up to `most` pairs at a time."""
    keys, n, held = [], [], 0

    def summed() -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, at, np.concatenate(n))
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total)], names=["pair", "n"])

    for batch in batches:
        keys.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        n.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        held += len(keys[-1])
        if held > most:
            part = summed()
            keys, n = [part.column(0).to_numpy()], [part.column(1).to_numpy()]
            held = 2 * part.num_rows if 2 * part.num_rows <= most else 0
            if not held:
                yield part
                keys, n = [], []
    if keys:
        yield summed()


def _look_up(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Rows with pairs and links at the end -> n_best and count_sum in their place."""
    pair, count, best = held.value
    for batch in batches:
        pairs, links = (batch.column(c) for c in (-2, -1))
        of = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
        flat, n = pairs.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(pair, flat)
        sums = np.zeros((2, batch.num_rows), np.int64)
        np.add.at(sums[0], of, n * best[at])
        np.add.at(sums[1], of, n * count[at])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1])], names=[*batch.schema.names[:-2], "n_best", "count_sum"])


_FOUND = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def pair_counts(sums: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair over all documents, and whether no pair of its B id has more."""
    counts = sums.select("pairs", "links").mapInArrow(_count_batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("rows"))
    of = join_unique(counts.withColumn("b", b), staged(top, "pair-tops"), ["b"], counts.count(), "rows")
    return staged(of.select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def aligned_sums(
    docs: DataFrame, *, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row.

    n_best: links whose id pair no other pair of the same B id surpasses in links over all
    documents; count_sum: those numbers, over the row's links. Texts, ids and repeated
    rows as in align(); without tokens all numbers are 0 and the digest is empty. An empty
    table gives no rows.
    """
    sums = _documents(docs, id_col, text_col).mapInArrow(partial(_align_batches, path_a=path_a, path_b=path_b, out=_sums), _SUMS)
    sums = staged(sums, "aligned")
    counts = pair_counts(sums)
    if counts.count() <= held_pairs:
        table = counts.orderBy("pair").toArrow()  # held_pairs rows at most
        held = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        return sums.mapInArrow(partial(_look_up, held=held), _SUMS.split("pairs")[0] + "n_best long, count_sum long")
    sums = staged(sums.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    each = sums.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    per_pair = each.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"))
    table = staged(counts.join(per_pair, "pair").withColumnRenamed("n", "count"), "pair-rows")
    rows = sums.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    found = join_unique(each, table, ["pair"], rows, "rows").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sums.join(found, "row", "left").select(*_FOUND, zero("n_best"), zero("count_sum"))
