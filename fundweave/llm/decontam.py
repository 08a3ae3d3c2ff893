"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The words of the benchmark are numbered, and its items are one array of word numbers. A
window (n words; a shorter item is one window) is its hash and its place in that array. A
document's words become the same numbers (0: not in the benchmark), a rolling hash of every
window is looked up in the sorted hashes of the set, and each hit is verified against the
words at the place, so no hash collision counts.

Scale: one pass over the documents, no shuffle. What is broadcast is bounded in bytes of
the built set (held_bytes). A larger benchmark is scanned in blocks of that size; each
block writes the hits alone, by a hash of the text, and texts are read again, not written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import by_size
from .staging import free_names, like, staged

#: Bytes that are not part of a word become blanks, A-Z become a-z; others stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MULT = 0x9E3779B97F4A7C15
_RUN = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(_MULT) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return h


class WindowSet:
    """Windows of a block of the benchmark, by length: sorted hashes and the places they are found at."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        ids, of, known = [], [], []
        for item, text in items:
            found = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            ids.append(np.array(found, np.uint32))
            of.append(item or 0)
            known.append(item is not None)
        #: The number of each word of all items, one after the other.
        self.ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self.item, self.known = np.array(of, np.int64), np.array(known, bool)
        lengths = np.array([len(x) for x in ids], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        places: dict[int, list[np.ndarray]] = {}
        for start, length in zip(self.starts.tolist(), lengths.tolist(), strict=True):
            size = min(n, length)
            if size:
                places.setdefault(size, []).append(np.arange(start, start + length - size + 1, dtype=np.uint32))
        #: size -> (distinct hashes, where their places begin, places)
        self.windows = {}
        for size, parts in sorted(places.items()):
            at = np.concatenate(parts)
            h = _hashes(self.ids, size)[at]
            order = np.argsort(h, kind="stable")
            distinct, first = np.unique(h[order], return_index=True)
            self.windows[size] = distinct, np.append(first, len(at)), at[order]

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Mask of the words hit (None: none), and the items of the windows found."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in ws], np.uint32)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        mask, items = None, set()
        for size, (hashes, first, places) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = _hashes(ids, size)[at]
            pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[pos] == h
            seen: dict[bytes, set | None] = {}
            for i, k in zip(at[hit].tolist(), pos[hit].tolist(), strict=True):
                window = ids[i : i + size]
                key = window.tobytes()
                if key not in seen:
                    seen[key] = self._items(window, places[first[k] : first[k + 1]])
                if seen[key] is not None:
                    mask = np.zeros(len(ids), bool) if mask is None else mask
                    mask[i : i + size] = True
            items.update(*(found for found in seen.values() if found))
        return mask, items

    def _items(self, window: np.ndarray, places: np.ndarray) -> set | None:
        """Items that hold the window at one of the places; None where none of them does."""
        real = places[(self.ids[places[:, None].astype(np.int64) + np.arange(len(window))] == window).all(1)]
        if not len(real):
            return None
        of = np.unique(np.searchsorted(self.starts, real, side="right") - 1)
        return set(self.item[of[self.known[of]]].tolist())


def _scan_batches(batches: Iterator[pa.RecordBatch], held, schema: pa.Schema, text_at: int, hits_only: bool) -> Iterator[pa.RecordBatch]:
    found: WindowSet = held.value
    for batch in by_size(batches, text_at):
        n_words, n_hit, hits, items = [], [], [], []
        for text in batch.column(text_at).to_pylist():
            ws = words(text)
            mask, got = found.scan(ws)
            n_words.append(len(ws))
            n_hit.append(0 if mask is None else int(mask.sum()))
            hits.append(None if mask is None else np.packbits(mask).tobytes())
            items.append(sorted(got))
        new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
        if hits_only:
            out = pa.RecordBatch.from_arrays([batch.column(0), *new], schema=schema)
            yield out.filter(pc.is_valid(out.column(3)))
        else:
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, [hits], items) of all blocks -> (key, n_words, n_hit, hits, items)."""
    for batch in batches:
        hits = [np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in many]) for many in batch.column(2).to_pylist()]
        n_hit = pa.array([int(np.bitwise_count(h).sum()) for h in hits], pa.int64())
        columns = [batch.column(0), batch.column(1), n_hit, pa.array([h.tobytes() for h in hits], pa.binary()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", *_NEW])


_NEW = ("n_words", "n_hit", "hits", "items")
_KEYED = "key string, n_words long, n_hit long, hits binary, items array<long>"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _blocks(benchmark: DataFrame, n: int, held_bytes: int) -> int:
    """Blocks of the benchmark whose built sets stay within held_bytes."""
    found = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    sums = benchmark.agg(F.sum(F.size(found)).alias("words"), F.count(F.lit(1)).alias("items")).first()
    vocab = benchmark.select(F.explode(found).alias("w")).agg(F.countDistinct("w").alias("n"), F.sum(F.octet_length("w")).alias("size")).first()
    # A word is a number, and the window at it a hash, where its places begin and a place;
    # a distinct word has an entry in the numbering; an item has three numbers.
    size = 24 * (sums["words"] or 0) + 150 * vocab["n"] + 24 * sums["items"]
    return max(1, -(-size // held_bytes))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 10,
    held_bytes: int = 128 << 20,
    prefix: str = "__",
) -> DataFrame:
    """docs with n_words, n_hit, hits (packed bits of the words hit; null: none) and items, after the prefix.

    Null or empty texts have no words. A benchmark item without words has no window; an
    item with a null id marks words but is not listed. Repeated items and rows are scanned
    like others, each row for itself. Empty tables give no rows, or no hits. Other columns
    of docs pass unchanged; one that has the name of a new column is replaced by it.

    held_bytes bounds what a worker holds of the benchmark at once.
    """
    spark = docs.sparkSession
    names = [prefix + c for c in _NEW]
    if clash := [c for c in docs.columns if c.lower() in names]:
        docs = docs.drop(*clash)
    bench = like(benchmark, item_col, item_text_col).toDF("item", "text").where("text is not null")
    blocks = _blocks(bench, n, held_bytes)

    def scan(d: DataFrame, k: int, schema: T.StructType, text_at: int, hits_only: bool) -> DataFrame:
        block = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        # At most held_bytes once built, give or take the spread of the hash.
        held = spark.sparkContext.broadcast(WindowSet([(r.item, r.text) for r in block.toLocalIterator()], n))
        return d.mapInArrow(partial(_scan_batches, held=held, schema=to_arrow_schema(schema), text_at=text_at, hits_only=hits_only), schema)

    if blocks == 1:
        new = [T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType())), strict=True)]
        return scan(docs, 0, T.StructType([*docs.schema.fields, *new]), docs.columns.index(text_col), False)
    # What is hit depends on the text alone, so that blocks carry hits by a hash of the text.
    text = docs[f"`{text_col}`"]
    keyed = docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))
    found = None
    for k in range(blocks):
        hits = staged(scan(keyed, k, T.StructType.fromDDL(_KEYED), 1, True), "decontam-hits").dropDuplicates(["key"])
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("key").agg(F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = staged(found.mapInArrow(_merged, _KEYED), "decontam-merged")
    key, other = free_names(docs, "key", "other")
    found = found.select(F.col("key").alias(other), *[F.col(c).alias(name) for c, name in zip(_NEW, names, strict=True)])
    d = docs.withColumn(key, F.sha2(text, 256))
    d = d.join(found, d[key] == found[other], "left")  # broadcast where the table of hits is small
    n_words = F.coalesce(F.regexp_count(d[f"`{text_col}`"], F.lit(_WORD)), F.lit(0)).cast("long")
    return d.select(
        *[d[f"`{c}`"] for c in docs.columns], n_words.alias(names[0]), F.coalesce(names[1], F.lit(0).cast("long")).alias(names[1]),
        F.col(names[2]), F.coalesce(names[3], F.array().cast("array<long>")).alias(names[3]),
    )


def _cut(text: str | None, hits: bytes | None, n_words: int) -> str | None:
    if hits is None:
        return text
    raw = text.encode("utf-8", "replace")
    mask = np.unpackbits(np.frombuffer(hits, np.uint8), count=n_words).astype(bool)
    spans = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
    out, last, i = [], 0, 0
    while i < n_words:
        if not mask[i]:
            i += 1
            continue
        j = i
        while j + 1 < n_words and mask[j + 1]:
            j += 1
        out.append(raw[last : spans[i][0]])
        last, i = spans[j][1], j + 1
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the words hit.

    A run of words hit goes with what stands between them. Rows, columns and edge cases as
    in contamination().
    """
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = contamination(docs, benchmark, text_col=text_col, prefix=prefix, **options)
    if remove == "documents":
        return found.where(F.col(f"{prefix}hits").isNull()).select(*[found[f"`{c}`"] for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = F.udf(_cut, "string", useArrow=True)
    text = cut(found[f"`{text_col}`"], f"{prefix}hits", f"{prefix}n_words")
    return found.select(*[text.alias(c) if c == text_col else found[f"`{c}`"] for c in docs.columns])
