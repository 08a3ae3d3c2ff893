"""SimHash near-dedup with a byte-position inverted index and count filtering.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their eight
bytes, so they share at least 8 - d bytes at the same positions: the guaranteed minimum.
The index posts every distinct fingerprint under each choice of 7 - d (position, byte)
pairs. Fingerprints that meet in a list have the shared positional bytes of their pair
tallied; pairs below the guaranteed minimum are dropped, the others verified bit by bit. A
pair is settled in one list only, that of the first choice of positions it shares.

Lists are keyed by one byte less than the minimum, not by a single byte: a list of one of
the 8 x 256 single bytes holds a 256th of all fingerprints, so that tallying its pairs
would grow with the square of the table.

Scale: copies share a fingerprint and are posted once, so a group of copies, however large,
is one entry. In a list of more than 64 entries the tally goes on byte by byte: it is cut by
one more shared byte, and only entries that have reached the minimum are compared; where
those are still more than 64 (65,536 values of d bytes at most), each looks up the values
within d bits of its own. Every list returns a spanning forest of its links, never all
pairs.

near_duplicates() is the general form for similarity of word shingles: see there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .components import components
from .staging import free_names, join_unique, like, staged

SEED = 42
_SMALL = 64
_PRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str | None, words: int) -> list[bytes]:
    """Lower-cased (A-Z) word shingles, repeats included; a shorter text is one shingle."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return []
    if len(ws) <= words:
        return [b" ".join(ws)]
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist()
    starts = [0, *ends]
    return [joined[s : e - 1] for s, e in zip(starts, ends[words - 1 :], strict=False)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(text, words)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; 0 without hashes. Signed 64 bits."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _print_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, 1):
        fps = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=_PRINTS)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row, over whole texts."""
    d = like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    return d.mapInArrow(partial(_print_batches, words=words), "id long, fp long")


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _near_pairs(run: np.ndarray, fp: np.ndarray, most: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, positions shared) of entries of one run, at most `most` long, that pass the tally and the bits."""
    for k in range(1, most):
        same = np.flatnonzero(run[k:] == run[:-k])
        if not len(same):
            return
        x = fp[same] ^ fp[same + k]
        shared = np.stack([(x >> np.uint64(8 * p)) & np.uint64(255) == 0 for p in range(8)], 1)
        good = (shared.sum(1) >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)
        yield same[good], same[good] + k, shared[good]


def _probe(fp: np.ndarray, free: list[int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of each entry to the least of its component: looks up all values within max_bits."""
    order = np.argsort(fp)
    fp = fp[order]
    bits = [np.uint64(1) << np.uint64(8 * p + i) for p in free for i in range(8)]
    flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, max_bits + 1) for c in combinations(bits, k)]
    hops = []
    for f in flips:
        at = np.minimum(np.searchsorted(fp, fp ^ f), len(fp) - 1)
        here = np.flatnonzero(fp[at] == (fp ^ f))
        if len(here):
            hops.append((here, at[here]))
    label = np.arange(len(fp))
    while True:
        before = label.copy()
        for here, there in hops:
            label[here] = np.minimum(label[here], label[there])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return order[moved], order[label[moved]]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff([*starts, len(new)])


def _large_list(fp: np.ndarray, choice: tuple[int, ...], max_bits: int) -> list[tuple[int, int]]:
    """Links (i, j) of a long list: cut by each further byte that a pair may share."""
    links = []
    free = [p for p in range(8) if p not in choice]
    for p in free:
        byte = (fp >> np.uint64(8 * p)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        starts, sizes = _runs(byte[order])
        small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
        at, run = order[small], np.repeat(np.arange(len(sizes)), sizes)[small]
        for i, j, _ in _near_pairs(run, fp[at], min(_SMALL, int(sizes.max())), max_bits):
            links += zip(at[i].tolist(), at[j].tolist(), strict=True)
        for k in np.flatnonzero(sizes > _SMALL).tolist():
            at = order[starts[k] : starts[k] + sizes[k]]
            i, j = _probe(fp[at], [q for q in free if q != p], max_bits)
            links += zip(at[i].tolist(), at[j].tolist(), strict=True)
    return links


def _settle(c: np.ndarray, fp: np.ndarray, choices: list[tuple[int, ...]], masks: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Sorted entries of whole lists -> a spanning forest of the links of each."""
    starts, sizes = _runs(c, fp & masks[c])
    a, b = [], []
    for i in np.flatnonzero(sizes > _SMALL).tolist():
        part = fp[starts[i] : starts[i] + sizes[i]]
        for x, y in _forest(_large_list(part, choices[c[starts[i]]], max_bits)):
            a.append(part[x])
            b.append(part[y])
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    run, fp, c = np.repeat(np.arange(len(starts)), sizes)[small], fp[small], c[small]
    links: dict[int, list] = {}
    most = int(sizes[(sizes > 1) & (sizes <= _SMALL)].max(initial=1))
    for i, j, shared in _near_pairs(run, fp, most, max_bits):
        for x, y, s in zip(i.tolist(), j.tolist(), shared, strict=True):
            if choices[c[x]] == tuple(np.flatnonzero(s).tolist())[: 7 - max_bits]:
                links.setdefault(int(run[x]), []).append((x, y))
    for found in links.values():
        for x, y in _forest(found):
            a.append(fp[x])
            b.append(fp[y])
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], schema=_LINKS)


def _list_links(batches: Iterator[pa.RecordBatch], choices: list[tuple[int, ...]], masks: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """(choice, fp), sorted by choice and key -> links within each list."""
    c, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        c = np.concatenate([c, batch.column(0).to_numpy().astype(np.int64)])
        fp = np.concatenate([fp, batch.column(1).to_numpy().astype(np.int64).view(np.uint64)])
        if not len(c):
            continue
        # The last list may go on in the next batch.
        key = fp & masks[c]
        upto = int(np.flatnonzero((c != c[-1]) | (key != key[-1])).max(initial=-1)) + 1
        if upto:
            yield _settle(c[:upto], fp[:upto], choices, masks, max_bits)
            c, fp = c[upto:], fp[upto:]
    if len(c):
        yield _settle(c, fp, choices, masks, max_bits)


def fingerprint_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, node) with distinct fp -> links (a, b) between nodes, spanning all pairs within max_bits."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits is 1, 2 or 3: the guaranteed minimum of shared bytes must leave selective lists")
    choices = list(combinations(range(8), 7 - max_bits))
    masks = np.array([sum(255 << (8 * p) for p in choice) for choice in choices], np.uint64)
    posted = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks.view(np.int64).tolist()])).alias("c", "mask"))
    posted = posted.select(F.col("c").cast("byte").alias("c"), "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    lists = posted.repartition("c", "key").sortWithinPartitions("c", "key").select("c", "fp")
    links = lists.mapInArrow(partial(_list_links, choices=choices, masks=masks, max_bits=max_bits), "a long, b long")
    for end in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    return links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row.

    component_id: the least id reachable over fingerprints that differ in max_bits bits or
    fewer, its own included. Null, empty and blank texts have fingerprint 0, linked like any
    other. A row with a null id links nothing; its component is that of its fingerprint, or
    null where no row with an id has it. Repeated rows each return a row. An empty table
    gives no rows; other columns play no part.
    """
    prints = staged(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    every = staged(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    nodes = every.where("node is not null")  # that is, of a row with an id
    of = components(fingerprint_links(nodes, max_bits))
    classes = every.join(of, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n")
    classes = staged(classes, "fingerprint-classes")
    return join_unique(prints, classes, ["fp"], prints.count()).select("id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Similarity of word shingles ------------------------------------------------------------
#
# A SimHash link of two or three bits stands for a shingle overlap of about 0.97 or more.
# Below that the expected difference grows past eight bits (about ten at a Jaccard
# similarity of 0.8), where no positional byte need be shared and the count filter has no
# minimum to guarantee. near_duplicates() therefore adds to the links of the fingerprints
# those of banded minima of the same shingle hashes, and verifies all of them exactly.

BANDS, ROWS = 16, 4
_ALL_PAIRS_UPTO = 8
#: Texts and bytes of shingles in a block of a long list, and shingles compared at once.
_BLOCK, _BLOCK_BYTES, _COLUMNS = 256, 8 << 20, 4096
_KEYS = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """For each band, a hash of the least values of its rows' permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            part = hashes[i : i + 2048]
            x = part[None] * _MULTIPLIERS[:, None]
            x ^= x >> np.uint64(32)
            least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(1))
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def _key_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, 1):
        rows: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            whole = b" ".join((text or "").encode("utf-8", "replace").lower().split())
            h1, h2 = np.frombuffer(hashlib.blake2b(whole, digest_size=16).digest(), "<i8").tolist()
            hashes = shingle_hashes(text, words)
            for column, x in zip(rows, (h1, h2, fingerprint(hashes), band_keys(hashes)), strict=True):
                column.append(x)
        columns = [pa.array(c, f.type) for c, f in zip(rows, list(_KEYS)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_KEYS)


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    for batch in by_size(batches, 1):
        sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= similarity * (len(x) + len(y) - both))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=_LINKS)


def _band_lists(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n, low, high) of the lists of two and more texts that share a band; low and high lead."""
    posted = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("node", "band").alias("h"), "node")
    lists = posted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("low"), F.max(order).alias("high")).where("rows > 1")
    lists = staged(lists.withColumn("n", F.col("rows")), "near-bands")
    return posted.join(lists.drop("rows"), ["band", "key"])


def _band_pairs(at: DataFrame) -> DataFrame:
    """Pairs that share a band: all of a short list; of a longer one each with two leaders.

    The leaders are drawn anew for each band by a hash, so that a group of near copies is
    joined over many stars without ever emitting all of its pairs. What they leave apart is
    compared by _rest_links().
    """
    long = at.where(F.col("n") > _ALL_PAIRS_UPTO).select(F.explode(F.array("low.node", "high.node")).alias("a"), F.col("node").alias("b"))
    short = at.where(F.col("n") <= _ALL_PAIRS_UPTO).groupBy("band", "key").agg(F.collect_list("node").alias("l"))  # at most 8
    short = short.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    return long.unionByName(short)


def _block_links(group: pa.Table, similarity: float) -> pa.Table:
    """Rows (i, j, block, c, shingles) of two blocks, or of one -> a spanning forest of the links between their components c."""
    c, block = group.column("c").to_numpy(), group.column("block").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sizes = np.array([len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    column, row = (np.cumsum(counts > 1) - 1)[at[shared]], np.repeat(np.arange(len(sets)), sizes)[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(left), len(right)))
    for first in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        s = slice(*np.searchsorted(column, (first, first + _COLUMNS)))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[row[s], column[s] - first] = 1
        both += has[left] @ has[right].T
    good = both >= similarity * (sizes[left][:, None] + sizes[right][None] - both)
    x, y = np.nonzero(good & (c[left][:, None] != c[right][None]))
    pairs = np.unique(np.stack([c[left[x]], c[right[y]]], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    a, b = zip(*kept, strict=True) if (kept := _forest([tuple(p) for p in pairs.tolist()])) else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _rest_links(at: DataFrame, sets: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of components that hold a pair of a long list within the similarity and are still apart.

    Of each long list with more than one component, the texts outside its largest component
    are compared with all of the list. Both parts are dealt into blocks bounded by rows and
    bytes; a task compares two blocks, and returns links of components, not pairs of texts.
    """
    long = at.where(F.col("n") > _ALL_PAIRS_UPTO).select("band", "key", "node").join(of, "node", "left")
    long = long.select("band", "key", "node", F.coalesce("component", "node").alias("c"))
    apart = long.groupBy("band", "key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("band", "key", "n")
    apart = staged(apart, "near-apart-lists")
    size = sets.groupBy("node").agg(F.sum(F.length("shingles")).alias("size"))
    long = staged(join_unique(long, apart, ["band", "key"], at.count()).join(size, "node"), "near-apart")
    parts = long.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "c"))
    lists = parts.groupBy("band", "key").agg(most["c"].alias("main"), most["n"].alias("n_main"), F.sum("n").alias("n"), F.max_by("size", F.struct("n", "c")).alias("size_main"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_BYTES), F.lit(1))
    lists = lists.select("band", "key", "main", "n", blocks(F.col("n_main"), F.col("size_main")).alias("k"), blocks(F.col("n") - F.col("n_main"), F.col("size") - F.col("size_main")).alias("r"))
    lists = staged(lists, "near-apart-blocks")
    h, main = F.xxhash64("node", "band"), F.col("c") == F.col("main")
    dealt = join_unique(long, lists, ["band", "key"], long.count()).withColumn("block", F.when(main, F.pmod(h, "k")).otherwise(F.col("k") + F.pmod(h, "r")))
    # Blocks of the largest component meet the others only, those meet all.
    others = F.sequence(F.when(main, F.col("k")).otherwise(F.lit(0)), F.col("k") + F.col("r") - 1)
    asked = dealt.select("band", "key", "node", "c", "block", F.explode(others).alias("o"))
    asked = asked.select("band", "key", "node", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    whole = asked.join(sets, "node").select("band", "key", "i", "j", "block", "c", "shingles")
    return whole.groupBy("band", "key", "i", "j").applyInArrow(lambda group: _block_links(group, similarity), "a long, b long")


def _id_links(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of ids that repeat with different texts."""
    text = F.struct("h1", "h2")
    several = keys.groupBy("id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("id")
    of = keys.join(several, "id").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node").distinct()
    return of.join(of.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of every row that has an id.

    Rows with the same words are copies. Texts whose sets of shingles have a Jaccard
    similarity of at least `similarity` are linked; component_id is the least id reachable.
    Candidates: SimHash fingerprints within two bits, and shared bands of minima (at 0.8 a
    pair shares one with a probability of 0.9998); each is verified on the whole sets,
    unless its texts are joined over others. The length of a list plays no part.

    Texts without words are copies of each other. The texts of one id are one document and
    are linked, so that an id has one component. A row with a null id is left out. An
    empty table gives no rows; other columns play no part.
    """
    d = like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text").where("id is not null")
    keys = staged(d.mapInArrow(partial(_key_batches, words=words), "id long, h1 long, h2 long, fp long, bands array<long>"), "near-keys")
    copies = keys.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    nodes = staged(copies, "near-nodes")
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "near-prints")
    same = join_unique(nodes.select("fp", F.col("node").alias("b")), prints.select("fp", F.col("node").alias("a"), "n"), ["fp"], nodes.count()).select("a", "b")
    at = staged(_band_lists(nodes), "near-lists")
    pairs = fingerprint_links(prints).unionByName(same).unionByName(_band_pairs(at))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = staged(pairs, "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # The lists of ids in both joins with the texts grow with the table: never broadcast.
    texts = d.join(asked.hint("merge"), d["id"] == F.col("node"), "left_semi")
    sets = texts.mapInArrow(partial(_set_batches, words=words), "node long, shingles binary")
    sets = staged(sets.dropDuplicates(["node", "shingles"]), "near-sets")
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    links = x.mapInArrow(partial(_verify, similarity=similarity), "a long, b long")
    stars = staged(components(links), "near-stars")
    rest = _rest_links(at, sets, stars, similarity)
    joined = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    of = components(joined.unionByName(rest).unionByName(_id_links(keys, nodes)))
    classes = nodes.join(of, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"), "n")
    return join_unique(keys, staged(classes, "near-classes"), ["h1", "h2"], keys.count()).select("id", "component_id")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the least id.

    Rows that repeat an id are one document. Rows with a null id stay. All columns are kept.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    (name,) = free_names(docs, "near_id")
    gone = found.groupBy("id").agg(F.min("component_id").alias("c")).where("c <> id").select(F.col("id").alias(name))
    gone = staged(gone, "near-gone")
    return docs.join(gone.hint("merge"), docs[f"`{id_col}`"].cast("long") == gone[name], "left_anti")
