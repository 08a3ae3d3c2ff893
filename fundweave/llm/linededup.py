"""Line dedup: keep bitmaps from one sorted stream of line hashes.

Every line long enough becomes (hash, document, position). The hashes are range-partitioned
with document and position as secondary keys and sorted, so each partition streams its
hashes, sees the first document of each, and gives out the positions that go elsewhere.
Those are gathered by document into a compressed bitmap of the lines to keep. Up to there
no text moves; only who wants the remaining text joins it to its bitmap.

Scale: the ranges are cut on (hash, document, position), so even one line that stands in a
third of all documents is spread over many partitions. A hash that goes on from one
partition to the next is settled by a table of one row a partition: of a partition's first
hash, the first document waits until the last hashes of the others are known. Rows are told
apart by id and a hash of their text, so that rows without an id do not meet in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .staging import like, staged

_STRIP = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
_FIRST = pa.schema([("kind", pa.int8()), *_LINES])
DROP, WAIT, LAST = 0, 1, 2


def line_keys(text: str | None, min_chars: int) -> tuple[int, list[tuple[int, bytes]]]:
    """(number of lines, (position, key hash) of the lines long enough)."""
    lines = (text or "").encode("utf-8", "replace").lower().split(b"\n")
    found = []
    for i, line in enumerate(lines):
        key = line.strip(_STRIP)
        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
            found.append((i, hashlib.blake2b(key, digest_size=16).digest()))
    return len(lines), found


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, 2):
        at, many, pos, keys = [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            n, found = line_keys(text, min_chars)
            for p, key in found:
                at.append(i)
                many.append(n)
                pos.append(p)
                keys.append(key)
        h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(many, pa.int64()), pa.array(pos, pa.int64())], schema=_LINES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines -> DROP rows; WAIT: of the first hash those of its first document; LAST: the last hash and its first document."""
    held: tuple | None = None  # hash and first document of the run that is open
    opening: tuple | None = None  # those of the partition's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        doc = batch.column(2).fill_null(0).to_numpy()
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = held is not None and (h1[0], h2[0]) == held[:2]
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        first, first_null = doc[starts], null[starts]
        if goes_on:
            first[0], first_null[0] = held[2:]
        opening = opening or (h1[0], h2[0])
        drop = (doc != first[run]) | (null != first_null[run])
        wait = ~drop & (h1 == opening[0]) & (h2 == opening[1])
        for kind, rows in ((WAIT, wait), (DROP, drop)):
            if rows.any():
                found = batch.filter(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, kind, np.int8)), *found.columns], schema=_FIRST)
        held = (h1[-1], h2[-1], first[-1], first_null[-1])
    if held is not None:
        values = [LAST, *held[:2], None if held[3] else held[2], None, None, None]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FIRST, strict=True)], schema=_FIRST)


def _row(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row, text. row: a hash of the text; rows of equal id and text lose the same lines."""
    d = like(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc", _row(F.col("text")).alias("row"), "text")


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, row, n, pos): the lines that go, and how many their text has."""
    names = "doc long, row long, n long, pos long"
    rows = _rows_of(docs, id_col, text_col).mapInArrow(partial(_lines, min_chars=min_chars), f"h1 long, h2 long, {names}")
    order = [F.col("h1"), F.col("h2"), F.col("doc").asc_nulls_last(), F.col("pos")]
    # Written first, as the sample that cuts the ranges reads the rows a second time.
    ranged = staged(rows, "line-keys").repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ranged.mapInArrow(_stream, f"kind byte, h1 long, h2 long, {names}"), "line-firsts")
    last = found.where(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    wait = found.where(F.col("kind") == WAIT).join(last, ["h1", "h2"])
    # The least document of a hash that goes over partitions ends one of them.
    wait = wait.where(F.col("least").isNotNull() & (F.col("doc").isNull() | (F.col("least") < F.col("doc"))))
    columns = ["doc", "row", "n", "pos"]
    return found.where(F.col("kind") == DROP).select(*columns).unionByName(wait.select(*columns))


_PACKED = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
_PACKED_DDL = "doc long, row long, n_lines long, n_dropped long, keep binary"


def _bits(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, n, positions) -> (doc, row, n_lines, n_dropped, keep)."""
    for batch in batches:
        dropped, keeps = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            keep = np.ones(n, bool)
            keep[gone.values.to_numpy()] = False
            dropped.append(n - int(keep.sum()))
            keeps.append(_bits(keep))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())], schema=_PACKED)


def lossy_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, row, n_lines, n_dropped, keep: one row for each id and text that loses lines."""
    gone = dropped_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    gone = gone.groupBy("doc", "row", "n").agg(F.collect_set("pos").alias("positions"))  # a text's own lines
    return gone.mapInArrow(_pack, _PACKED_DDL)


def _with_bitmaps(d: DataFrame, lossy: DataFrame) -> DataFrame:
    """d (doc, row, ...) with n_dropped and keep, null where no line goes."""
    x = lossy.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "n_dropped", "keep")
    found = d.join(x, d["doc"].eqNullSafe(x["_doc"]) & (d["row"] == x["_row"]), "left")
    return found.drop("_doc", "_row").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))


def _n_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps = [k or _bits(np.ones(n, bool)) for n, k in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keeps, pa.binary())], schema=_PACKED)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, row, n_lines, n_dropped, keep: one row a document; row is a hash of its text.

    keep: zlib-compressed packed bits, a bit a line. A line's key is the line without ASCII
    white space at both ends, A-Z in lower case; shorter keys than min_chars stay. A key in
    two documents or more goes from all but the least id. A null or empty text is one empty
    line. Rows that repeat an id are one document to this rule, and each has its own
    bitmap. A null id comes after all others. An empty table gives no rows; other columns,
    whatever their names, play no part.
    """
    lossy = lossy_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    d = _rows_of(docs, id_col, text_col).select("doc", "row", _n_lines(F.col("text")).alias("n_lines"))
    return _with_bitmaps(d, lossy).select("doc", "row", "n_lines", "n_dropped", "keep").mapInArrow(_fill, _PACKED_DDL)


def _kept(text: str | None, keep: bytes | None) -> str | None:
    if keep is None:
        return None
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by a line feed; without a bitmap, the text."""
    # A text that stays whole is not sent to the function.
    cut = F.udf(_kept, "string", useArrow=True)(F.when(keep.isNotNull(), text), keep)
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)


def kept_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, n_lines, n_dropped, text of the lines that stay: each text joined to its bitmap."""
    lossy = lossy_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    d = _with_bitmaps(_rows_of(docs, id_col, text_col), lossy)
    text = kept_text(F.col("text"), F.col("keep"))
    return d.select("doc", _n_lines(F.col("text")).alias("n_lines"), "n_dropped", text.alias("text"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with the lines that stay as text; all columns kept, a null text becomes empty (see keep_bitmaps)."""
    lossy = lossy_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in name.items()])
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    d = d.withColumns({"doc": F.col(name[id_col]).cast("long"), "row": _row(text)})
    found = _with_bitmaps(d, lossy)
    kept = kept_text(text, F.col("keep"))
    return found.select(*[(kept if c == text_col else F.col(n)).alias(c) for c, n in name.items()])
