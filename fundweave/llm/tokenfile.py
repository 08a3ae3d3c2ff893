"""Token-ID files: canonical length-limited Huffman coding of ids from global counts.

A file holds whole documents in ascending id order:

    "FWTK", version u32, header size u32, header JSON (block and checkpoint sizes, numbers
    of documents, ids and blocks), code lengths (zlib), documents (ids and token counts,
    zlib), then blocks. A block: ids u32, bits u32, payload bytes u32, the bit offsets u32
    of its checkpoints, payload. Blocks are coded independently of each other.

Scale: texts are encoded once and their ids staged; the counts are summed map-side and at
most one number an id of the vocabulary reaches the driver. Ids are range-partitioned by
document id, each partition writes files of at most file_tokens ids (a longer document
has a file of its own), and files are read back one a task.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import huffman
from .batches import by_size
from .encoding import word_encoder
from .staging import like, shared_dir, staged

MAGIC = b"FWTK"
_IDS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
_FILES = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_DOCS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_CHUNK = 4 << 20
#: Bytes of text that are encoded at once: each distinct piece of them is looked up once.
_TEXTS = 4 << 20
#: Blocks that are decoded at once.
_TOGETHER = 16


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    size = np.dtype(encoder.kind).itemsize
    for batch in by_size(batches, 1, _TEXTS):
        ids = encoder.encode_batch(batch.column(1).to_pylist(), end_id)
        n = pa.array([len(x) // size for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], schema=_IDS)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def encoded(docs: DataFrame, *, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """id, n, ids (2 or 4 bytes an id). A null text has the end id alone."""
    d = like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    return d.mapInArrow(partial(_encode, path=tokenizer_path, end_id=end_id), "id long, n long, ids binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in by_size(batches, 2):
        # Counted once a batch: the counts are as many as the vocabulary has ids.
        ids = [_unpack(data, n) for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        c = np.bincount(np.concatenate(ids))
        if len(c) > len(total):
            total = np.pad(total, (0, len(c) - len(total)))
        total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], schema=_COUNTS)


class _Writer:
    """Collects whole documents for one file."""

    def __init__(self, lengths: np.ndarray, block: int, every: int):
        self.lengths, self.code, self.block, self.every = lengths, huffman.codes(lengths), block, every
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.tokens, self.seq = [], [], [], 0
        self.body, self.blocks, self.total, self.waiting = io.BytesIO(), 0, 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc)
        self.counts.append(len(ids))
        self.tokens.append(ids)
        self.total += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 8 * self.block:
            self._emit(False)

    def _emit(self, everything: bool) -> None:
        ids = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint32)
        upto = len(ids) if everything else len(ids) // self.block * self.block
        for i in range(0, upto, self.block):
            part = ids[i : i + self.block]
            checkpoints, bits, data = huffman.encode(part, self.lengths, self.code, self.every)
            self.body.write(struct.pack("<III", len(part), bits, len(data)) + checkpoints.astype("<u4").tobytes() + data)
            self.blocks += 1
        self.tokens = [ids[upto:]]
        self.waiting = len(ids) - upto

    def finish(self) -> bytes:
        self._emit(True)
        table = zlib.compress(self.lengths.tobytes())
        known = np.array([x is not None for x in self.ids], np.uint8)
        docs = zlib.compress(known.tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        head = json.dumps({"block": self.block, "every": self.every, "docs": len(self.ids), "tokens": self.total, "blocks": self.blocks, "table": len(table), "doc_table": len(docs)}).encode()
        return b"".join([MAGIC, struct.pack("<II", 1, len(head)), head, table, docs, self.body.getvalue()])


def _write(batches: Iterator[pa.RecordBatch], folder: str, held, block: int, every: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    writer, rows, seq = _Writer(np.frombuffer(zlib.decompress(held.value), np.uint8), block, every), [], 0

    def close() -> None:
        nonlocal seq
        # The attempt is part of the name: a repeated task never touches a listed file.
        name, data = f"ids-{part:06d}-{seq:05d}-{attempt}.fwtk", writer.finish()
        with store.open_output_stream(posixpath.join(root, name), compression=None) as out:
            out.write(data)
        rows.append((part, seq, name, len(writer.ids), writer.total, len(data)))
        seq += 1
        writer.clear()

    for batch in by_size(batches, 2):
        for doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if writer.ids and writer.total + n > file_tokens:
                close()
            writer.add(doc, _unpack(data, n))
    if writer.ids:
        close()
    columns = list(zip(*rows, strict=True)) or [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILES, strict=True)], schema=_FILES)


def write_ids(tokens: DataFrame, folder: str, *, max_bits: int = 20, block: int = 1 << 16, every: int = 256, file_tokens: int = 1 << 24) -> DataFrame:
    """Writes encoded() rows to folder; returns the files (part, seq, path, docs, tokens, bytes, base).

    base: the ids in all files before this one. Rows that share an id follow each other in
    the order of a hash of their ids; a null id comes last. tokens must be a written table.
    """
    counts = tokens.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    used = counts.collect()  # a row an id of the vocabulary at most
    freq = np.zeros(max((r.token for r in used), default=0) + 1, np.int64)
    for r in used:
        freq[r.token] = r.n
    lengths = huffman.code_lengths(freq, max_bits)
    held = tokens.sparkSession.sparkContext.broadcast(zlib.compress(lengths.tobytes()))
    # The ranges are cut by id and a hash of the ids: the sample that finds them goes to the driver.
    order = [F.col("id").asc_nulls_last(), F.xxhash64("ids").asc()]
    ranged = tokens.repartitionByRange(*order).sortWithinPartitions(*order, F.col("ids").asc())
    write = partial(_write, folder=folder, held=held, block=block, every=every, file_tokens=file_tokens)
    files = staged(ranged.mapInArrow(write, "part long, seq long, path string, docs long, tokens long, bytes long"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return staged(files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-manifest")


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) in file order."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    _, size = struct.unpack_from("<II", data, 4)
    at = 12 + size
    head = json.loads(data[12:at])
    decoder = huffman.Decoder(np.frombuffer(zlib.decompress(data[at : at + head["table"]]), np.uint8))
    at += head["table"]
    docs = zlib.decompress(data[at : at + head["doc_table"]])
    at += head["doc_table"]
    n = head["docs"]
    known, ids, counts = np.frombuffer(docs, np.uint8, n), np.frombuffer(docs, "<i8", n, n), np.frombuffer(docs, "<i8", n, 9 * n)
    parts: list[np.ndarray] = []
    have = 0
    blocks = head["blocks"]
    every = head["every"]
    for doc, there, count in zip(ids.tolist(), known.tolist(), counts.tolist(), strict=True):
        while have < count:
            if not blocks:
                raise ValueError("a token file ends early")
            found, bits, several = [], [], min(blocks, _TOGETHER)
            for _ in range(several):
                tokens, _, size = struct.unpack_from("<III", data, at)
                marks = -(-tokens // every)
                # Payloads are whole words, so that bits count on from one to the next.
                bits.append(np.frombuffer(data, "<u4", marks, at + 12).astype(np.int64) + 8 * sum(len(x) for _, x in found))
                at += 12 + 4 * marks
                found.append((tokens, data[at : at + size]))
                at += size
            flat = decoder.decode(b"".join(x for _, x in found), np.concatenate(bits), every * sum(map(len, bits)), every)
            for (tokens, _), b in zip(found, bits, strict=True):
                parts.append(flat[:tokens])
                flat, have = flat[every * len(b) :], have + tokens
            blocks -= several
        flat = np.concatenate(parts) if len(parts) != 1 else parts[0]
        yield (doc if there else None), flat[:count]
        parts, have = [flat[count:]], have - count


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_stream(posixpath.join(root, path), compression=None) as f:
                data = f.read()
            rows, size = [], 0
            for doc, ids in read_file(data):
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, base, len(ids), raw if with_ids else struct.pack(">I", zlib.crc32(raw))))
                base, size = base + len(ids), size + (len(raw) if with_ids else 40)
                if size >= _CHUNK:
                    yield _docs(rows)
                    rows, size = [], 0
            if rows:
                yield _docs(rows)


def _docs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOCS, strict=True)], schema=_DOCS)


def read_ids(files: DataFrame, folder: str, *, with_ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids (u32) of every document in the listed files.

    with_ids=False: ids holds the CRC-32 of those bytes (4 bytes, big-endian) instead.
    """
    spark = files.sparkSession
    n = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    f = files.select("path", "base").repartition(n, "path")
    return f.mapInArrow(partial(_read, folder=folder, with_ids=with_ids), "id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encodes whole texts, writes the files and returns (files, folder).

    Null and empty texts are documents of the end id alone. A null id comes last. Rows
    that repeat an id are documents of their own. An empty table gives no file. Other
    columns play no part.
    """
    folder = folder or shared_dir(docs.sparkSession, "token-ids")
    tokens = staged(encoded(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path, end_id=end_id), "tokens")
    return write_ids(tokens, folder), folder


def document_digests(files: DataFrame, folder: str, id_name: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32, read back from the files."""
    crc = F.conv(F.hex("ids"), 16, 10).cast("long")
    return read_ids(files, folder, with_ids=False).select(F.col("id").alias(id_name), "start", "n_tokens", crc.alias("ids_crc32"))
