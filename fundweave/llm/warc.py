"""WARC archives with dictionary compression: write, index, read back.

Each archive is a Zstandard file: a leading skippable frame (magic 0x184D2A5D) holds a
dictionary built from records of that archive, and every record is a frame of its own, so
a record can be read alone at the offset that the index returns.

Of records with equal payloads (by SHA-1) that with the least page id is written as a
response, the others as revisits without payload that refer to it.

Scale: payloads are hashed where they are read; digests that occur twice or more, one row
each, are broadcast to the pages up to a checked number of bytes. Beyond it they are joined
to ids and digests alone, without payloads, and the payloads are joined to the revisits by
id, so that a group of equal pages is never dealt to one task. Archives are written by the task that
holds the pages, in files of at most file_bytes of records, to the shared folder, under
names that no repeated task reuses.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import join_unique, like, shared_dir, staged

DICTIONARY_FRAME = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("2b0c6a5e-7d0f-5a52-9a53-6f1c4b0f7a11")
#: A repeated digest and its first id, in a broadcast table.
_REPEAT_BYTES = 120
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
_PAGES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC/1.1 record; first: the page whose response this one revisits, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the records; of too few or too uniform records, their own last bytes."""
    size = max(256, min(size, sum(map(len, records)) // 8))
    try:
        return zstandard.train_dictionary(size, records, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    def __init__(self, store, root: str, name: str, dictionary_bytes: int, sample_bytes: int, level: int):
        self.store, self.path, self.name = store, posixpath.join(root, name), name
        self.dictionary_bytes, self.sample_bytes, self.level = dictionary_bytes, sample_bytes, level
        self.waiting: list[tuple[int | None, bytes]] = []
        self.waiting_bytes = self.raw = self.at = 0
        self.out = self.compressor = None
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.raw += len(data)
        if self.out is None:
            self.waiting.append((page_id, data))
            self.waiting_bytes += len(data)
            if self.waiting_bytes >= self.sample_bytes:
                self._open()
        else:
            self._write(page_id, data)

    def _open(self) -> None:
        held = dictionary([d for _, d in self.waiting], self.dictionary_bytes)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=held)
        self.out = self.store.open_output_stream(self.path, compression=None)
        packed = zstandard.ZstdCompressor(level=self.level).compress(held.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.at = 8 + len(packed)
        for page_id, data in self.waiting:
            self._write(page_id, data)
        self.waiting = []

    def _write(self, page_id: int | None, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.rows.append((self.name, self.at, len(frame), page_id))
        self.at += len(frame)

    def close(self) -> list[tuple]:
        if self.waiting:
            self._open()
        if self.out is not None:
            self.out.close()
        return self.rows


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, dictionary_bytes: int, sample_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    seq, archive = 0, None

    def start() -> _Archive:
        name = f"pages-{context.partitionId():06d}-{seq:05d}-{context.taskAttemptId()}.warc.zst"
        return _Archive(store, root, name, dictionary_bytes, sample_bytes, level)

    for batch in batches:
        ids, urls, sha, first = (batch.column(i) for i in (0, 1, 3, 4))
        for i in range(batch.num_rows):
            payload = (batch.column(2)[i].as_py() or "").encode("utf-8", "replace")
            digest = base64.b32encode(bytes.fromhex(sha[i].as_py())).decode()
            archive = archive or start()
            archive.add(ids[i].as_py(), record(ids[i].as_py(), urls[i].as_py(), payload, digest, first[i].as_py(), date))
            if archive.raw >= file_bytes:
                yield _rows(archive.close(), _INDEX)
                archive, seq = None, seq + 1
    if archive:
        yield _rows(archive.close(), _INDEX)


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    file_bytes: int = 256 << 20,
    dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 2 << 20,
    level: int = 3,
    broadcast_bytes: int = 32 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> tuple[DataFrame, str]:
    """Writes a record for every page; returns (index, folder).

    index: path, offset, length, page_id of every record. Equal payloads below
    min_revisit_bytes are all responses. The dictionary of an archive is built from its
    records up to sample_bytes, which bounds the writer's memory. Repeated digests are
    broadcast where they take at most broadcast_bytes.

    A null html is an empty payload; a null url is the page's own urn. Rows that repeat the
    id and payload of a response are responses too. A null id revisits a payload that some
    row with an id has, and is a response otherwise. An empty table writes no archive.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    p = like(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    body = F.coalesce("html", F.lit(""))
    p = p.withColumn("sha", F.sha1(body.cast("binary")))
    sums = p.select("page_id", "sha", F.octet_length(body).alias("size")).where(F.col("size") >= min_revisit_bytes)
    twice = sums.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = staged(twice, "warc-repeats")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    if twice.count() * _REPEAT_BYTES <= broadcast_bytes:
        todo = p.join(F.broadcast(twice.drop("n")), "sha", "left").withColumn("first", F.when(other, F.col("first")))
    else:
        sums = staged(sums.select("page_id", "sha").distinct(), "warc-sums")
        revisits = join_unique(sums, twice, ["sha"], pages.count()).where(F.col("first").isNotNull() & other)
        revisits = revisits.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first")
        todo = p.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    todo = todo.select("page_id", "url", "html", "sha", "first")
    write = partial(_write, folder=folder, file_bytes=file_bytes, dictionary_bytes=dictionary_bytes, sample_bytes=sample_bytes, level=level, date=date)
    return staged(todo.mapInArrow(write, "path string, offset long, length long, page_id long"), "warc-index"), folder


def read_dictionary(stream) -> zstandard.ZstdCompressionDict:
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    packed = stream.read(size)
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, in order."""
    reader = zstandard.ZstdDecompressor(dict_data=read_dictionary(stream)).stream_reader(stream, read_across_frames=True)
    held = bytearray()
    at = 0

    def more(size: int) -> bool:
        nonlocal at
        while len(held) - at < size:
            data = reader.read(1 << 20)
            if not data:
                return False
            del held[:at]
            at = 0
            held.extend(data)
        return True

    while more(1):
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more(len(held) - at + 1):
                raise ValueError("an archive ends within a record")
        lines = held[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        at = end + 4
        if not more(size + 4):
            raise ValueError("an archive ends within a record")
        yield fields, bytes(held[at : at + size])
        at += size + 4


def _page(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it names")
    page, first = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    return (
        None if page is None else int(page), size, digest, kind, None if first is None else int(first),
        fields["WARC-Target-URI"], payload if with_payload and kind == "response" else None,
    )


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, size = [], 0
            with store.open_input_stream(posixpath.join(root, path), compression=None) as stream:
                for fields, block in read_archive(stream):
                    rows.append(_page(fields, block, with_payload))
                    size += 100 + (len(block) if with_payload else 0)
                    if size > 4 << 20:
                        yield _rows(rows, _PAGES)
                        rows, size = [], 0
            yield _rows(rows, _PAGES)


def read_archives(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """A row a record, read from the archives that the index lists; digests are verified.

    payload is that of responses, if asked for; revisits have none.
    """
    files = index.select("path").distinct()
    files = files.repartition(max(1, files.count()), "path")  # a number, so that they stay apart
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return files.mapInArrow(partial(_read, folder=folder, with_payload=with_payload), schema)
