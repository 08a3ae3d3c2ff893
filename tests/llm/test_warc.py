"""Archives as an exact round trip; records readable alone; equal payloads as revisits."""

import base64
import hashlib
import random

import pytest
import zstandard
from pyarrow import fs

from fundweave.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(3)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_round_trip(spark, limit):
    r = random.Random(1)
    bodies = [None, "", "<p>é😀</p>\r\n\r\n", "WARC/1.1\r\nContent-Length: 9\r\n\r\n", "x" * 300_000] + [
        "<html>" + " ".join(r.choice(["alpha", "beta", "<b>", "</b>"]) for _ in range(80)) for _ in range(60)
    ]
    rows = [(i, f"http://e.org/{i}" if i % 5 else None, b) for i, b in enumerate(bodies)]
    rows += [(100 + i, "http://e.org/a\r\nb", bodies[i % 7]) for i in range(30)] + [(3, "u", bodies[3]), (None, "u", bodies[9]), (None, None, "alone")]
    index, folder = warc.write_archives(_pages(spark, rows), file_bytes=20_000, sample_bytes=8_000, broadcast_bytes=limit)
    assert index.select("path").distinct().count() > 3
    got = sorted((tuple(x[:5]) for x in warc.read_archives(index, folder).collect()), key=str)
    first: dict = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    want = []
    for i, _, b in rows:
        data, f = (b or "").encode(), first.get(b or "")
        again = f is not None and i != f
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)
    payloads = {x.page_id: bytes(x.payload) for x in warc.read_archives(index, folder, with_payload=True).collect() if x.record_type == "response"}
    assert all(payloads[i] == b.encode() for b, i in first.items())
    # Each record is a frame that can be read alone, with the dictionary in the leading frame.
    store, root = fs.FileSystem.from_uri(folder)
    row = index.where("page_id = 5").first()
    with store.open_input_file(f"{root}/{row.path}") as f:
        held = warc.read_dictionary(f)
        f.seek(row.offset)
        data = zstandard.ZstdDecompressor(dict_data=held).decompress(f.read(row.length))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response") and bodies[5].encode() in data


def test_short_payloads_may_stay_responses_and_no_pages(spark):
    pages = _pages(spark, [(1, "a", "same"), (2, "b", "same"), (3, "c", "s"), (4, "d", "s")])
    index, folder = warc.write_archives(pages, min_revisit_bytes=2)
    assert {x.page_id: x.record_type for x in warc.read_archives(index, folder).collect()} == {1: "response", 2: "revisit", 3: "response", 4: "response"}
    index, folder = warc.write_archives(pages.limit(0))
    assert warc.read_archives(index, folder).count() == 0
