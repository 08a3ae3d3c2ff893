"""Offset-mapped token counts: encode a document once, give each token to a section.

A document's fields or sections are character spans of its whole text. The text is encoded
once; the sorted token spans are joined to the sorted sections by interval (two binary
searches), and a token that crosses a boundary goes by an explicit rule:

    "first"  to the section that holds its first character,
    "last"   to the section that holds its last character,
    "most"   to the section that holds most of its characters, the earlier one in a tie.

Characters that no section covers count as a section of their own, "" (unassigned tokens).

Scale: one pass where the text is read. Tokens never leave the task; a row returns one
count a section.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import by_size
from .encoding import span_encoder

RULES = ("first", "last", "most")


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(interval of each token, whether it crosses a boundary).

    bounds: ascending starts of the intervals that divide the text, the first 0.
    """
    last_char = np.maximum(ends - 1, starts)
    low = np.searchsorted(bounds, starts, side="right") - 1
    high = np.searchsorted(bounds, last_char, side="right") - 1
    crosses = high > low
    if rule == "first":
        return low, crosses
    if rule == "last":
        return high, crosses
    out = low.copy()
    edges = np.append(bounds, np.iinfo(np.int64).max)
    for i in np.flatnonzero(crosses).tolist():
        parts = [min(ends[i], edges[k + 1]) - max(starts[i], edges[k]) for k in range(low[i], high[i] + 1)]
        out[i] = low[i] + int(np.argmax(parts))
    return out, crosses


def divide(spans: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, section of each interval, -1 where none): sections in order, cut to the text.

    Where sections overlap, the later one keeps what is left after the earlier one.
    """
    bounds, owner, at = [], [], 0
    for k, (a, b) in sorted(enumerate(spans), key=lambda x: (x[1], x[0])):
        a, b = max(a, at), min(b, size)
        if b <= a:
            continue
        if a > at:
            bounds.append(at)
            owner.append(-1)
        bounds.append(a)
        owner.append(k)
        at = b
    if at < size or not bounds:
        bounds.append(at)
        owner.append(-1)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def _lines(text: str | None) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in (text or "").split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], out[-1][1] - 1)
    return out


def _attribute(batches: Iterator[pa.RecordBatch], path: str, text_at: int, sections_at: int | None, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder = span_encoder(path)
    for batch in by_size(batches, text_at):
        given = None if sections_at is None else batch.column(sections_at)
        out: list[list] = [[], [], [], []]
        for i, text in enumerate(batch.column(text_at).to_pylist()):
            spans = _lines(text) if given is None else [(x["start"] or 0, x["end"] or 0) for x in given[i].as_py() or [] if x]
            _, starts, ends = encoder.encode(text)
            bounds, owner = divide(spans, len(text or ""))
            interval, crosses = allocate(starts, ends, bounds, rule)
            counts = np.bincount(owner[interval] + 1, minlength=len(spans) + 1)
            for column, x in zip(out, (len(starts), int(crosses.sum()), int(counts[0]), counts[1:].tolist()), strict=True):
                column.append(x)
        kept = [batch.column(i) for i in range(batch.num_columns) if i not in (text_at, sections_at)]
        kept += [pa.array(c, f.type) for c, f in zip(out, list(schema)[-4:], strict=True)]
        yield pa.RecordBatch.from_arrays(kept, schema=schema)


def attribute(docs: DataFrame, *, tokenizer_path: str, text_col: str = "text", sections_col: str | None = None, rule: str = "first") -> DataFrame:
    """The other columns of docs, and n_tokens, n_crossing, n_unassigned, section_tokens.

    sections_col: array<struct<start, end>> in characters, end exclusive; section_tokens
    has a count for each, in the given order. Without it the sections are the text's lines,
    each with its line feed. Counts always add up to n_tokens with n_unassigned.

    Null and empty texts have no tokens, and one empty line; null sections are none, null
    bounds are 0. Sections past the text or within earlier ones hold nothing. A token that
    two sections hold equally much of goes, by the rule "most", to the earlier one. Rows are
    independent of each other, so repeated rows repeat; an empty table gives no rows. Other
    columns pass, but those that have the names of new ones are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    new = ["n_tokens", "n_crossing", "n_unassigned", "section_tokens"]
    clash = [c for c in docs.columns if c in new]
    d = docs.drop(*clash) if clash else docs  # the new columns replace columns of the same name
    kept = [f for f in d.schema.fields if f.name not in (text_col, sections_col)]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in new[:3]), T.StructField(new[3], T.ArrayType(T.LongType()))])
    sections_at = None if sections_col is None else d.columns.index(sections_col)
    work = partial(_attribute, path=tokenizer_path, text_at=d.columns.index(text_col), sections_at=sections_at, rule=rule, schema=to_arrow_schema(schema))
    return d.mapInArrow(work, schema)
