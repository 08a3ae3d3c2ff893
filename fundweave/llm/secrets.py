"""Secret scans with a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regular expression: what
any match must contain. Documents are indexed in segments of some megabytes, each by the
task that reads them: postings of the trigrams that the queries name, folded to lower
case. Intersecting and uniting postings gives the candidates of a rule, which the
expression then verifies on the whole text. A rule without mandatory trigrams is run on
every document.

Scale: a segment is indexed where it is read and nothing is shuffled; memory is that of a
segment, whatever the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .staging import like


class Rule(NamedTuple):
    """Matches, leftmost and not overlapping; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query: True (everything), a trigram, or ("and" | "or", queries).
_MOST = 64


def _both(a, b):
    return b if a is True else a if b is True else ("and", [a, b])


def _either(parts: list):
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """Some one of the strings occurs."""
    parts = []
    for s in sorted(strings):
        query = True
        for i in range(len(s) - 2):
            query = _both(query, s[i : i + 3])
        parts.append(query)
    return _either(parts)


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the strings it matches, folded, if few; else None, what every match contains)."""
    exact: set[str] | None = {""}
    whole, query = True, True  # whole: nothing but exact so far

    def flush() -> None:
        nonlocal exact, whole, query
        query = _both(query, _of_strings(exact))
        exact, whole = {""}, False

    for op, arg in tree:
        found: set[str] | None = None
        inner = True
        if op is sre.LITERAL:
            found = {chr(arg).lower()} if arg < 128 else None
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is sre.LITERAL and x < 128:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 4:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            found = chars if chars and len(chars) <= 4 else None
        elif op is sre.SUBPATTERN:
            found, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= _MOST:
                found = set().union(*(p[0] for p in parts))
            else:
                inner = _either([p[1] if p[0] is None else _of_strings(p[0]) for p in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            strings, contains = _walk(body)
            if strings is not None and most <= 4 and least <= 4:
                found, power = set(), {""}
                for k in range(int(most) + 1):
                    if k >= least:
                        found |= power
                    power = {a + b for a in power for b in strings}
                    if len(power) > _MOST:
                        found = None
                        break
            if found is None and least:
                inner = _of_strings(strings) if strings is not None else contains
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            continue  # matches nothing itself
        if found is not None and exact is not None and len(exact) * len(found) <= _MOST:
            exact = {a + b for a in exact for b in found}
        else:
            flush()
            if found is not None:
                exact = found
            else:
                query = _both(query, inner)
                exact = {""}
    if whole:
        return exact, _of_strings(exact)
    flush()
    return None, query


def trigram_query(pattern: str):
    strings, query = _walk(sre_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class SegmentIndex:
    """Postings, within a segment of documents, of the trigrams that some query names."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = i + 1

    def build(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
        if len(data) < 3:
            return {}
        code = data[:-2].astype(np.uint32)
        code <<= 8
        code |= data[1:-1]
        code <<= 8
        code |= data[2:]
        found = self.table[code]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        name, doc = np.divmod(pairs, len(texts))
        cut = np.searchsorted(name, np.arange(1, len(self.names) + 2))
        return {t: doc[cut[i] : cut[i + 1]] for i, t in enumerate(self.names)}


def candidates(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(query, np.zeros(0, np.int64))
    parts = [candidates(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if len(m[rule.group]) >= rule.least]


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def _long_runs(rule: Rule) -> re.Pattern | None:
    """For a rule that is one repeated class: the expression of its long matches alone.

    A match of [class]+ is a maximal run, so runs below least need not be visited.
    """
    tree = sre_parser.parse(rule.pattern)
    if len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and rule.group == 0 and not rule.ignore_case:
        least, most, body = tree[0][1]
        if least == 1 and most is sre.MAXREPEAT and len(body) == 1 and body[0][0] is sre.IN:
            return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", re.ASCII)
    return None


_SEGMENT = 1 << 20
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    queries = [trigram_query(r.pattern) for r in rules]
    expressions = [_long_runs(r) or compiled(r) for r in rules]
    index = SegmentIndex(sorted(set().union(*map(trigrams, queries))))
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])
    for batch in by_size(batches, 1, _SEGMENT):
        part = [t or "" for t in batch.column(1).to_pylist()]
        postings = index.build([t.encode("utf-8", "replace") for t in part])
        found: list[list] = [[] for _ in part]
        for k, (rule, query, expression) in enumerate(zip(rules, queries, expressions, strict=True)):
            for i in candidates(query, postings, len(part)).tolist():
                found[i] += [(a, k, b) for a, b in matches(rule, expression, part[i])]
        spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], schema=schema)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, spans) of every row: kind, start, end in code points, by start and the rules' order.

    Null and empty texts have no spans. Rows that repeat an id each return a row; a null id
    stays null. An empty table gives no rows; other columns play no part.
    """
    d = like(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    return d.mapInArrow(partial(_scan, rules=tuple(rules)), "id long, spans array<struct<kind: string, start: long, end: long>>")
