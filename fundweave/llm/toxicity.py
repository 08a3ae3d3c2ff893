"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(f(text) - threshold_k): one weight vector is shared by all ordered
thresholds, and the expected severity is the sum of these probabilities. f is linear in the
hashed words and word beginnings that the whole text holds, each scaled by how far toxic
and other rows of the sample differ in it.

Grades come from the labels: 0 for rows that are not toxic. The labels do not say how toxic a
row is, so toxic rows are graded by the agreement of raters, each fitted on a part of the
labelled rows that the graded row is not in: the more of them take it for toxic, the
higher its grade.

Scale: the model is fitted on a sample of labelled rows bounded in rows and in features
(sample_rows, sample_features; chosen by a seeded hash of the id). Scoring is one pass over the documents: the weights, a fixed number
of buckets, are broadcast, and a worker remembers the weight of each distinct word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import by_size
from .staging import free_names, like, staged

BUCKETS = 1 << 18
_STRIP = re.compile(r"^\W+|\W+$")
_REMEMBERED = 100_000


class Model(NamedTuple):
    """reject_at: the expected severity from which a document is rejected."""

    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = 1.0


def severity(f: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Expected severity: the sum over the thresholds of P(grade > k)."""
    return (0.5 * (1 + np.tanh(0.5 * (f[..., None] - thresholds)))).sum(-1)


def text_words(text: str | None) -> set[str]:
    """Distinct lower-cased words of the whole text, without punctuation at their ends."""
    found = set((text or "").lower().split())
    return {raw if raw.isalnum() else _STRIP.sub("", raw) for raw in found} - {""}


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of the word and of its beginning."""
    h = xxhash.xxh64_intdigest
    if len(word) <= 5:
        return (h(b"w" + word.encode("utf-8", "replace")) % BUCKETS,)
    return h(b"w" + word.encode("utf-8", "replace")) % BUCKETS, h(b"p" + word[:6].encode("utf-8", "replace")) % BUCKETS


def features(text: str | None) -> np.ndarray:
    """The buckets present in a text, ascending."""
    return np.array(sorted({b for w in text_words(text) for b in word_features(w)}), np.int32)


def scales(rows: list[np.ndarray], toxic: np.ndarray, least_rows: int = 3, least_odds: float = 0.5) -> np.ndarray:
    """Value of each bucket where present: how far toxic and other rows differ in it (log odds)."""
    seen = np.zeros((2, BUCKETS))
    for index, t in zip(rows, toxic.tolist(), strict=True):
        seen[int(t), index] += 1
    odds = np.log((seen[1] + 1) / (toxic.sum() + 2)) - np.log((seen[0] + 1) / ((~toxic).sum() + 2))
    return np.where((seen.sum(0) >= least_rows) & (np.abs(odds) >= least_odds), odds, 0.0)


def fit(rows: list[np.ndarray], scale: np.ndarray, grades: np.ndarray, *, l2: float = 0.05, steps: int = 150, rate: float = 0.03) -> Model:
    """Maximum likelihood of the cumulative-link model with an L2 penalty (Adam, full batch)."""
    rows = [i[scale[i] != 0] for i in rows]
    levels = int(grades.max(initial=1))
    of = np.repeat(np.arange(len(rows)), [len(i) for i in rows])
    index = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    value = np.abs(scale[index])
    used, column = np.unique(index, return_inverse=True)
    n = len(rows)
    share = [np.clip((grades > k).mean() if n else 0.5, 1e-4, 1 - 1e-4) for k in range(levels)]
    # Thresholds are the first and the logarithms of the steps to the next, so they stay in order.
    theta = [-math.log(s / (1 - s)) for s in share]
    x = np.concatenate([np.zeros(len(used)), theta[:1], [math.log(max(b - a, 0.1)) for a, b in zip(theta, theta[1:], strict=False)]])
    m, v = np.zeros_like(x), np.zeros_like(x)

    def cuts(x: np.ndarray) -> np.ndarray:
        return np.cumsum([x[len(used)], *np.exp(x[len(used) + 1 :])])

    sigmoid = lambda z: 0.5 * (1 + np.tanh(0.5 * z))
    weight = np.where(grades > 0, 0.5 / max((grades > 0).mean(), 1e-9), 0.5 / max((grades == 0).mean(), 1e-9)) if n else np.zeros(0)
    for t in range(1, steps + 1 if n else 0):
        w, cut = x[: len(used)], cuts(x)
        f = np.bincount(of, w[column] * value, n)
        above = sigmoid(f[:, None] - cut[None])  # P(grade > k)
        padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        p = np.maximum(padded[np.arange(n), grades] - padded[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)
        # d log p / d cut_k: minus slope at the lower bound of the grade, plus at the upper.
        d_cut = np.zeros((n, levels))
        low, high = grades > 0, grades < levels
        d_cut[low, grades[low] - 1] -= slope[low, grades[low] - 1] / p[low]
        d_cut[high, grades[high]] += slope[high, grades[high]] / p[high]
        d_cut *= weight[:, None] / n
        d_f = -d_cut.sum(1)
        g_cut = d_cut.sum(0)
        steps_up = np.exp(x[len(used) + 1 :])
        g = np.concatenate([
            np.bincount(column, d_f[of] * value, len(used)) - l2 * w,
            [g_cut.sum()], [steps_up[k] * g_cut[k + 1 :].sum() for k in range(levels - 1)],
        ])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = x[: len(used)] * np.abs(scale[used])
    return Model(weights, cuts(x))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, levels: int, *, raters: int = 5, clean_alarms: float = 0.05) -> np.ndarray:
    """0 where not toxic; else 1..levels by how many raters agree that the row is.

    The rows are dealt to as many parts as there are raters. A rater knows one part: it
    adds up the log odds of a row's buckets in it, and calls a row toxic above what a share
    of clean_alarms of the other rows of its part reach. A row is rated by all raters but
    that of its own part; grades are even steps of the share of those that agree.
    """
    part = np.arange(len(rows)) % raters
    votes, asked = np.zeros(len(rows)), np.zeros(len(rows))
    for r in range(raters):
        own = np.flatnonzero(part == r)
        if not toxic[own].any() or toxic[own].all():
            continue  # a part of one kind alone makes no rater
        scale = scales([rows[i] for i in own], toxic[own], least_rows=2)
        score = np.array([scale[i].sum() for i in rows])
        alarm = np.quantile(score[own[~toxic[own]]], 1 - clean_alarms)
        other = part != r
        votes[other] += score[other] > alarm
        asked[other] += 1
    share = np.divide(votes, asked, out=np.ones(len(rows)), where=asked > 0)
    return np.where(toxic, np.clip(np.ceil(share * levels), 1, levels), 0).astype(np.int64)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("index", pa.list_(pa.int32()))])
    for batch in by_size(batches, 2):
        found = [features(t).tolist() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], schema=schema)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, sample_features: int = 20_000_000, levels: int = 2, clean_rejected: float = 0.001, least_reject: float = 0.4, seed: int = 42
) -> Model:
    """Fits on at most sample_rows labelled documents of at most sample_features features in all.

    Of documents in the sample those come first whose hash of the id is least; the id with
    which they would exceed sample_features, and those after it, are left out. reject_at is
    the severity that a share of clean_rejected of the sample's rows that are not toxic
    reach, and least_reject at least.

    Labels that are null or have no document are left out. Without any toxic label the
    model scores every text 0.
    """
    lab = like(labels, id_col, label_col).toDF("id", "toxic").where("id is not null and toxic is not null")
    key = F.xxhash64(F.col("id").cast("long"), F.lit(seed))
    chosen = lab.orderBy(key, "id", "toxic").limit(sample_rows)
    d = like(docs, id_col, text_col).toDF("id", "text")
    rows = d.join(F.broadcast(chosen), "id").select(F.col("id").cast("long"), F.col("toxic").cast("int"), "text")  # sample_rows labels at most
    found = staged(rows.mapInArrow(_features_of, "id long, toxic int, index array<int>").withColumn("key", F.xxhash64("id", F.lit(seed))), "toxicity-sample")
    # sample_rows pairs of numbers at most; the features themselves come only as far as the bound.
    sizes = found.select("key", F.size("index").alias("size")).toArrow().sort_by("key")
    over = np.flatnonzero(np.cumsum(sizes.column("size").to_numpy(), dtype=np.int64) > sample_features)
    if len(over):
        found = found.where(F.col("key") < sizes.column("key")[over[0]].as_py())
    found = found.withColumn("text", F.xxhash64("index")).toArrow()
    found = found.sort_by([(c, "ascending") for c in ("key", "id", "toxic", "text")]).combine_chunks()
    toxic = found.column("toxic").to_numpy() > 0
    if not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), np.full(levels, 1e9))
    lists = found.column("index").combine_chunks()
    del found
    index = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
    scale = scales(index, toxic)
    model = fit(index, scale, severity_grades(index, toxic, levels))
    clean = severity(np.array([model.weights[i].sum(dtype=np.float64) for i, t in zip(index, toxic, strict=True) if not t]), model.thresholds)
    return model._replace(reject_at=float(max(least_reject, np.quantile(clean, 1 - clean_rejected) if len(clean) else 0)))


class Scorer:
    """Expected severity of a text: the sum over the thresholds of P(grade > k)."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def _weighted(self, raw: str) -> tuple[int, ...]:
        found = self.known.get(raw)
        if found is None:
            word = raw if raw.isalnum() else _STRIP.sub("", raw)
            found = tuple(b for b in word_features(word) if self.model.weights[b]) if word else ()
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[raw] = found
        return found

    def __call__(self, text: str | None) -> float:
        found: set[int] = set()
        for raw in set((text or "").lower().split()):
            found.update(self._weighted(raw))
        f = float(self.model.weights[sorted(found)].sum(dtype=np.float64)) if found else 0.0
        return float(severity(np.array(f), self.model.thresholds))


def _score(batches: Iterator[pa.RecordBatch], held, text_at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(held.value)
    for batch in by_size(batches, text_at):
        scores = [round(scorer(t), 9) for t in batch.column(text_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=schema)


def with_severity(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "__severity") -> DataFrame:
    """docs with the expected severity, 0 to the number of levels, in a column of that name.

    Null and empty texts are scored like a text without any known word. Every row is scored
    for itself, so repeated rows and null ids change nothing, and ties do not matter; other
    columns pass unchanged, but a column that has the name is replaced. An empty table
    gives no rows.
    """
    d = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    schema = T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    score = partial(_score, held=held, text_at=d.columns.index(text_col), schema=to_arrow_schema(schema))
    return d.mapInArrow(score, schema)


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs without those of an expected severity of the model's reject_at or more; all columns are kept."""
    (name,) = free_names(docs, "severity")
    found = with_severity(docs, model, text_col=text_col, name=name)
    return found.where(F.col(name) < model.reject_at).select(*[found[f"`{c}`"] for c in docs.columns])
