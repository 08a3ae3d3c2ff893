"""Detection models on MLlib: balanced logistic regression, boosted trees, calibration, edge ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundweave.operators.evaluation import SEEDS, bootstrap_gate, precision_at, rank_edges, training_mask
from fundweave.shared import staged

#: Fixed values of the reference configuration.
LOGISTIC_ITERATIONS, TREES, LEARNING_RATE, DEPTH = 1000, 200, 0.05, 5
#: Edges of a side of a tile of pairs, and pairs that a task works on.
TILE, TASK_PAIRS = 512, 4_000_000


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def balanced(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """df with weight n / (2 n_class), and n; both classes must be there."""
    counts = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    if set(counts) != {0, 1}:
        raise ValueError("labels must be 0 and 1, both present")
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    return df.withColumn("weight", weight), n


@dataclass(frozen=True)
class Logistic:
    """A fitted logistic model: what it takes to score, and nothing else."""

    intercept: float
    coefficients: tuple[float, ...]

    def score(self, columns: Sequence[str]) -> Column:
        """Probability of the positive class, as a plain column."""
        z = F.lit(self.intercept)
        for c, w in zip(columns, self.coefficients, strict=True):
            z = z + F.lit(w) * F.col(c).cast("double")
        return 1 / (1 + F.exp(-z))


def fit_logistic(df: DataFrame, columns: Sequence[str], label: str = "label", c: float = 1.0) -> Logistic:
    """Balanced logistic regression; c is the inverse penalty of a sum of losses, so regParam is 1 / (c n).

    The rows are written once: the fit passes over them up to LOGISTIC_ITERATIONS times.
    """
    w, n = balanced(staged(df.select(*columns, label), "logistic-rows"), label)
    lr = LogisticRegression(labelCol=label, weightCol="weight", maxIter=LOGISTIC_ITERATIONS, regParam=1 / (c * n), standardization=False)
    fitted = lr.fit(assembled(w, columns))
    return Logistic(float(fitted.intercept), tuple(float(x) for x in fitted.coefficients.toArray()))


def fit_boosted_trees(df: DataFrame, columns: Sequence[str], label: str = "label", trees: int = TREES, seed: int = 11):
    w, _ = balanced(df, label)
    return GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, stepSize=LEARNING_RATE, maxDepth=DEPTH, seed=seed).fit(assembled(w, columns))


def predict_scores(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with score, the probability of the positive class."""
    if isinstance(model, Logistic):
        return df.withColumn("score", model.score(columns))
    out = model.transform(assembled(df, columns)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


def calibrate(calibration: DataFrame, scored: DataFrame, label: str = "label") -> DataFrame:
    """scored with calibrated: isotonic on the calibration rows alone, clipped outside their range."""
    model = IsotonicRegression(featuresCol="score", labelCol=label).fit(calibration.select("score", label))
    return model.transform(scored).withColumnRenamed("prediction", "calibrated")


def fit_edge_ranker(edges: DataFrame, columns: Sequence[str], trees: int = 50, seed: int = 11):
    """A pointwise ranker on edges of known labels; RELEVANT is 1."""
    known = training_mask(edges).withColumn("relevant", (F.col("label") == "RELEVANT").cast("int"))
    return fit_boosted_trees(known.drop("label"), columns, "relevant", trees, seed)


def ranking_sample(edges: DataFrame, columns: Sequence[str], per_class: int | None = None, seed: int = 11) -> DataFrame:
    """case_id, relevant, i, edge_id, x: the edges of known class of each case, numbered by i in a seeded order of each class.

    All of them, unless per_class limits either class of a case. That limit is applied before
    the shuffle as well, so that a case of any size sends few rows.
    """
    known = training_mask(edges).select("case_id", "edge_id", (F.col("label") == "RELEVANT").cast("int").alias("relevant"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    order = Window.partitionBy("case_id", "relevant").orderBy(F.xxhash64("edge_id", F.lit(seed)), "edge_id", "x")
    numbered = known.withColumn("i", F.row_number().over(order))
    return numbered if per_class is None else numbered.where(F.col("i") <= per_class)


def ranking_pairs(sample: DataFrame, partners: int | None = None) -> DataFrame:
    """case_id, p, n, n_relevant, d: each relevant edge p with every irrelevant one n, or with the next `partners`, in a circle; d is their difference.

    A case without either class has no pairs. This is a row a pair, for small tables: the
    fit makes the same pairs of blocks (_tiles).
    """
    sizes = sample.groupBy("case_id").agg(F.sum("relevant").alias("n_relevant"), F.sum(1 - F.col("relevant")).alias("many")).where("n_relevant > 0 and many > 0")
    turns = F.sequence(F.lit(0), F.least(F.lit(partners), F.col("many")) - 1)  # the least of a null and many is many
    asked = sample.where("relevant = 1").join(sizes, "case_id").select("case_id", "n_relevant", F.col("i").alias("p"), "x", "many", F.explode(turns).alias("turn"))
    asked = asked.withColumn("n", F.pmod(F.col("p") - 1 + F.col("turn"), "many") + 1)
    other = sample.where("relevant = 0").select("case_id", F.col("i").cast("long").alias("n"), F.col("x").alias("y"))
    return asked.join(other, ["case_id", "n"]).select("case_id", "p", "n", "n_relevant", F.zip_with("x", "y", lambda a, b: a - b).alias("d"))


def _discounted(sample: DataFrame, model: Logistic) -> DataFrame:
    """sample with the discount of each edge's rank in its case by the model."""
    scored = sample.withColumn("score", sum((F.lit(w) * F.col("x")[k] for k, w in enumerate(model.coefficients)), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "edge_id", "i"))
    return scored.withColumn("discount", 1 / F.log2(rank + F.lit(1))).drop("score")


def _gain_of_swap(pairs: DataFrame, sample: DataFrame, model: Logistic) -> DataFrame:
    """ranking_pairs() with weight: how much of the case's discounted gain swapping the two would move, at the model's ranks in the sample."""
    ranks = _discounted(sample, model)
    of = lambda relevant, i, d: ranks.where(F.col("relevant") == relevant).select("case_id", F.col("i").cast("long").alias(i), F.col("discount").alias(d))
    cases = _ranking_cases(sample).select("case_id", "ideal")
    at = pairs.join(of(1, "p", "d_p"), ["case_id", "p"]).join(of(0, "n", "d_n"), ["case_id", "n"]).join(cases, "case_id")
    return at.withColumn("weight", F.abs(F.col("d_p") - F.col("d_n")) / F.col("ideal")).drop("d_p", "d_n", "ideal")


def _ranking_cases(sample: DataFrame) -> DataFrame:
    """case_id, n_relevant, many (irrelevant), ideal, broken of the cases with both classes: ideal is their best discounted gain, broken counts edges without a finite x."""
    # i counts the relevant edges from 1 without gaps, so it runs over the ranks that they would have at best.
    best = F.sum(F.when(F.col("relevant") == 1, 1 / F.log2(F.col("i") + 1)))
    broken = F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    cases = sample.groupBy("case_id").agg(F.sum("relevant").alias("n_relevant"), F.sum(1 - F.col("relevant")).alias("many"), best.alias("ideal"), broken.alias("broken"))
    return cases.where("n_relevant > 0 and many > 0")


def _tiles(sample: DataFrame, cases: DataFrame, model: Logistic | None, tasks: int) -> DataFrame:
    """Each block of relevant edges beside each block of irrelevant ones of its case: x and, at the model's ranks, discounts of both.

    A tile stands for up to TILE x TILE pairs, which only the task that works on it makes.
    """
    ranks = _discounted(sample, model) if model else sample.withColumn("discount", F.lit(None).cast("double"))
    first = (F.col("i") - 1 - F.pmod(F.col("i") - 1, F.lit(TILE))).alias("first")
    blocks = ranks.groupBy("case_id", "relevant", first).agg(F.array_sort(F.collect_list(F.struct("i", "x", "discount"))).alias("e"))
    blocks = staged(blocks.select("case_id", "relevant", "first", F.flatten("e.x").alias("x"), F.col("e.discount").alias("discount")), "ranking-blocks")
    of = lambda relevant, name: blocks.where(F.col("relevant") == relevant).select("case_id", *[F.col(c).alias(f"{name}_{c}") for c in ("first", "x", "discount")])
    tiles = of(1, "p").join(of(0, "n"), "case_id").join(cases.select("case_id", "many", "ideal"), "case_id")
    return tiles.repartition(tasks, "case_id", "p_first", "n_first").drop("case_id")


def _pair_terms(batches: Iterator[pa.RecordBatch], beta: np.ndarray, partners: int | None, equal: bool) -> Iterator[pa.RecordBatch]:
    """One row: weight, loss, gradient and curvature at beta, summed over the pairs of the tiles."""
    k, total = len(beta), 0.0
    for batch in batches:
        # flatten() keeps to the rows of the batch, as lengths do.
        part = {c: np.split(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(batch.column(c)).to_numpy())[:-1]) for c in ("p_x", "n_x", "p_discount", "n_discount")}
        rows = zip(part["p_x"], part["n_x"], part["p_discount"], part["n_discount"], *(batch.column(c).to_pylist() for c in ("p_first", "n_first", "many", "ideal")), strict=True)
        for p, n, d_p, d_n, p_first, n_first, many, ideal in rows:
            p, n = p.reshape(-1, k), n.reshape(-1, k)
            centre = n.mean(axis=0)  # differences stay, and sums of squares keep their digits
            p, n = p - centre, n - centre
            margin = (p @ beta)[:, None] - (n @ beta)[None, :]
            weight = np.ones_like(margin) if equal else np.abs(d_p[:, None] - d_n[None, :]) / ideal
            if partners is not None:
                turn = (n_first + np.arange(len(n)))[None, :] - (p_first + np.arange(len(p)))[:, None]
                weight = np.where(turn % many < partners, weight, 0.0)
            e = np.exp(-np.abs(margin))
            wrong = np.where(margin >= 0, e, 1.0) / (1 + e)
            slope = weight * wrong
            bend = slope * (1 - wrong)
            cross = p.T @ bend @ n
            curvature = (p.T * bend.sum(axis=1)) @ p + (n.T * bend.sum(axis=0)) @ n - cross - cross.T
            loss = (weight * (np.log1p(e) + np.maximum(-margin, 0.0))).sum()
            total = total + np.concatenate([[weight.sum(), loss], slope.sum(axis=0) @ n - slope.sum(axis=1) @ p, curvature.ravel()])
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["terms"])


def _fit_tiles(tiles: DataFrame, beta: np.ndarray, penalty: float, partners: int | None, equal: bool) -> np.ndarray:
    """The least of the mean loss of all pairs and the penalty, by Newton's method from beta; a pass over the tiles a step."""

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        terms = tiles.mapInArrow(partial(_pair_terms, beta=beta, partners=partners, equal=equal), "terms array<double>").collect()  # a row a task
        weight, loss, *rest = np.sum([r.terms for r in terms], axis=0)
        k = len(beta)
        gradient, curvature = np.array(rest[:k]) / weight + penalty * beta, np.reshape(rest[k:], (k, k)) / weight + penalty * np.eye(k)
        return loss / weight + penalty / 2 * beta @ beta, gradient, curvature

    loss, gradient, curvature = at(beta)
    for _ in range(LOGISTIC_ITERATIONS):
        step = np.linalg.solve(curvature, gradient)
        gain = gradient @ step
        if gain <= 1e-16:
            break
        size = 1.0
        while (new := at(beta - size * step))[0] > loss - 1e-4 * size * gain + 1e-12 and size > 1e-6:
            size /= 2
        beta, (loss, gradient, curvature) = beta - size * step, new
    return beta


def fit_pairwise_ranker(
    edges: DataFrame, columns: Sequence[str], *, per_class: int | None = None, partners: int | None = None, rounds: int = 3, c: float = 1.0, seed: int = 11
) -> Logistic:
    """A linear ranker that learns from all pairs of a relevant and an irrelevant edge of one case.

    The logistic loss of the pairs' differences is minimised, first with equal weights, then
    `rounds` times with each pair weighted by the change of the case's discounted gain if
    the two changed places. What is common to a case cancels in the differences. Edges of
    unknown label play no part; per_class and partners, if given, limit the edges of a case
    (ranking_sample) and the pairs of an edge (ranking_pairs). Only the order of the scores
    within a case has a meaning. Values in the columns that are null or not finite and tables
    without any pair are errors.

    The work is that of the pairs, which are quadratic in a case; what is written and held
    is blocks of edges (_tiles), dealt to tasks by the number of pairs.
    """
    sample = staged(ranking_sample(edges, columns, per_class, seed), "ranking-sample")
    cases = staged(_ranking_cases(sample), "ranking-cases")
    count = F.sum(F.col("n_relevant") * F.least(F.lit(partners), F.col("many")))
    n, all_pairs, broken = cases.agg(count, F.sum(F.col("n_relevant") * F.col("many")), F.sum("broken")).first()
    if not n:
        raise ValueError("no case holds both relevant and irrelevant edges")
    if broken:
        raise ValueError("columns hold values that are null or not finite")
    model = None
    for _ in range(rounds + 1):
        tiles = staged(_tiles(sample, cases, model, all_pairs // TASK_PAIRS + 1), "ranking-tiles")
        beta = _fit_tiles(tiles, np.array(model.coefficients) if model else np.zeros(len(columns)), 1 / (c * n), partners, model is None)
        model = Logistic(0.0, tuple(beta.tolist()))
    return model


def rank(model, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rank_edges(predict_scores(model, edges, columns))


def five_seed_run(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label", budget: int = 100, trees: int = TREES) -> list[float]:
    """Precision at the alert budget, for each of the five seeds (test has row_id)."""
    out = []
    for seed in SEEDS:
        scored = predict_scores(fit_boosted_trees(train, columns, label, trees, seed), test, columns)
        out.append(precision_at(scored.withColumnRenamed(label, "y"), budget).first().precision_at_k)
    return out


def promotion(spark, baseline: list[float], candidate: list[float]) -> DataFrame:
    return bootstrap_gate(spark.createDataFrame([(baseline, candidate)], "baseline array<double>, candidate array<double>"))
