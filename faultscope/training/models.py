"""Model branches on Spark MLlib: fits, calibration, fusion and re-ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clip, expit, logit, residual_basis
from ..operators.sampling import class_weight
from .histogram import HistogramTrees, HistogramTreesModel

FEATURES, SCALED = "_features", "_scaled"


def _assembler(cols):
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES, handleInvalid="error")


def balanced(df: DataFrame, label: str) -> DataFrame:
    return class_weight(df, label, "_w")


def logistic(cols, label="label", weighted=True, reg=1e-4, iters=50) -> Pipeline:
    """Standardised logistic regression."""
    lr = LogisticRegression(featuresCol=SCALED, labelCol=label, maxIter=iters, regParam=reg, standardization=False, tol=1e-9)
    if weighted:
        lr = lr.setWeightCol("_w")
    return Pipeline(stages=[_assembler(cols), StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True), lr])


def boosted_trees(cols, label="label", rounds=20, depth=4, leaf=20, step=0.1, seed=42) -> Pipeline:
    g = GBTClassifier(featuresCol=FEATURES, labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, minInstancesPerNode=leaf,
                      stepSize=step, seed=seed, subsamplingRate=1.0)
    return Pipeline(stages=[_assembler(cols), g])


def histogram_trees(cols, label="label", rounds=150, depth=5, leaf=40, step=0.06, ridge=1.5) -> HistogramTrees:
    """The boosted branch at the size it has in the experiments: a fit of 150 rounds, not a Spark job a level."""
    return HistogramTrees(tuple(cols), label, rounds, depth, leaf, step, ridge)


def forest(cols, label="label", trees=20, depth=6, leaf=20, seed=42) -> Pipeline:
    r = RandomForestClassifier(featuresCol=FEATURES, labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Pipeline(stages=[_assembler(cols), r])


def linear_svm(cols, label="label", reg=1e-3, iters=30) -> Pipeline:
    s = LinearSVC(featuresCol=SCALED, labelCol=label, weightCol="_w", maxIter=iters, regParam=reg, standardization=False)
    return Pipeline(stages=[_assembler(cols), StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True), s])


def perceptron(cols, label="label", hidden=8, iters=30, seed=42) -> Pipeline:
    m = MultilayerPerceptronClassifier(featuresCol=SCALED, labelCol=label, layers=[len(cols), hidden, 2], maxIter=iters, seed=seed)
    return Pipeline(stages=[_assembler(cols), StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True), m])


FAMILIES = {"logistic": logistic, "boosted_trees": boosted_trees, "forest": forest, "linear_svm": linear_svm, "perceptron": perceptron}


class ConstantPrior(Model):
    """Stands in for a fit on a single-class span: every score is the clipped prior."""

    def __init__(self, prior: float):
        super().__init__()
        self.prior = min(max(prior, 1e-6), 1 - 1e-6)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_constant", F.lit(self.prior))


def fit(pipeline: Pipeline, train: DataFrame, label: str = "label") -> Model:
    """Fit with balanced weights; a single-class span yields the constant prior."""
    row = train.agg(F.sum(label).alias("p"), F.count("*").alias("n")).head()
    p, n = row["p"] or 0, row["n"]
    if p == 0 or p == n:
        return ConstantPrior(p / n if n else 0.0)
    w = F.when(F.col(label) == 1, F.lit(n / (2.0 * p))).otherwise(F.lit(n / (2.0 * (n - p))))
    return pipeline.fit(train.withColumn("_w", w))


def score(model: Model, df: DataFrame, name: str) -> DataFrame:
    """Add the positive-class probability (margin models go through the sigmoid)."""
    keep = [F.col(c) for c in df.columns]
    if isinstance(model, HistogramTreesModel):
        return df.select(*keep, model.probability().alias(name))
    t = model.transform(df)
    if "_constant" in t.columns:
        return t.select(*keep, F.col("_constant").alias(name))
    if "probability" in t.columns:
        return t.select(*keep, vector_to_array("probability")[1].alias(name))
    return t.select(*keep, expit(vector_to_array("rawPrediction")[1], 40.0).alias(name))


def fit_all(sample: DataFrame, families: dict[str, Pipeline]) -> dict[str, Model]:
    """All branch models of one origin on one sample."""
    sample = sample.persist()
    try:
        return {n: fit(p, sample) for n, p in families.items()}
    finally:
        sample.unpersist()


def score_all(models: dict[str, Model], df: DataFrame) -> DataFrame:
    for n, m in models.items():
        df = score(m, df, f"p_{n}")
    return df


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- optimality ----------------------------------------------------------------------

def optimality(model: PipelineModel, train: DataFrame, label: str = "label") -> DataFrame:
    """Mean weighted residual times each (scaled) feature plus its ridge term, long by ``term``: about 0 at the fit.

    ``train`` is the table the model was fitted on, with the weights of ``fit``.
    """
    lr = model.stages[-1]
    beta, reg = lr.coefficients.toArray().tolist(), lr.getRegParam()
    d = model.transform(with_weights(train, label)).select(
        F.col("_w"), (F.col("_w") * (vector_to_array("probability")[1] - F.col(label))).alias("_r"), vector_to_array(SCALED).alias("_x"))
    n = F.sum("_w")
    sums = [(F.sum("_r") / n).alias("b0"), *[(F.sum(F.col("_r") * F.col("_x")[i]) / n + F.lit(reg * v)).alias(f"b{i + 1}") for i, v in enumerate(beta)]]
    names = [f"b{i}" for i in range(len(beta) + 1)]
    return d.agg(*sums).unpivot([], names, "term", "gradient")


def plain_gradient(model: PipelineModel, train: DataFrame, label: str = "label") -> float:
    """Largest of the sums that vanish at the optimum of an unweighted logistic fit."""
    lr = model.stages[-1]
    beta, reg = lr.coefficients.toArray().tolist(), lr.getRegParam()
    d = model.transform(train).select((vector_to_array("probability")[1] - F.col(label)).alias("_r"), vector_to_array(SCALED).alias("_x"))
    sums = [F.abs(F.avg("_r")), *[F.abs(F.avg(F.col("_r") * F.col("_x")[i]) + F.lit(reg * v)) for i, v in enumerate(beta)]]
    return float(d.agg(F.greatest(*sums)).first()[0])


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    return class_weight(df, label, "_w")


def training_gain(model: Model, train: DataFrame, label: str = "label") -> float:
    """What the fit has gained on its own rows: positive for a right fit however weak the signal is, 0 for a constant prior.

    Logistic, hinge and boosted fits start at a constant and every step lowers their loss plus ridge,
    so it lies below that of the best constant score. The perceptron starts at random weights: its
    log loss lies below the one it began with. A forest's trees see draws of the rows: its scores are
    higher, on average, for positives. AP and AUC promise nothing, as no learner lowers them.
    Weights are those of ``fit``; the perceptron has none.
    """
    if isinstance(model, ConstantPrior):
        return 0.0
    last, y, p = model.stages[-1], F.col(label), F.col("_p")
    d = score(model, with_weights(train, label), "_p")
    log_loss = -F.log(F.when(y == 1, p).otherwise(1 - p))
    if isinstance(last, MultilayerPerceptronClassificationModel):
        return last.summary().objectiveHistory[0] - d.agg(F.avg(log_loss)).first()[0]
    if isinstance(last, RandomForestClassificationModel):
        row = d.agg(F.avg(F.when(y == 1, p)).alias("one"), F.avg(F.when(y == 0, p)).alias("zero")).first()
        return row["one"] - row["zero"]
    # The weights balance the classes: the best constant is a probability of a half, a margin of 0.
    constant, loss = (1.0, F.greatest(F.lit(0.0), 1 - (2 * y - 1) * logit(p, 1e-15))) if isinstance(last, LinearSVCModel) else (math.log(2.0), log_loss)
    ridge = 0.0 if isinstance(last, GBTClassificationModel) else last.getRegParam() * float(last.coefficients.dot(last.coefficients)) / 2
    return constant - d.agg(F.sum(F.col("_w") * loss) / F.sum("_w")).first()[0] - ridge


# ---- calibration ---------------------------------------------------------------------

def penalised_logit(df: DataFrame, x: list[Column], y: Column, ridge: list[float], centre: list[float] | None = None, offset: Column | None = None,
                    start: list[float] | None = None, rounds: int = 60, tolerance: float = 1e-10) -> list[float]:
    """Minimum of the mean log loss of ``offset + sum(b * x)`` plus ``ridge * (b - centre)^2 / 2`` per coefficient.

    Newton steps on sums: every round is one aggregate over the rows, with k gradient and
    k (k + 1) / 2 curvature sums, and the driver solves a k x k system. A step that does not
    lower the loss is halved. ``gradient`` gives the same sums at any point.
    """
    k = len(x)
    c = np.array(centre or [0.0] * k)
    lam = np.array(ridge)
    d = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(x)], y.cast("double").alias("y"), (offset if offset is not None else F.lit(0.0)).cast("double").alias("o"))

    def at(b: np.ndarray):
        eta = F.col("o")
        for i in range(k):
            eta = eta + F.lit(float(b[i])) * F.col(f"x{i}")
        p = 1 / (1 + F.exp(-eta))
        loss = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - F.col("y") * eta
        q = d.withColumns({"_p": p, "_l": loss})
        row = q.agg(F.avg("_l"), *[F.avg((F.col("_p") - F.col("y")) * F.col(f"x{i}")) for i in range(k)],
                    *[F.avg(F.col("_p") * (1 - F.col("_p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = row[1 + k:]
        h = h + np.triu(h, 1).T + np.diag(lam)
        return row[0] + float(lam @ (b - c) ** 2) / 2, np.array(row[1:1 + k]) + lam * (b - c), h

    b = np.array(start or list(c), float)
    loss, g, h = at(b)
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            break
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        while True:
            new = at(b - step)
            if new[0] <= loss + 1e-15 or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        b = b - step
        loss, g, h = new
    return [float(v) for v in b]


#: Fixed values of the monotone head: scale of the logit, its prior slope and weight, bounds of the slope.
HEAD_SCALE, HEAD_SLOPE, HEAD_RIDGE, HEAD_LOW, HEAD_HIGH = 6.0, 6.0, 1e-4, 0.01, 20.0


def platt_fit(df: DataFrame, p: str | Column, label: str = "label", monotone: bool = False) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve on ``logit(p)``.

    ``monotone`` is the head with a prior: the slope on ``logit(p) / 6`` is pulled to 6 with
    weight 1e-4 and stays in [0.01, 20]; if it runs into a bound, the intercept is fitted there.
    """
    y, z = F.col(label), logit(p)
    if not monotone:
        b = penalised_logit(df, [F.lit(1.0), z], y, [0.0, 1e-9], start=[0.0, 1.0])
        return b[1], b[0]
    x = z / HEAD_SCALE
    b = penalised_logit(df, [F.lit(1.0), x], y, [0.0, HEAD_RIDGE], [0.0, HEAD_SLOPE])
    slope = min(max(b[1], HEAD_LOW), HEAD_HIGH)
    if slope != b[1]:
        b = [*penalised_logit(df, [F.lit(1.0)], y, [0.0], offset=x * F.lit(slope)), slope]
    return b[1] / HEAD_SCALE, b[0]


def platt_apply(p: str | Column, slope: float, intercept: float) -> Column:
    return expit(logit(p) * F.lit(slope) + F.lit(intercept))


#: Which memories an arm of the residual fusion uses.
ARMS = {"none": (False, False), "first": (True, False), "second": (False, True), "both": (True, True)}


@dataclass(frozen=True)
class Fusion:
    """Calibration heads of the four inputs and the coefficients of each arm; ``status`` says if they were fitted."""

    status: str
    heads: dict[str, tuple[float, float]]
    arms: dict[str, list[float]]


def _basis(df: DataFrame, heads: dict[str, tuple[float, float]], arm: str) -> tuple[list[Column], Column]:
    """Basis of the calibrated logits (with those of the memories in the arm) and the offset."""
    q = {c: clip(platt_apply(expit(c), *heads[c]), 1e-6, 1 - 1e-6) for c in heads}
    one, two = ARMS[arm]
    cols = residual_basis(q["z1"], q["z2"], logit(q["m1"]) if one else None, logit(q["m2"]) if two else None)
    return list(cols.values()), logit(q["z2"])


def fit_fusion(older: DataFrame, newer: DataFrame, label: str = "label", ridge: float = 0.01, minimum: int = 20) -> Fusion:
    """Heads on the older matured rows, arms on the newer ones; columns ``z1, z2, m1, m2`` are logits.

    Rows with a missing memory do not count. With fewer than ``minimum`` rows of a class in
    either part nothing is fitted and the second branch stands (``status`` tells).
    """
    names = ["z1", "z2", "m1", "m2"]
    older, newer = (d.dropna(subset=names) for d in (older, newer))
    least = [min(r["p"] or 0, r["n"] - (r["p"] or 0)) for r in (d.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first() for d in (older, newer))]
    if min(least) < minimum:
        return Fusion("second branch stands", {}, {})
    heads = {c: platt_fit(older, expit(c), label, monotone=True) for c in names}
    arms = {}
    for arm in ARMS:
        x, offset = _basis(newer, heads, arm)
        arms[arm] = penalised_logit(newer, x, F.col(label), [0.0] + [ridge] * (len(x) - 1), offset=offset)
    return Fusion("fitted", heads, arms)


def apply_fusion(df: DataFrame, fusion: Fusion, arm: str, name: str = "fused") -> DataFrame:
    """Rows without the arm's memories, and all rows without a fit, get the second branch."""
    if fusion.status != "fitted":
        return df.withColumn(name, expit("z2"))
    x, eta = _basis(df, fusion.heads, arm)
    for b, c in zip(fusion.arms[arm], x, strict=True):
        eta = eta + F.lit(b) * c
    return df.withColumn(name, F.coalesce(clip(expit(eta), 1e-6, 1 - 1e-6), expit("z2")))


def fusion_gradient(newer: DataFrame, fusion: Fusion, arm: str, label: str = "label", ridge: float = 0.01) -> DataFrame:
    """Mean residual times each basis column plus the ridge term, long by term: about 0 at the fit."""
    newer = newer.dropna(subset=["z1", "z2", "m1", "m2"])
    x, eta = _basis(newer, fusion.heads, arm)
    beta = fusion.arms[arm]
    for b, c in zip(beta, x, strict=True):
        eta = eta + F.lit(b) * c
    r = expit(eta) - F.col(label)
    sums = [(F.avg(r * c) + F.lit(ridge * b if i else 0.0)).alias(f"b{i}") for i, (b, c) in enumerate(zip(beta, x, strict=True))]
    return newer.agg(*sums).unpivot([], [f"b{i}" for i in range(len(beta))], "term", "gradient")


def rerank_features(df: DataFrame, by=("bin",), entity: str = "entity") -> DataFrame:
    """Ranks and logits of both branches for the meta re-ranker."""
    from ..operators.ranking import risk_rank

    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    d = risk_rank(risk_rank(df, "p1", by, entity, "rank1"), "p2", by, entity, "rank2").join(n, list(by))
    return rerank_columns(d).drop("_n")


def rerank_columns(d: DataFrame) -> DataFrame:
    """``RERANK`` of rows with both scores, both ranks and the number ``_n`` of rows of their time."""
    return d.withColumns({
        "m_r1": 1 - (F.col("rank1") - 1) / F.col("_n"), "m_r2": 1 - (F.col("rank2") - 1) / F.col("_n"),
        "m_z1": logit("p1"), "m_z2": logit("p2")}).withColumn("m_dr", F.col("m_r1") - F.col("m_r2"))


RERANK = ["m_r1", "m_r2", "m_z1", "m_z2", "m_dr"]


def rerank(df: DataFrame, train: Column, by=("bin",)) -> DataFrame:
    """Meta logistic fitted on matured rows; adds ``risk`` for the tail swap."""
    d = rerank_features(df, by)
    m = fit(logistic(RERANK), d.where(train))
    return score(m, d, "risk")
