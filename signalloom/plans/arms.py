"""Transfer experiment with Spark ML's multilayer perceptron as the learner.

Three arms see the same splits: ``scratch`` starts from random weights,
``finetune`` starts from the hidden layer of a network fitted on the source
collection, and ``frozen`` keeps that hidden layer and fits only the layer behind it.

An arm learns in rounds. Each round goes on from the weights of the one before for a
few iterations and is then scored on the training and the validation rows in one pass,
so that a run has a history and the best round can be kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators.balance import resample
from signalloom.operators.experiments import ARMS
from signalloom.operators.metrics import comparison_table, evaluate, narrow_predictions
from signalloom.operators.splits import stratified_subsample
from signalloom.plans.models import predict
from signalloom.runtime import literal_table, materialise

# One line per arm for the comparison table.
ARM_DESCRIPTIONS = {
    "scratch": "random start, all weights fitted on the target",
    "frozen": "hidden layer from the source kept, linear head fitted on the target",
    "finetune": "hidden layer from the source as start, all weights fitted on the target",
}

HISTORY_SCHEMA = (
    "arm string, epoch int, train_loss double, val_loss double, val_macro_f1 double, "
    "val_balanced_accuracy double, val_accuracy double, seconds double"
)
#: Runs that learn at the same time: an iteration is a short job, which leaves most cores idle.
SIDE_BY_SIDE = 4
#: Probabilities below this count as this in a loss.
LEAST_PROBABILITY = 1e-12


# --- the kept layer ---------------------------------------------------------


def sigmoid_layer(weights: np.ndarray, biases: np.ndarray):
    """A column function: one matrix product per Arrow batch of ``array<double>`` rows.

    The weights travel with the function, once per task. A NULL row stays NULL.
    """
    product, n = np.ascontiguousarray(weights.T), len(biases)

    @F.arrow_udf("array<double>")
    def units(x: pa.Array) -> pa.Array:
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        there = x.is_valid().to_numpy(zero_copy_only=False)
        inputs = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, product.shape[0])
        values = 1.0 / (1.0 + np.exp(-(inputs @ product + biases)))
        ends = np.append(0, np.cumsum(there * n)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~there))

    return units


class HiddenLayer(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Stage that applies one fitted sigmoid layer; weights are row-major, unit by unit."""

    weights = Param(Params._dummy(), "weights", "layer weights", TypeConverters.toListFloat)
    biases = Param(Params._dummy(), "biases", "layer biases", TypeConverters.toListFloat)

    def __init__(self, inputCol="features", outputCol="hidden", weights=(), biases=()):
        super().__init__()
        self._set(
            inputCol=inputCol, outputCol=outputCol, weights=list(weights), biases=list(biases)
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        biases = np.array(self.getOrDefault(self.biases))
        weights = np.array(self.getOrDefault(self.weights)).reshape(len(biases), -1)
        units = sigmoid_layer(weights, biases)(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(units))


# --- what an arm consists of ------------------------------------------------


def _perceptron(
    layers: Sequence[int], max_iter: int, seed: int, start: np.ndarray | None = None, inputs: str = "features"
) -> MultilayerPerceptronClassifier:
    learner = MultilayerPerceptronClassifier(
        layers=list(layers), featuresCol=inputs, labelCol="label", maxIter=max_iter, seed=seed
    )
    return learner if start is None else learner.setInitialWeights(Vectors.dense(start))


def fit_source(
    train: DataFrame, n_inputs: int, n_classes: int, hidden: int = 16, max_iter: int = 50, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """Network of the source collection, whose hidden layer the other arms reuse."""
    return _perceptron([n_inputs, hidden, n_classes], max_iter, seed).fit(train)


def hidden_part(model: MultilayerPerceptronClassificationModel) -> tuple[np.ndarray, np.ndarray]:
    """First layer of a fitted network: weights (units x inputs) and biases."""
    d, h = model.getLayers()[:2]
    flat = model.weights.toArray()
    return flat[: d * h].reshape((h, d), order="F"), flat[d * h : d * h + h]


@dataclass(frozen=True)
class ArmParts:
    """What an arm keeps as it is, and what it learns: layers, and the weights it starts from."""

    kept: HiddenLayer | None
    layers: tuple[int, ...]
    start: np.ndarray | None

    @property
    def inputs(self) -> str:
        return "features" if self.kept is None else self.kept.getOutputCol()

    @property
    def n_weights(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.layers, self.layers[1:]))


def arm_parts(
    arm: str,
    n_inputs: int,
    n_classes: int,
    source: MultilayerPerceptronClassificationModel | None = None,
    hidden: int = 16,
    seed: int = 42,
) -> ArmParts:
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}, use one of {ARMS}")
    if arm == "scratch":
        return ArmParts(None, (n_inputs, hidden, n_classes), None)
    if source is None:
        raise ValueError(f"the {arm!r} arm needs a network of the source collection")
    weights, biases = hidden_part(source)
    units = len(biases)
    if arm == "frozen":
        layer = HiddenLayer("features", "hidden", weights.ravel().tolist(), biases.tolist())
        return ArmParts(layer, (units, n_classes), None)
    head = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(units), n_classes * (units + 1))
    return ArmParts(None, (n_inputs, units, n_classes), np.concatenate([weights.ravel(order="F"), biases, head]))


def build_arm(
    arm: str,
    n_inputs: int,
    n_classes: int,
    source: MultilayerPerceptronClassificationModel | None = None,
    hidden: int = 16,
    max_iter: int = 50,
    seed: int = 42,
) -> Estimator:
    """Unfitted estimator of one arm, for fitting it in one go."""
    parts = arm_parts(arm, n_inputs, n_classes, source, hidden, seed)
    learner = _perceptron(parts.layers, max_iter, seed, parts.start, parts.inputs)
    return learner if parts.kept is None else Pipeline(stages=[parts.kept, learner])


# --- rounds -----------------------------------------------------------------


@dataclass(frozen=True)
class Rounds:
    """How an arm learns: ``rounds`` blocks of ``iterations`` each.

    With ``patience`` it ends after so many rounds without a better validation macro-F1;
    only a gain above ``least_gain`` counts as better.
    """

    rounds: int = 5
    iterations: int = 10
    patience: int | None = None
    least_gain: float = 0.0


def _headline(counts: np.ndarray) -> tuple[float, float, float]:
    """(macro F1, balanced accuracy, accuracy) of confusion counts, true class by predicted class.

    Classes are averaged as in ``metrics.summary_metrics``: those seen at all, those seen in truth.
    """
    hits, true, predicted = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    seen, known = true + predicted > 0, true > 0
    if not known.any():
        return (float("nan"),) * 3
    f1 = 2 * hits[seen] / (true + predicted)[seen]
    return float(f1.mean()), float((hits[known] / true[known]).mean()), float(hits.sum() / counts.sum())


def score_round(model: Model, rows: DataFrame, n_classes: int, part: str = "part") -> dict[str, dict[str, float]]:
    """Loss and headline metrics of each part of ``rows``, in one pass over all of them.

    The loss is the mean of -log of the true class's probability. A line per part and
    cell of the confusion comes to the driver.
    """
    scored = narrow_predictions(model.transform(rows), keep=[part])
    p = F.greatest(F.get("probability", F.col("label")), F.lit(LEAST_PROBABILITY))
    cells = scored.groupBy(part, "label", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log(p)).alias("loss")
    )
    counts: dict[str, np.ndarray] = {}
    losses: dict[str, float] = {}
    for cell in cells.collect():
        matrix = counts.setdefault(cell[part], np.zeros((n_classes, n_classes)))
        matrix[cell["label"], cell["prediction"]] += cell["n"]
        losses[cell[part]] = losses.get(cell[part], 0.0) + cell["loss"]
    names = ("macro_f1", "balanced_accuracy", "accuracy")
    return {
        k: {"loss": losses[k] / m.sum(), **dict(zip(names, _headline(m)))} for k, m in counts.items()
    }


@dataclass
class ArmResult:
    """A fitted arm: the model of its best round, its history, and its scores by split."""

    arm: str
    model: Model
    seconds: float
    history: DataFrame
    best_epoch: int
    epochs: int
    stopped_early: bool
    n_weights: int
    evaluations: dict[str, dict[str, DataFrame]]

    def line(self, split: str) -> DataFrame:
        """Scores on one split, with what the run took."""
        summary = self.evaluations[split]["summary"].withColumnRenamed("model", "arm")
        return summary.withColumns(
            {
                "trainable_parameters": F.lit(self.n_weights).cast("long"),
                "epochs": F.lit(self.epochs),
                "best_epoch": F.lit(self.best_epoch),
                "seconds": F.lit(self.seconds),
            }
        )

    @property
    def summary(self) -> DataFrame:
        return self.line("test")

    @property
    def lines(self) -> DataFrame:
        """One line per split that was scored."""
        return stacked(self.line(split) for split in self.evaluations)


def stacked(parts) -> DataFrame:
    """One table from several that may lack columns of one another."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def run_arm(
    arm: str,
    train: DataFrame,
    test: DataFrame,
    label_names: Sequence[str],
    n_inputs: int,
    source: MultilayerPerceptronClassificationModel | None = None,
    val: DataFrame | None = None,
    hidden: int = 16,
    rounds: Rounds = Rounds(),
    seed: int = 42,
    save_to: str | None = None,
) -> ArmResult:
    """Fit one arm in rounds, keep its best one and score it; the model is stored when asked for.

    Without validation rows the last round stays. What the arm keeps as it is runs once: its
    outputs are stored, and rounds learn from those. The kept round is that of the highest
    validation macro-F1, the earliest of equal ones.
    """
    k = len(label_names)
    parts = arm_parts(arm, n_inputs, k, source, hidden, seed)
    started = time.monotonic()
    tagged = train.select(F.lit("train").alias("part"), "label", "features")
    if val is not None:
        tagged = tagged.unionByName(val.select(F.lit("val").alias("part"), "label", "features"))
    if parts.kept is not None:
        tagged = parts.kept.transform(tagged).drop("features")
    rows = materialise(tagged, "arm-rows")
    learning = rows.where(F.col("part") == "train")

    history: dict[str, list] = {name.split()[0]: [] for name in HISTORY_SCHEMA.split(", ")}
    start, best, best_score, best_epoch, epoch = parts.start, None, -np.inf, 0, 0
    stopped = False
    for epoch in range(1, rounds.rounds + 1):
        round_started = time.monotonic()
        model = _perceptron(parts.layers, rounds.iterations, seed, start, parts.inputs).fit(learning)
        start = model.weights.toArray()
        scores = score_round(model, rows, k)
        found = scores.get("val", {})
        values = {
            "arm": arm,
            "epoch": epoch,
            "train_loss": scores["train"]["loss"],
            "val_loss": found.get("loss"),
            "val_macro_f1": found.get("macro_f1"),
            "val_balanced_accuracy": found.get("balanced_accuracy"),
            "val_accuracy": found.get("accuracy"),
            "seconds": round(time.monotonic() - round_started, 1),
        }
        for name, value in values.items():
            history[name].append(value)
        if val is None or found.get("macro_f1", -np.inf) > best_score + (rounds.least_gain if best else 0.0):
            best, best_epoch, best_score = model, epoch, found.get("macro_f1", -np.inf)
        elif rounds.patience is not None and epoch - best_epoch >= rounds.patience:
            stopped = True
            break
    fitted = best if parts.kept is None else PipelineModel(stages=[parts.kept, best])
    if save_to is not None:
        fitted.write().overwrite().save(f"{save_to.rstrip('/')}/{arm}")
    seconds = round(time.monotonic() - started, 1)
    scored = {"val": val, "test": test} if val is not None else {"test": test}
    evaluations = {s: evaluate(predict(fitted, df), label_names, arm, s) for s, df in scored.items()}
    table = literal_table(train.sparkSession, history, HISTORY_SCHEMA)
    return ArmResult(arm, fitted, seconds, table, best_epoch, epoch, stopped, parts.n_weights, evaluations)


def balanced_train(train: DataFrame, seed: int = 42) -> DataFrame:
    """Oversampled training rows: the perceptron takes no row weights."""
    return resample(train, "oversample", seed=seed).select("features", "label")


def side_by_side(job: Callable, given: Iterable, at_once: int = SIDE_BY_SIDE) -> list:
    """``job`` of everything given, in its order, some at the same time. Results are those of one after the other."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(job, given))


def run_all_arms(
    train: DataFrame,
    test: DataFrame,
    label_names: Sequence[str],
    n_inputs: int,
    source: MultilayerPerceptronClassificationModel,
    arms: Sequence[str] = tuple(ARMS),
    **options,
) -> dict[str, ArmResult]:
    """All arms on the same rows."""
    results = side_by_side(lambda arm: run_arm(arm, train, test, label_names, n_inputs, source, **options), arms)
    return dict(zip(arms, results))


def arms_table(results: dict[str, ArmResult], split: str = "test") -> DataFrame:
    """All arms, best first, with their description."""
    return comparison_table(
        r.line(split).withColumn("description", F.lit(ARM_DESCRIPTIONS[a])) for a, r in results.items()
    )


def arms_history(results: dict[str, ArmResult]) -> DataFrame:
    """The histories of all arms, one line per arm and round."""
    return stacked(r.history for r in results.values())


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    label_names: Sequence[str],
    n_inputs: int,
    source: MultilayerPerceptronClassificationModel,
    fractions: Sequence[float] = (0.02, 0.05, 0.10, 0.25, 0.50, 1.00),
    arms: Sequence[str] = tuple(ARMS),
    seed: int = 42,
    **options,
) -> DataFrame:
    """Every arm on a shrinking training part; validation and test parts stay as they are."""

    def prepared(fraction: float) -> tuple[float, int, DataFrame]:
        part = materialise(stratified_subsample(train, fraction, seed=seed), "curve-part")
        return fraction, part.count(), materialise(balanced_train(part, seed), "curve-train")

    def lines(run: tuple) -> DataFrame:
        (fraction, n_train, balanced), arm = run
        result = run_arm(arm, balanced, test, label_names, n_inputs, source, seed=seed, **options)
        return result.lines.select(F.lit(fraction).alias("fraction"), F.lit(n_train).alias("n_train"), "*")

    parts = side_by_side(prepared, fractions)
    return stacked(side_by_side(lines, [(part, arm) for part in parts for arm in arms]))


def repeat_arms(
    train: DataFrame,
    test: DataFrame,
    label_names: Sequence[str],
    n_inputs: int,
    source: MultilayerPerceptronClassificationModel,
    seeds: Sequence[int],
    arms: Sequence[str] = tuple(ARMS),
    **options,
) -> DataFrame:
    """Every arm once per seed, so that differences can be read against their spread."""

    def lines(run: tuple[int, str]) -> DataFrame:
        seed, arm = run
        result = run_arm(arm, train, test, label_names, n_inputs, source, seed=seed, **options)
        return result.lines.select(F.lit(seed).alias("seed"), "*")

    return stacked(side_by_side(lines, [(seed, arm) for seed in seeds for arm in arms]))
