"""Multiclass models over a sparse feature column, with one interface.

A trained model has ``labels`` (sorted), ``probabilities(df)``, which adds an array in label order, and ``info``, how its
training ended; ``predict`` adds the arg-max label and its confidence. Training passes over rows packed in blocks
(``blocks``, ``solvers``, ``boosting``); only what is as large as the model reaches the driver. Scores are worked out in Arrow
batches against the broadcast model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.config import LABEL
from caseloom.operators.blocks import Blocks, entries_of
from caseloom.operators.boosting import Forest, boost
from caseloom.operators.labels import label_space
from caseloom.operators.network import Network, network_scores, train_network
from caseloom.operators.solvers import sigmoid_fit, softmax_fit, svm_fit
from caseloom.operators.splits import stratified_folds
from caseloom.operators.weights import class_weight

ROWS_AT_ONCE = 1024  # that a worker scores at a time


def label_list(df: DataFrame, label: str = LABEL) -> list[str]:
    """The sorted classes of a train split; a model's driver-side state is as large anyway."""
    return [r["label"] for r in label_space(df, label).orderBy("idx").collect()]


def predict(df: DataFrame, labels: list[str], probability: str = "probability") -> DataFrame:
    """Add ``predicted_label`` (first of the largest) and ``confidence``."""
    p = F.col(probability)
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max(p)
    return df.withColumn("predicted_label", F.element_at(names, F.array_position(p, best).cast("int"))).withColumn("confidence", best)


class TrainedModel:
    """Common part: prediction, and saving as a table of numbers plus a line of JSON."""

    kind = ""
    labels: list[str]
    info: dict

    def probabilities(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def numbers(self) -> dict[str, np.ndarray]:
        """What the model consists of, by name."""
        raise NotImplementedError

    @classmethod
    def restore(cls, labels: list[str], info: dict, numbers: dict[str, np.ndarray]):
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.probabilities(df), self.labels)

    def linear_parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients ``[class, feature]`` and intercepts ``[class]``."""
        raise TypeError(f"{self.kind} is not a linear model and has no coefficients per class")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (name, i, list(values.shape), row)
            for name, values in self.numbers().items() for i, row in enumerate(values.astype("f8").reshape(len(values), -1))
        ]
        names, places, shapes, values = zip(*rows, strict=True) if rows else ((), (), (), ())
        offsets = np.cumsum([0, *map(len, values)]).astype("i4")
        flat = np.concatenate(values) if rows else np.zeros(0)
        table = pa.table({
            "name": pa.array(names, pa.string()), "row": pa.array(places, pa.int32()), "shape": pa.array(shapes, pa.list_(pa.int64())),
            "v": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
        })
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/numbers")
        line = json.dumps({"kind": self.kind, "labels": self.labels, "info": self.info})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def add_scores(df: DataFrame, out: str, size: int, compute: Callable, shared: object, features: str = "features") -> DataFrame:
    """``df`` with the array ``out`` of ``size`` numbers: ``compute(shared, starts, idx, val)`` gives [row, number] for some rows."""
    given = df.sparkSession.sparkContext.broadcast(shared)  # as large as the model

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(indices: pa.Array, values: pa.Array) -> pa.Array:
        lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        idx, val = (a.flatten().to_numpy(zero_copy_only=False) for a in (indices, values))
        ends = np.cumsum(lengths)
        parts = []
        for a in range(0, len(lengths), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(lengths))
            first = ends[a] - lengths[a]
            parts.append(compute(given.value, ends[a:b] - lengths[a:b] - first, idx[first : ends[b - 1]], val[first : ends[b - 1]]))
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype="i4") * size), pa.array(flat, pa.float64()))

    # taken as non-deterministic, so that no filter made of scores is moved below them, where nothing evaluates them
    return df.withColumn(out, scored.asNondeterministic()(*entries_of(features)))


def _margins(shared: tuple, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    w, b = shared
    out = np.zeros((len(starts), w.shape[1]))
    some = np.flatnonzero(np.diff(np.append(starts, len(idx))))
    if len(some):
        out[some] = np.add.reduceat(val[:, None] * w[idx], starts[some], axis=0)
    return out + b


def add_margins(df: DataFrame, parts: tuple[np.ndarray, np.ndarray], out: str) -> DataFrame:
    """Add the array of margins under coefficients ``[class, feature]`` and intercepts ``[class]``."""
    coefs, intercepts = parts
    return add_scores(df, out, len(intercepts), _margins, (np.ascontiguousarray(coefs.T), intercepts))


def shares(values: np.ndarray) -> np.ndarray:
    """Rows divided by their sums; all-zero rows become uniform."""
    total = values.sum(axis=-1, keepdims=True)
    return np.where(total > 0, values / np.where(total > 0, total, 1.0), 1.0 / values.shape[-1])


def _softmax(margins: np.ndarray) -> np.ndarray:
    return shares(np.exp(margins - margins.max(axis=1, keepdims=True)))


def _logistic(shared: tuple, *entries: np.ndarray) -> np.ndarray:
    return _softmax(_margins(shared, *entries))


def _calibrated(shared: tuple, *entries: np.ndarray) -> np.ndarray:
    w, b, slopes, offsets = shared
    z = slopes * _margins((w, b), *entries).reshape(-1, *slopes.shape) + offsets
    return shares(1.0 / (1.0 + np.exp(np.minimum(z, 700.0)))).mean(axis=1)


def boosted_margins(shared: tuple, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    """Scores [row, class] of (forest, width, classes)."""
    forest, width, k = shared
    return forest.scores(starts, idx, val, len(starts), width, k)


def _boosted(shared: tuple, *entries: np.ndarray) -> np.ndarray:
    return _softmax(boosted_margins(shared, *entries))


class LogisticModel(TrainedModel):
    kind = "logistic_regression"

    def __init__(self, coefs: np.ndarray, intercepts: np.ndarray, labels: list[str], info: dict | None = None):
        self.coefs, self.intercepts, self.labels, self.info = coefs, intercepts, labels, info or {}

    def probabilities(self, df: DataFrame) -> DataFrame:
        return add_scores(df, "probability", len(self.labels), _logistic, (np.ascontiguousarray(self.coefs.T), self.intercepts))

    def linear_parts(self):
        return self.coefs, self.intercepts

    def numbers(self):
        return {"coefs": self.coefs, "intercepts": self.intercepts}

    @classmethod
    def restore(cls, labels, info, numbers):
        return cls(numbers["coefs"], numbers["intercepts"], labels, info)


class CalibratedSvcModel(TrainedModel):
    """Per fold a linear SVM per class, margins turned into probabilities, folds averaged. Arrays are [fold, class, ...]."""

    kind = "linear_svc"

    def __init__(self, coefs: np.ndarray, intercepts: np.ndarray, slopes: np.ndarray, offsets: np.ndarray, labels: list[str], info: dict | None = None):
        self.coefs, self.intercepts, self.slopes, self.offsets = coefs, intercepts, slopes, offsets
        self.labels, self.info = labels, info or {}

    def probabilities(self, df: DataFrame) -> DataFrame:
        w = np.ascontiguousarray(self.coefs.reshape(-1, self.coefs.shape[2]).T)
        return add_scores(df, "probability", len(self.labels), _calibrated, (w, self.intercepts.ravel(), self.slopes, self.offsets))

    def linear_parts(self):
        return self.coefs.mean(axis=0), self.intercepts.mean(axis=0)

    def numbers(self):
        return {"coefs": self.coefs, "intercepts": self.intercepts, "slopes": self.slopes, "offsets": self.offsets}

    @classmethod
    def restore(cls, labels, info, numbers):
        return cls(*(numbers[n] for n in ("coefs", "intercepts", "slopes", "offsets")), labels, info)


class BoostedModel(TrainedModel):
    """A tree for each class and round; a class's score is the sum of its leaves, probabilities are their softmax."""

    kind = "xgboost"

    def __init__(self, forest: Forest, width: int, labels: list[str], info: dict | None = None):
        self.forest, self.width, self.labels, self.info = forest, width, labels, info or {}

    def probabilities(self, df: DataFrame) -> DataFrame:
        return add_scores(df, "probability", len(self.labels), _boosted, (self.forest, self.width, len(self.labels)))

    def numbers(self):
        return {**{n: getattr(self.forest, n) for n in Forest.__dataclass_fields__}, "width": np.array([self.width])}

    @classmethod
    def restore(cls, labels, info, numbers):
        kinds = {"feature": "i4", "absent_left": bool}
        forest = Forest(*(numbers[n].astype(kinds.get(n, "f8")) for n in Forest.__dataclass_fields__))
        return cls(forest, int(numbers["width"][0]), labels, info)


def _indexed(train: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    labels = label_list(train, label)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    return train.withColumn("_y", place.cast("double")), labels


def _class_counts(rows: DataFrame, k: int, fold: str | None = None, folds: int = 1) -> np.ndarray:
    """Rows of each [fold, class]."""
    out = np.zeros((folds, k))
    keys = ["_y", fold] if fold else ["_y"]
    for r in rows.groupBy(*keys).count().collect():  # a row for each class and fold
        out[int(r[fold]) if fold else 0, int(r["_y"])] = r["count"]
    return out


def train_logistic(
    train: DataFrame, label: str = LABEL, max_iter: int = 1000, c: float = 1.0, weights: str | None = "balanced"
) -> LogisticModel:
    """Multinomial with squared penalty; rows weigh by their class (``weights``: balanced, root or None)."""
    indexed, labels = _indexed(train, label)
    cost = class_weight(_class_counts(indexed, len(labels))[0], weights)
    w = F.element_at(F.array(*[F.lit(float(v)) for v in cost]), F.col("_y").cast("int") + 1)
    blocks = Blocks(indexed, {"y": F.col("_y"), "w": w})
    fit = softmax_fit(blocks, len(labels), c, max_iter)
    blocks.release()
    return LogisticModel(np.ascontiguousarray(fit.weights[:-1].T), fit.weights[-1], labels, fit.info())


def train_calibrated_svc(
    train: DataFrame, label: str = LABEL, key: str = "odiNumber", folds: int = 3, max_iter: int = 100, c: float = 1.0,
    weights: str | None = "balanced",
) -> CalibratedSvcModel:
    """Machines of all classes are fitted on all folds but one, and calibrated on that one, all folds together.

    In a machine rows of its class carry the class's weight among the rows fitted, others weight 1.
    """
    indexed, labels = _indexed(train.select(key, label, "features"), label)
    rows = stratified_folds(indexed, label, key, folds).persist()
    k = len(labels)
    counts = _class_counts(rows, k, "fold", folds)
    inside = counts.sum(axis=0) - counts
    classes, fold = np.tile(np.arange(k), folds), np.repeat(np.arange(folds), k)
    hit_cost = c * np.concatenate([class_weight(n, weights) for n in inside])
    blocks = Blocks(rows, {"y": F.col("_y"), "fold": F.col("fold")})
    fit = svm_fit(blocks, classes, fold, hit_cost, np.full(folds * k, c), max_iter)
    others = (counts.sum(axis=1, keepdims=True) - counts).ravel()
    a, b, settled = sigmoid_fit(blocks, fit.weights, classes, fold, counts.ravel(), others)
    blocks.release()
    rows.unpersist()
    coefs = np.ascontiguousarray(fit.weights[:-1].T).reshape(folds, k, -1)
    info = {**fit.info(), "calibrated": settled}
    return CalibratedSvcModel(coefs, fit.weights[-1].reshape(folds, k), a.reshape(folds, k), b.reshape(folds, k), labels, info)


def train_boosted(
    train: DataFrame, label: str = LABEL, max_iter: int = 80, depth: int = 5, step: float = 0.3, bins: int = 64, weights: str | None = "balanced"
) -> BoostedModel:
    """``max_iter`` rounds of a tree for each class under a softmax objective; rows weigh by their class."""
    indexed, labels = _indexed(train, label)
    indexed = indexed.select("features", "_y").persist()
    cost = class_weight(_class_counts(indexed, len(labels))[0], weights)
    w = F.element_at(F.array(*[F.lit(float(v)) for v in cost]), F.col("_y").cast("int") + 1)
    blocks = Blocks(indexed, {"y": F.col("_y"), "w": w})
    forest = boost(indexed, blocks, len(labels), max_iter, depth, step, bins)
    width = blocks.width
    blocks.release()
    indexed.unpersist()
    return BoostedModel(forest, width, labels, {"trees": len(forest.feature), "splits": int((forest.feature >= 0).sum())})


# The model names a job configuration may use.
MODELS: dict[str, Callable[..., TrainedModel]] = {
    "logistic_regression": train_logistic,
    "linear_svc": train_calibrated_svc,
    "xgboost": train_boosted,
}

_RESTORE = {m.kind: m for m in (LogisticModel, CalibratedSvcModel, BoostedModel)}


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    saved = json.loads(spark.read.text(f"{path}/state").first()["value"])
    numbers: dict[str, list] = {}
    shapes = {}
    for r in spark.read.parquet(f"{path}/numbers").orderBy("name", "row").collect():  # as large as the model
        numbers.setdefault(r["name"], []).append(r["v"])
        shapes[r["name"]] = r["shape"]
    return _RESTORE[saved["kind"]].restore(saved["labels"], saved["info"], {n: np.array(v).reshape(shapes[n]) for n, v in numbers.items()})


def coefficient_table(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """``(label, idx, coef)`` without zeros; folds of a calibrated model are averaged."""
    import pandas as pd

    coefs, _ = model.linear_parts()
    rows, cols = np.nonzero(coefs)
    frame = pd.DataFrame({"label": np.array(model.labels, dtype=object)[rows], "idx": cols.astype("int64"), "coef": coefs[rows, cols]})
    return spark.createDataFrame(frame, "label string, idx long, coef double")


def average_fold_coefficients(folds: DataFrame) -> DataFrame:
    """Mean coefficient per class and feature of a ``(fold, label, idx, coef)`` table.

    The table must be complete: a coefficient of zero has to be a row.
    """
    return folds.groupBy("label", "idx").agg(F.avg("coef").alias("coef"))


def train_plain_svm(train: DataFrame, label: str, max_iter: int = 100, c: float = 1.0):
    """The older setup: one-vs-rest linear SVM without calibration or weights. Returns (coefficients, intercepts) and labels."""
    indexed, labels = _indexed(train, label)
    k = len(labels)
    blocks = Blocks(indexed, {"y": F.col("_y"), "fold": F.lit(-1)})
    fit = svm_fit(blocks, np.arange(k), np.zeros(k), np.full(k, c), np.full(k, c), max_iter)
    blocks.release()
    return (np.ascontiguousarray(fit.weights[:-1].T), fit.weights[-1]), labels


class DenseModel(TrainedModel):
    """The older dense network."""

    kind = "dense_network"

    def __init__(self, network: Network, labels: list[str], info: dict | None = None):
        self.network, self.labels, self.info = network, labels, info or {}

    def probabilities(self, df: DataFrame) -> DataFrame:
        return add_scores(df, "probability", len(self.labels), network_scores, (self.network.shape, self.network.flat))

    def numbers(self):
        return {"shape": np.array([self.network.shape]), "weights": self.network.flat[None, :]}

    @classmethod
    def restore(cls, labels, info, numbers):
        return cls(Network(tuple(int(x) for x in numbers["shape"][0]), numbers["weights"][0]), labels, info)


_RESTORE[DenseModel.kind] = DenseModel


def train_dense_network(
    train: DataFrame, label: str = LABEL, hidden: tuple[int, ...] = (512, 256), epochs: int = 5,
    dropout: tuple[float, ...] = (0.5, 0.3), rate: float = 1e-3,
) -> DenseModel:
    """The older network: rectified layers with dropout, trained in mini-batches for some epochs."""
    labels = label_list(train, label)
    return DenseModel(train_network(train, labels, label, hidden, epochs, dropout, rate), labels, {"epochs": epochs})
