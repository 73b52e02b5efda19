"""Class weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom import config
from caseloom.operators.lookup import lookup
from caseloom.operators.splits import class_sizes


def balanced_weights(df: DataFrame, label: str = config.LABEL) -> DataFrame:
    """``(label, n, weight)`` with weight = rows / (classes x rows of the class)."""
    everything = Window.partitionBy(F.lit(0))
    return class_sizes(df, label).withColumn(
        "weight", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    )


def root_weights(df: DataFrame, labels: DataFrame, label: str = config.LABEL) -> DataFrame:
    """``(label, weight)``: square roots of the balanced weights; absent classes get 1.

    ``labels`` lists the classes in a column ``label``.
    """
    found = balanced_weights(df, label).select(F.col(label).alias("label"), F.sqrt("weight").alias("weight"))
    return labels.select("label").join(found, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def with_balanced_weights(df: DataFrame, label: str = config.LABEL, out: str = "weight") -> DataFrame:
    weights = balanced_weights(df, label).select(label, F.col("weight").alias(out))
    return lookup(df, weights, [label])


def class_weight(counts: np.ndarray, scheme: str | None) -> np.ndarray:
    """Weights of classes from their numbers of rows: balanced, root (square roots of balanced ones) or None; absent ones get 1."""
    if scheme not in ("balanced", "root", None):
        raise ValueError(f"no such class weights: {scheme}")
    if scheme is None:
        return np.ones(len(counts))
    balanced = counts.sum() / ((counts > 0).sum() * np.maximum(counts, 1))
    return np.where(counts > 0, balanced if scheme == "balanced" else np.sqrt(balanced), 1.0)
