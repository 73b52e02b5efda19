"""Scoring tables: ranked alternatives, explanations, comparison and report rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import config
from caseloom.functions.records import confidence_band, leading_terms, ranked_labels, split_by_sign
from caseloom.functions.text import classical_tokens
from caseloom.operators.attribution import class_forest, contributions, paths_of
from caseloom.operators.blocks import entries_of
from caseloom.operators.features import explode_features, feature_names, feature_table
from caseloom.operators.lemma import apply_lemmas
from caseloom.operators.lookup import lookup
from caseloom.operators.models import BoostedModel, TrainedModel, coefficient_table
from caseloom.operators.splits import seeded_sample


TREE_ROWS = 128  # explained at a time against all leaves of a class
EXPLANATION_TYPE = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("contribution", T.DoubleType())]))
EXPLANATION = EXPLANATION_TYPE.simpleString()


def clean_for_scoring(df: DataFrame, text: str, lemmas: DataFrame | None = None, out: str = config.CLEAN_TEXT) -> DataFrame:
    tokens = df.withColumn("_tokens", classical_tokens(text, apart=lemmas is not None))
    if lemmas is not None:
        tokens = apply_lemmas(tokens, "_tokens", lemmas)
    return tokens.withColumn(out, F.array_join("_tokens", " ")).drop("_tokens")


def term_contributions(df: DataFrame, featurizer: PipelineModel, model: TrainedModel, key: str) -> DataFrame:
    """``(key, predicted_label, term, contribution)`` for every non-zero feature of each row."""
    spark = df.sparkSession
    weights = explode_features(df, [key, "predicted_label"])
    coefs = coefficient_table(spark, model).withColumnRenamed("label", "predicted_label")
    named = lookup(coefs, feature_table(spark, featurizer), ["idx"])
    joined = lookup(weights, named, ["predicted_label", "idx"], "inner")
    return joined.select(key, "predicted_label", "term", (F.col("weight") * F.col("coef")).alias("contribution"))


def with_explanation(df: DataFrame, featurizer: PipelineModel, model: TrainedModel, top: int = config.EXPLAIN_TERMS) -> DataFrame:
    """Add ``explanation``: the ``top`` terms by signed contribution to the predicted label.

    Exploding and regrouping would shuffle every non-zero entry. The coefficients are as large as the model, so they are
    broadcast; only label, indices and values go to Python, in Arrow batches. Features of weight zero are no terms,
    whether the vector is sparse or dense. Boosted trees are explained by ``attribution``. Other models without coefficients
    give null. ``features`` is dropped.
    """
    if isinstance(model, BoostedModel):
        return _with_tree_explanation(df, featurizer, model, top)
    try:
        coefs, _ = model.linear_parts()
    except TypeError:
        return without_explanation(df.drop("features"))
    shared = df.sparkSession.sparkContext.broadcast((coefs, feature_names(featurizer), model.labels))

    @F.arrow_udf(EXPLANATION_TYPE)
    def explain(label: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        weights, terms, labels = shared.value
        place = {name: i for i, name in enumerate(labels)}
        row_class = np.array([place[x] for x in label.to_pylist()], dtype=np.int64)
        return _leading_terms(indices, values, row_class, weights, pa.array(terms), top)

    raw = F.unwrap_udt("features")
    indices = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    explained = df.withColumn("explanation", explain("predicted_label", indices, raw["values"])).drop("features")
    return explained.withColumn("explanation_method", F.lit("coefficient"))


def _with_tree_explanation(df: DataFrame, featurizer: PipelineModel, model: BoostedModel, top: int) -> DataFrame:
    """Contributions of terms, present and absent, to the score of the predicted label; zeros are left out."""
    k = len(model.labels)
    forests = [class_forest(model.forest, c, k) for c in range(k)]
    given = [(f, paths_of(f)) for f in forests]
    shared = df.sparkSession.sparkContext.broadcast((given, feature_names(featurizer), model.labels, model.width))

    @F.arrow_udf(EXPLANATION_TYPE)
    def explain(label: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        forests, terms, labels, width = shared.value
        place = {name: i for i, name in enumerate(labels)}
        row_class = np.array([place[x] for x in label.to_pylist()], dtype=np.int64)
        lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        starts = np.cumsum(lengths) - lengths
        idx, x = (a.flatten().to_numpy(zero_copy_only=False) for a in (indices, values))
        found: list[list[dict]] = [[] for _ in range(len(lengths))]
        for c, (forest, paths) in enumerate(forests):
            rows = np.flatnonzero(row_class == c)
            for a in range(0, len(rows), TREE_ROWS):
                part = rows[a : a + TREE_ROWS]
                entries = np.concatenate([np.arange(starts[r], starts[r] + lengths[r]) for r in part])
                cut = np.cumsum(lengths[part]) - lengths[part]
                asked, phi = contributions(forest, paths, cut, idx[entries], x[entries], len(part), width)
                order = np.argsort(-phi, axis=1, kind="stable")[:, :top]  # ties by index, which is by term
                for i, r in enumerate(part.tolist()):
                    found[r] = [{"term": terms[asked[j]], "contribution": round(float(phi[i, j]), 4) + 0.0} for j in order[i] if phi[i, j] != 0]
        return pa.array(found, pa.list_(pa.struct([("term", pa.string()), ("contribution", pa.float64())])))

    explained = df.withColumn("explanation", explain("predicted_label", *entries_of("features"))).drop("features")
    return explained.withColumn("explanation_method", F.lit("tree paths"))


def without_explanation(df: DataFrame) -> DataFrame:
    return df.withColumn("explanation", F.lit(None).cast(EXPLANATION)).withColumn("explanation_method", F.lit(None).cast("string"))


def _leading_terms(indices: pa.Array, values: pa.Array, row_class: np.ndarray, weights: np.ndarray, terms: pa.Array, top: int) -> pa.Array:
    """Rank coefficient x value of all rows of a batch in one sort, ties by term."""
    lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    idx = indices.flatten().to_numpy(zero_copy_only=False)
    x = values.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    there = x != 0
    idx, x, row = idx[there], x[there], row[there]
    sizes = np.bincount(row, minlength=len(lengths))
    part = weights[row_class[row], idx] * x
    # Feature order is term order within a block, so the index breaks ties by term.
    order = np.lexsort((idx, -part, row))
    starts = np.cumsum(sizes) - sizes
    best = order[(np.arange(len(order)) - starts[row[order]]) < top]
    taken = np.minimum(sizes, top)
    offsets = pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32))
    pairs = pa.StructArray.from_arrays([terms.take(pa.array(idx[best])), pa.array(np.round(part[best], 4) + 0.0)], ["term", "contribution"])
    return pa.ListArray.from_arrays(offsets, pairs)


def score_records(
    df: DataFrame, featurizer: PipelineModel, model: TrainedModel, backend: str = "baseline", explain: bool = True,
    top_k: int = config.TOP_K, text: str = config.CLEAN_TEXT,
) -> DataFrame:
    """Add label, confidence, ranked alternatives and, if asked, the explanation."""
    labels = F.array(*[F.lit(x) for x in model.labels])
    scored = model.predict(featurizer.transform(df))
    ranked = scored.withColumn("top_k", ranked_labels("probability", labels, top_k)).withColumn("confidence", F.round("confidence", 4))
    if explain:
        ranked = with_explanation(ranked, featurizer, model)
    else:
        ranked = without_explanation(ranked.drop("features"))
    return ranked.withColumn("model_backend", F.lit(backend))


def compare_backends(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Per row whether two prediction tables agree, and counts per pair of labels."""
    left = a.select(key, F.col("predicted_label").alias("label_a"), F.col("top_k").alias("top_k_a"))
    right = b.select(key, F.col("predicted_label").alias("label_b"), F.col("top_k").alias("top_k_b"))
    rows = left.join(right, key).withColumn("agree", F.col("label_a") == F.col("label_b"))
    return rows, rows.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def report_rows(df: DataFrame, text: str = config.TEXT) -> DataFrame:
    """Flat rows for export: second alternative, its confidence, the leading terms."""
    second = F.get("top_k", 1)
    return df.select(
        F.col(text).alias("text"),
        "predicted_label",
        "confidence",
        F.coalesce(second["label"], F.lit("")).alias("top_2"),
        second["confidence"].alias("top_2_confidence"),
        leading_terms("explanation").alias("top_terms"),
    )


def example_report(scored: DataFrame, n: int = 10, key: str = config.KEY, label: str = config.LABEL, seed: int = config.SEED) -> DataFrame:
    """A seeded sample with true and predicted label, correctness and the sample's accuracy."""
    from pyspark.sql import Window

    sample = seeded_sample(scored, n, key, seed).withColumn("correct", F.col("predicted_label") == F.col(label))
    accuracy = F.avg(F.col("correct").cast("double")).over(Window.partitionBy(F.lit(0)))
    return sample.withColumn("sample_accuracy", accuracy).withColumnRenamed(label, "true_label")


def band_counts(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.groupBy(confidence_band(confidence).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def signed_terms(df: DataFrame, explanation: str | Column = "explanation") -> DataFrame:
    for_, against = split_by_sign(explanation)
    return df.withColumn("supporting", for_).withColumn("opposing", against)
