"""Word and character n-gram features with smoothed inverse document frequency.

A featurizer is fitted with one aggregation over the train split. What reaches the
driver is the vocabulary, bounded by ``max_features``. The result is a Spark ML
``PipelineModel``, so it saves, loads and streams like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, MaxAbsScaler, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.config import CHAR_SPEC, CLEAN_TEXT, WORD_SPEC, NgramSpec
from caseloom.functions.words import STOPWORDS
from caseloom.operators.ngrams import char_run_counts, word_run_counts


def word_tokens_sql(text: str) -> str:
    """Words of a cleaned text that have at least two characters."""
    return f"filter(split(`{text}`, ' '), t -> length(t) > 1)"


def word_grams_sql(tokens: str, low: int, high: int) -> str:
    runs = [
        f"if(size({tokens}) >= {n}, transform(sequence(1, size({tokens}) - {n - 1}), "
        f"i -> array_join(slice({tokens}, i, {n}), ' ')), array())"
        if n > 1 else tokens
        for n in range(low, high + 1)
    ]
    return runs[0] if len(runs) == 1 else f"concat({', '.join(runs)})"


def padded_tokens_sql(text: str) -> str:
    """All words of a cleaned text with a blank on each side."""
    return f"transform(filter(split(`{text}`, ' '), t -> t != ''), t -> concat(' ', t, ' '))"


def char_grams_sql(padded: str, low: int, high: int) -> str:
    """Every window of each padded word; a word shorter than ``low`` is taken whole, once."""
    windows = ", ".join(
        f"if(length(p) >= {n}, transform(sequence(1, length(p) - {n - 1}), i -> substring(p, i, {n})), array())"
        for n in range(low, high + 1)
    )
    whole = f"if(length(p) < {low}, array(p), array())"
    return f"flatten(transform({padded}, p -> concat({whole}, {windows})))"


def gram_counts(df: DataFrame, grams: str) -> DataFrame:
    """``(term, tf, df)``: occurrences and number of rows, from one explode.

    Sorting each row's grams puts repeats side by side, so "first in its row" is a
    comparison with the neighbour and no (row, term) pairs have to be shuffled.
    """
    ordered = df.select(F.sort_array(grams).alias("_g"))
    marked = F.transform("_g", lambda g, i: F.struct(
        g.alias("term"), F.when((i > 0) & (F.get("_g", i - 1) == g), 0).otherwise(1).alias("first")
    ))
    return ordered.select(F.inline(marked)).groupBy("term").agg(
        F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df")
    )


def char_gram_counts(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """``(term, tf, df)`` of character n-grams, made of different words only."""
    words = df.select(F.expr(f"filter(split(`{text}`, ' '), t -> t != '')").alias("_w"))
    return char_run_counts(words, "_w", low, high)


def top_terms(counts: DataFrame, spec: NgramSpec) -> DataFrame:
    """The ``max_features`` most frequent terms found in ``min_df`` rows, ties by spelling."""
    return counts.filter(F.col("df") >= spec.min_df).orderBy(F.desc("tf"), "term").limit(spec.max_features)


def word_vocabulary(df: DataFrame, spec: NgramSpec = WORD_SPEC, text: str = CLEAN_TEXT) -> DataFrame:
    tokens = df.select(F.expr(word_tokens_sql(text)).alias("_w"))
    return top_terms(word_run_counts(tokens, "_w", spec.low, spec.high), spec)


def char_vocabulary(df: DataFrame, spec: NgramSpec = CHAR_SPEC, text: str = CLEAN_TEXT) -> DataFrame:
    return top_terms(char_gram_counts(df, text, spec.low, spec.high), spec)


def smoothed_idf(n_rows: int, df: int) -> float:
    return math.log((1 + n_rows) / (1 + df)) + 1


def _block(vocabulary: DataFrame, n_rows: int, grams: list[str], prefix: str, out: str) -> tuple[list, list[str]]:
    """Stages that turn a text column into one normalised block, and its terms in order."""
    terms = sorted((r["term"], r["df"]) for r in vocabulary.select("term", "df").collect())
    names = [t for t, _ in terms]
    if not names:
        raise ValueError("no term reaches the document frequency floor")
    tokens, runs = grams
    counted, scaled = f"_{prefix}_tf", f"_{prefix}_idf"
    counter = CountVectorizerModel.from_vocabulary(names, inputCol=f"_{prefix}_grams", outputCol=counted)
    stages = [
        SQLTransformer(statement=f"SELECT *, {tokens} AS _{prefix}_tokens FROM __THIS__"),
        SQLTransformer(statement=f"SELECT * EXCEPT (_{prefix}_tokens), {runs} AS _{prefix}_grams FROM __THIS__"),
        counter,
        ElementwiseProduct(scalingVec=Vectors.dense([smoothed_idf(n_rows, d) for _, d in terms]), inputCol=counted, outputCol=scaled),
        Normalizer(p=2.0, inputCol=scaled, outputCol=out),
        SQLTransformer(statement=f"SELECT * EXCEPT (_{prefix}_grams, {counted}, {scaled}) FROM __THIS__"),
    ]
    return stages, names


def _word_block(df: DataFrame, spec: NgramSpec, text: str, out: str, n_rows: int):
    grams = [word_tokens_sql(text), word_grams_sql("_word_tokens", spec.low, spec.high)]
    return _block(word_vocabulary(df, spec, text), n_rows, grams, "word", out)


def fit_word_tfidf(
    train: DataFrame, word: NgramSpec = WORD_SPEC, char: NgramSpec | None = None, text: str = CLEAN_TEXT, out: str = "features"
) -> PipelineModel:
    """Word n-grams; weight = count x (ln((1+rows)/(1+df)) + 1), rows scaled to length 1."""
    stages, _ = _word_block(train, word, text, out, train.count())
    return PipelineModel(stages=stages)


def fit_word_char_tfidf(
    train: DataFrame, word: NgramSpec = WORD_SPEC, char: NgramSpec = CHAR_SPEC, text: str = CLEAN_TEXT, out: str = "features"
) -> PipelineModel:
    """Word block, then character block, each scaled to length 1 on its own."""
    n_rows = train.count()
    words, _ = _word_block(train, word, text, "_word_block", n_rows)
    grams = [padded_tokens_sql(text), char_grams_sql("_char_tokens", char.low, char.high)]
    chars, _ = _block(char_vocabulary(train, char, text), n_rows, grams, "char", "_char_block")
    both = VectorAssembler(inputCols=["_word_block", "_char_block"], outputCol=out)
    drop = SQLTransformer(statement="SELECT * EXCEPT (_word_block, _char_block) FROM __THIS__")
    return PipelineModel(stages=[*words, *chars, both, drop])


FEATURIZERS: dict[str, Callable[..., PipelineModel]] = {
    "word_tfidf": fit_word_tfidf,
    "word_char_tfidf": fit_word_char_tfidf,
}


def fit_legacy_tfidf(
    df: DataFrame, text: str = CLEAN_TEXT, max_features: int = 5000, drop_stopwords: bool = True, out: str = "features"
) -> PipelineModel:
    """The older 1-2-gram block: no document frequency floor, optional stopword removal."""
    spec = NgramSpec(1, 2, 1, max_features)
    tokens = word_tokens_sql(text)
    if drop_stopwords:
        listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in STOPWORDS)
        tokens = f"filter({tokens}, t -> t NOT IN ({listed}))"
    runs = word_grams_sql("_word_tokens", 1, 2)
    words = df.select(F.expr(tokens).alias("_word_tokens"))
    stages, _ = _block(top_terms(word_run_counts(words, "_word_tokens", 1, 2), spec), df.count(), [tokens, runs], "word", out)
    return PipelineModel(stages=stages)


def feature_names(featurizer: PipelineModel) -> list[str]:
    """Term of every feature index; character terms start with ``char:``."""
    counters = [s for s in featurizer.stages if isinstance(s, CountVectorizerModel)]
    return [
        ("char:" if s.getInputCol() == "_char_grams" else "") + term for s in counters for term in s.vocabulary
    ]


def feature_table(spark, featurizer: PipelineModel) -> DataFrame:
    """``(idx, term)``"""
    return spark.createDataFrame(list(enumerate(feature_names(featurizer))), "idx long, term string")


def explode_features(df: DataFrame, key: str | list[str], features: str = "features") -> DataFrame:
    """``(key, idx, weight)`` for the non-zero entries, read from the sparse vector itself."""
    keys = [key] if isinstance(key, str) else key
    raw = F.unwrap_udt(F.col(features))
    # A dense vector has no index list; its positions are the indices.
    indices = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    pairs = F.arrays_zip(indices.alias("idx"), raw["values"].alias("weight"))
    flat = df.select(*keys, F.inline(pairs).alias("idx", "weight"))
    return flat.filter(F.col("weight") != 0).withColumn("idx", F.col("idx").cast("long"))


def scale_by_max(df: DataFrame, features: str = "features", out: str = "scaled") -> DataFrame:
    """Divide every feature by its largest absolute value."""
    return MaxAbsScaler(inputCol=features, outputCol=out).fit(df).transform(df)
