"""Counts and rankings for a first look at a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import content_words
from caseloom.operators.labels import label_counts


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_distinct"))


def value_counts(df: DataFrame, value: str | Column, n: int | None = None) -> DataFrame:
    """``(value, n)``, most frequent first, ties by value; nulls are not counted."""
    ordered = label_counts(df, value).select(F.col("label").alias("value"), "n").orderBy(F.desc("n"), "value")
    return ordered if n is None else ordered.limit(n)


def extreme_classes(df: DataFrame, label: str) -> DataFrame:
    """One row: most and least frequent label with their sizes; ties go to the first name."""
    counts = label_counts(df, label).withColumnRenamed("label", "value")
    return counts.agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_frequent"),
        F.max("n").alias("most_rows"),
        F.min_by("value", F.struct(F.col("n"), F.col("value"))).alias("least_frequent"),
        F.min("n").alias("least_rows"),
    )


def word_frequencies(df: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """``(value, n)`` over the content words of all texts."""
    return value_counts(df.select(F.explode(content_words(text)).alias("word")), "word", n)
