"""Label taxonomy, indexing and one-hot coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions.records import first_tag
from caseloom.operators.lookup import lookup


def label_counts(df: DataFrame, label: str | Column) -> DataFrame:
    """``(label, n)``; nulls are not counted."""
    label = F.col(label) if isinstance(label, str) else label
    return df.select(label.alias("label")).filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def build_taxonomy(df: DataFrame, tags: str = config.TAGS, min_rows: int = config.MIN_CLASS_ROWS) -> DataFrame:
    """One column ``label``: primary tags with at least ``min_rows`` rows."""
    return label_counts(df, first_tag(tags)).filter(F.col("n") >= min_rows).select("label")


def fold_rare(df: DataFrame, raw: str, taxonomy: DataFrame, out: str = config.LABEL, other: str = config.OTHER) -> DataFrame:
    """Add ``out``: the raw label if the taxonomy has it, else ``other``. Null folds too."""
    kept = taxonomy.select(F.col("label").alias(raw), F.col("label").alias("_kept"))
    return lookup(df, kept, [raw]).withColumn(out, F.coalesce("_kept", F.lit(other))).drop("_kept")


def engineer_labels(
    df: DataFrame,
    taxonomy: DataFrame | None = None,
    tags: str = config.TAGS,
    min_rows: int = config.MIN_CLASS_ROWS,
    out: str = config.LABEL,
) -> tuple[DataFrame, DataFrame]:
    """Add the primary label and return it with the taxonomy used.

    Without a taxonomy one is built from all of ``df``, on purpose before any split: which
    tags are frequent is a choice of label space. A given taxonomy is applied as it is, so
    tags it has never seen fold into the rest class.
    """
    if taxonomy is None:
        taxonomy = build_taxonomy(df, tags, min_rows)
    raw = df.withColumn("_primary", first_tag(tags))
    return fold_rare(raw, "_primary", taxonomy, out).drop("_primary"), taxonomy


def top_labels(df: DataFrame, label: str, n: int) -> DataFrame:
    """``(label, n)`` of the ``n`` most frequent labels, ties by label."""
    return label_counts(df, label).orderBy(F.desc("n"), "label").limit(n)


def group_to_top(df: DataFrame, label: str, n: int = 20, out: str = "label_grouped", other: str = "Other") -> DataFrame:
    """Add ``out``: the label if among the top ``n``, else ``other``."""
    return fold_rare(df, label, top_labels(df, label, n), out, other)


def rows_of_top(df: DataFrame, label: str, n: int = 20) -> DataFrame:
    """Only rows whose label is among the top ``n``."""
    top = top_labels(df, label, n).select(F.col("label").alias(label))
    return lookup(df, top, [label], "left_semi")


def label_space(df: DataFrame, label: str = config.LABEL) -> DataFrame:
    """``(label, idx)``: sorted distinct labels numbered from 0.

    The numbering is one sort of the label table, which has a row per class.
    """
    names = label_counts(df, label).agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return names.select(F.posexplode("labels").alias("idx", "label")).select("label", F.col("idx").cast("long").alias("idx"))


def index_labels(df: DataFrame, space: DataFrame, label: str = config.LABEL, out: str = "label_idx") -> DataFrame:
    """Add the index of each label as a double, null for labels outside the space."""
    codes = space.select(F.col("label").alias(label), F.col("idx").cast("double").alias(out))
    return lookup(df, codes, [label])


def labels_from_index(df: DataFrame, space: DataFrame, idx: str = "prediction", out: str = "pred") -> DataFrame:
    """The inverse of ``index_labels``."""
    names = space.select(F.col("idx").cast("double").alias(idx), F.col("label").alias(out))
    return lookup(df, names, [idx])


def one_hot(idx: str, n_classes: int) -> Column:
    """``array<double>`` with a single 1 at the label's index."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == F.col(idx).cast("int")).cast("double")
    )
