"""Build the labelled, cleaned and split dataset from a report table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions.text import classical_tokens
from caseloom.operators.cleaning import clean_reports
from caseloom.operators.labels import engineer_labels
from caseloom.operators.lemma import apply_lemmas, lemma_table, token_counts
from caseloom.operators.quality import assert_no_text_leakage
from caseloom.operators.splits import assert_splittable, stratified_split, time_split
from caseloom.session import settle
from caseloom.sources.tables import write_splits, write_taxonomy


@dataclass(frozen=True)
class Dataset:
    """Where a build left its tables."""

    splits: str
    taxonomy: str
    lemmas: str


def run_dataset_build(
    reports: DataFrame,
    out: str,
    min_rows: int = config.MIN_CLASS_ROWS,
    taxonomy: DataFrame | None = None,
    max_year: int = config.TIME_TRAIN_MAX_YEAR,
    seed: int = config.SEED,
    lemmas: bool = True,
    lemma_min_count: int = 1,
) -> Dataset:
    """Clean, label, normalise, split, check, write.

    The whole texts are shuffled once, for deduplication, after the row filters and before
    any text work. The result is written; every later step reads a few columns of it or
    works row by row: label and lemma tables are small and broadcast, splits compare a row
    with the cut values of its class. ``lemma_min_count`` is how often a form must occur to
    count as known, which keeps misspellings of a very large corpus out of the lemma table.
    """
    cleaned = clean_reports(reports).withColumn("_tokens", classical_tokens(config.TEXT))
    base = settle(cleaned, "cleaned")
    labelled, kept = engineer_labels(base, taxonomy, min_rows=min_rows)
    write_taxonomy(kept, f"{out}/taxonomy")
    kept = base.sparkSession.read.schema("label string").json(f"{out}/taxonomy")
    labelled, _ = engineer_labels(base, kept)
    assert_splittable(labelled)
    if lemmas:
        lemma_table(token_counts(base, "_tokens"), min_count=lemma_min_count).write.mode("overwrite").parquet(f"{out}/lemmas")
        table = base.sparkSession.read.parquet(f"{out}/lemmas")
        labelled = apply_lemmas(labelled, "_tokens", table)
    done = time_split(stratified_split(labelled, seed=seed), max_year=max_year)
    write_splits(done.withColumn(config.CLEAN_TEXT, F.array_join("_tokens", " ")).drop("_tokens"), f"{out}/splits")
    written = base.sparkSession.read.parquet(f"{out}/splits")
    assert_no_text_leakage(written)
    return Dataset(f"{out}/splits", f"{out}/taxonomy", f"{out}/lemmas")
