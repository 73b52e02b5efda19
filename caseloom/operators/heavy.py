"""Vocabularies by mergeable heavy hitters.

Counting every n-gram shuffles a row for each different one of each task, of which a vocabulary keeps a few. Here a task
sums up its n-grams in a table of bounded size. When that overflows, the count of the largest term that has no room is
taken off all terms, and those at zero go (Misra and Gries); so a term occurs at least as often as its count says, and at
most the task's ``error`` more. Both bounds add up over tasks.

The k-th largest sum among terms that are surely in enough rows is a floor: a term whose upper bound is below it is not in
the vocabulary. If terms in no table have upper bounds below it too, the others are candidates, and only they are counted
in a second pass. Where no table overflowed, the sums are exact and there is no second pass; where the bound does not decide,
all terms are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.config import CHAR_SPEC, CLEAN_TEXT, WORD_SPEC, NgramSpec
from caseloom.operators.features import char_grams_sql, gram_counts, padded_tokens_sql, top_terms, word_grams_sql, word_tokens_sql
from caseloom.operators.lookup import lookup
from caseloom.session import settle

CAPACITY = 1_000_000  # terms of a task's table
SLICE = 500_000  # n-grams that are numbered at a time
ROWS = "term string, tf long, df long, error long"


class Summary:
    """Terms with counts; no more than ``capacity`` after ``prune``, and about three times as many before."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.table = pa.table({"term": pa.array([], pa.string()), "tf": pa.array([], pa.int64()), "df": pa.array([], pa.int64())})
        self.waiting: list[pa.Table] = []
        self.held = 0

    def add(self, grams: pa.ListArray) -> None:
        """The n-grams of some rows, counted no more than ``SLICE`` and a row at a time."""
        ends = np.cumsum(pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = min(int(np.searchsorted(ends, before + SLICE, "left")) + 1, len(ends))
            self._count(grams.slice(at, stop - at))
            at = stop

    def _count(self, grams: pa.ListArray) -> None:
        lengths = pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False)
        encoded = grams.flatten().dictionary_encode()
        codes, terms = encoded.indices.to_numpy(zero_copy_only=False).astype("i8"), encoded.dictionary
        n = max(len(terms), 1)
        row = np.repeat(np.arange(len(lengths)), lengths)
        once = np.unique(row * n + codes) % n
        tf, df = np.bincount(codes, minlength=len(terms)), np.bincount(once, minlength=len(terms))
        self.waiting.append(pa.table({"term": terms.cast(pa.string()), "tf": tf.astype("i8")[: len(terms)], "df": df.astype("i8")[: len(terms)]}))
        self.held += len(terms)
        if self.held > 2 * self.capacity:
            self.prune()

    def prune(self) -> None:
        merged = pa.concat_tables([self.table, *self.waiting]).group_by("term", use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
        table = merged.select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])
        if table.num_rows > self.capacity:
            tf = table.column("tf").to_numpy()
            cut = int(-np.partition(-tf, self.capacity)[self.capacity])  # the largest count without room
            self.error += cut
            table = table.set_column(1, "tf", pc.subtract(table.column("tf"), cut)).filter(pc.greater(table.column("tf"), cut))
        self.table, self.waiting, self.held = table.combine_chunks(), [], 0
        pa.default_memory_pool().release_unused()


def summaries(rows: DataFrame, grams: str, capacity: int = CAPACITY) -> DataFrame:
    """(term, tf, df, error): each task's terms, and a row without a term that holds its error."""

    def run(batches):
        kept = Summary(capacity)
        for batch in batches:
            kept.add(batch.column(0))
        kept.prune()
        n = kept.table.num_rows
        whole = kept.table.append_column("error", pa.array(np.zeros(n, "i8")))
        yield from whole.to_batches(max_chunksize=10_000)
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "tf": [0], "df": [0], "error": [kept.error]})

    return rows.select(grams).mapInArrow(run, ROWS)


def frequent_terms(rows: DataFrame, grams: str, spec: NgramSpec, capacity: int = CAPACITY) -> DataFrame:
    """(term, tf, df): the same rows as ``top_terms(gram_counts(rows, grams), spec)``."""
    kept = settle(summaries(rows, grams, capacity), "summaries")
    error = kept.agg(F.sum("error")).first()[0] or 0
    merged = kept.filter("term is not null").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    if not error:
        return top_terms(merged, spec)
    merged = settle(merged, "merged")
    sure = top_terms(merged, spec).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("floor")).first()
    if sure["n"] < spec.max_features or sure["floor"] <= error:
        return top_terms(gram_counts(rows, grams), spec)
    candidates = merged.filter(F.col("tf") + error >= sure["floor"]).select("term")
    return top_terms(counts_of(rows, grams, candidates), spec)


def counts_of(rows: DataFrame, grams: str, terms: DataFrame) -> DataFrame:
    """(term, tf, df) of the given terms alone."""
    ordered = rows.select(F.sort_array(grams).alias("_g"))
    marked = F.transform("_g", lambda g, i: F.struct(
        g.alias("term"), F.when((i > 0) & (F.get("_g", i - 1) == g), 0).otherwise(1).alias("first")
    ))
    found = lookup(ordered.select(F.inline(marked)), terms, ["term"], "left_semi")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))


def word_grams(df: DataFrame, spec: NgramSpec = WORD_SPEC, text: str = CLEAN_TEXT) -> DataFrame:
    return df.select(F.expr(word_tokens_sql(text)).alias("_w")).select(F.expr(word_grams_sql("_w", spec.low, spec.high)).alias("_grams"))


def char_grams(df: DataFrame, spec: NgramSpec = CHAR_SPEC, text: str = CLEAN_TEXT) -> DataFrame:
    return df.select(F.expr(padded_tokens_sql(text)).alias("_p")).select(F.expr(char_grams_sql("_p", spec.low, spec.high)).alias("_grams"))


def word_vocabulary(df: DataFrame, spec: NgramSpec = WORD_SPEC, text: str = CLEAN_TEXT, capacity: int = CAPACITY) -> DataFrame:
    return frequent_terms(word_grams(df, spec, text), "_grams", spec, capacity)


def char_vocabulary(df: DataFrame, spec: NgramSpec = CHAR_SPEC, text: str = CLEAN_TEXT, capacity: int = CAPACITY) -> DataFrame:
    return frequent_terms(char_grams(df, spec, text), "_grams", spec, capacity)
