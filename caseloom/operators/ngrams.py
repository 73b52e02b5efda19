"""Counts of n-grams in Arrow batches.

A task numbers the different words of some rows, makes n-grams of numbers and not of strings, and writes each different
n-gram of these rows once, with its occurrences and rows. Spark adds up these counts before and after the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_TOKENS = 500_000  # of the rows that are counted together
CHAR_TOKENS = 100_000  # the same where each word gives some ten n-grams
COUNTS = "term string, tf long, df long"


def word_run_counts(df: DataFrame, tokens: str, low: int, high: int) -> DataFrame:
    """``(term, tf, df)`` of runs of ``low`` to ``high`` words in the array ``tokens``, whose words hold no blank."""

    def run(batches):
        for words, row, codes in _numbered(batches, WORD_TOKENS):
            terms, ids, at = words, codes, row
            for n in range(1, high + 1):
                if n > 1:
                    inside = at[: len(at) - 1] == row[n - 1 :]
                    pairs = ids[:-1] * len(words) + codes[n - 1 :]
                    # a run that leaves its row gets the number -1
                    pairs[~inside | (ids[:-1] < 0)] = -1
                    made, ids = np.unique(pairs, return_inverse=True)
                    if len(made) and made[0] < 0:
                        made, ids = made[1:], ids - 1
                    terms = pc.binary_join_element_wise(terms.take(pa.array(made // len(words))), words.take(pa.array(made % len(words))), " ")
                    at = at[: len(at) - 1]
                if n >= low:
                    there = ids >= 0
                    yield from _counted(terms, np.bincount(ids[there], minlength=len(terms)), ids[there], at[there])
                if len(at) < 2 or not len(terms):
                    break

    return _summed(df.select(tokens).mapInArrow(run, COUNTS))


def char_run_counts(df: DataFrame, tokens: str, low: int, high: int) -> DataFrame:
    """``(term, tf, df)`` of the windows of ``low`` to ``high`` characters in the words of ``tokens``, a blank on each side.

    A shorter word is taken whole. Windows are made of the different words of some rows, not of every word.
    """

    def windows(word: str) -> list[str]:
        word = f" {word} "
        return [word] if len(word) < low else [word[i : i + n] for n in range(low, high + 1) for i in range(len(word) - n + 1)]

    def run(batches):
        for words, row, codes in _numbered(batches, CHAR_TOKENS):
            grams = [windows(w) for w in words.to_pylist()]
            sizes = np.fromiter(map(len, grams), "i8", len(grams))
            encoded = pa.array([g for each in grams for g in each], pa.string()).dictionary_encode()
            of_words, terms = encoded.indices.to_numpy().astype("i8"), encoded.dictionary
            tf = np.bincount(of_words, np.repeat(np.bincount(codes, minlength=len(words)), sizes), len(terms))
            pairs = _different(row * len(words) + codes)
            row, codes = np.divmod(pairs, len(words))
            counts = sizes[codes]
            ends = np.cumsum(counts)
            starts = (np.cumsum(sizes) - sizes)[codes]
            place = np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)
            yield from _counted(terms, tf, of_words[place], np.repeat(row, counts))

    return _summed(df.select(tokens).mapInArrow(run, COUNTS))


def _numbered(batches, most: int):
    """(different words, row of each word, number of each word) of some rows at a time; no more than ``most`` words and a row."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = min(int(np.searchsorted(ends, before + most, "left")) + 1, len(ends))
            encoded = lists.slice(at, stop - at).flatten().dictionary_encode()
            lengths = np.diff(ends[at:stop], prepend=before)
            if len(encoded):
                words = encoded.dictionary.cast(pa.string())
                yield words, np.repeat(np.arange(stop - at), lengths), encoded.indices.to_numpy().astype("i8")
            at = stop


def _different(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _counted(terms: pa.Array, tf: np.ndarray, ids: np.ndarray, row: np.ndarray):
    """The terms with occurrences, and with the number of different rows beside each id."""
    if len(terms):
        rows = int(row[-1]) + 1 if len(row) else 1
        df = np.bincount(_different(ids * rows + row) // rows, minlength=len(terms))
        table = pa.table({"term": terms, "tf": tf.astype("i8"), "df": df.astype("i8")})
        yield from table.to_batches(max_chunksize=50_000)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
