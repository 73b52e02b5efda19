"""Suffix-array dedup: bytes covered by long strings that occur elsewhere.

Fragments that share a context (see ``repeats``) are laid end to end in shards, a context never in two of them; each
shard is sorted by external induced sorting, and windows whose suffix has a neighbour with a window's length in common
are repeated. A context with more than ``CONTEXT_TEXTS`` different texts would be one sort in one task; its windows are
counted by key in a shuffle instead, which finds the same ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import settle
from caseloom.llm.fragments import Hashed
from caseloom.llm.induced import InducedSort, array
from caseloom.llm.repeats import Emitter, keyed, merged, repeated_spans, texts_of, with_spans

ANCHOR_BYTES = 32
SHARD_BYTES = 4 << 20  # a shard is closed at the end of the context that passes this size
TEXTS = "context long, digest long, m long, n int, text binary"
CONTEXT_TEXTS = 4096  # different texts of a context that are sorted together, about 2.5 MB of windows of 400 bytes
FOUND = "context long, digest long, spans array<int>"
WINDOW = "context long, digest long, m long, at int, one long, two long"


def sequence_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "u1").astype("u8") + np.uint64(1)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, where the windows start that also start anywhere else in these texts."""
    long = [t for t in texts if len(t) >= length]
    if not long:
        return [np.array([], "i8") for _ in texts]
    whole = array(sum(len(t) + 1 for t in long), "u2")
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        if len(t) >= length:
            whole[at : at + len(t)] = np.frombuffer(t, "u1").astype("u2") + 1
            at += len(t) + 1  # the symbol 0 ends each text
    hit = InducedSort(whole, 257, length).repeated()
    return [np.flatnonzero(hit[a : a + max(len(t) - length + 1, 0)]) for a, t in zip(starts, texts, strict=True)]


def runs_of(places: np.ndarray, length: int) -> list[int]:
    """Bounds, flat, of the runs of windows that start at ``places``."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    first = places[np.append(0, cut + 1)]
    last = places[np.append(cut, len(places) - 1)]
    return np.stack([first, last + length], axis=1).ravel().tolist()


def by_size(kinds: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``kinds`` of contexts with up to ``most`` different texts, and those of larger ones; None if there are none."""
    large = settle(kinds.groupBy("context").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("context"), "large_contexts")
    if large.isEmpty():
        return kinds, None
    parts = settle(kinds.join(large.withColumn("_large", F.lit(True)), "context", "left"), "kinds_by_size")
    return parts.filter("_large IS NULL").drop("_large"), parts.filter("_large").drop("_large")


def counted_windows(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """(context, digest, spans) like the suffix search, by two 64-bit hashes of each window and their counts."""

    def cut(data, wanted):
        symbols = sequence_of(data)
        for w in wanted:
            piece = symbols[w["first"] : w["first"] + w["n"] + length - 1]
            one, two = (Hashed(piece, k).every(length).view("i8").tolist() for k in (0, 1))
            for at in range(w["n"]):
                yield w["context"], w["digest"], w["m"], at, one[at], two[at]

    windows = settle(texts_of(rows, kinds, cut, WINDOW), "windows")
    key = ["context", "one", "two"]
    repeated = settle(windows.groupBy(*key).agg(F.sum("m").alias("c")).filter("c > 1").select(*key), "repeated_windows")
    places = windows.join(repeated, key).groupBy("context", "digest").agg(F.collect_list("at").alias("places"))
    return places.select("context", "digest", F.flatten(F.transform("places", lambda x: F.array(x, x + length))).alias("spans"))


def suffix_search(length: int, most: int = CONTEXT_TEXTS):
    """The search of ``repeats`` by suffix sorting. Texts of one context that occur twice or more are repeated whole."""

    def search(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        emit = Emitter(FOUND)
        kinds, large = by_size(kinds, most)

        def cut(data, wanted):
            for w in wanted:
                yield w["context"], w["digest"], w["m"], w["n"], data[w["first"] : w["first"] + w["n"] + length - 1]

        def solve(shard):
            texts = [row[4] for row in shard]
            out = []
            for (context, digest, m, n, _), places in zip(shard, repeated_windows(texts, length), strict=True):
                out.append((context, digest, [0, n - 1 + length] if m > 1 else runs_of(places, length)))
            return emit([*zip(*out, strict=True)])

        def run(batches):
            shard, held = [], 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held >= SHARD_BYTES and row[0] != shard[-1][0]:
                        yield solve(shard)
                        shard, held = [], 0
                    shard.append(row)
                    held += len(row[4]) + 1
            if shard:
                yield solve(shard)

        texts = texts_of(rows, kinds, cut, TEXTS)
        found = texts.repartition("context").sortWithinPartitions("context").mapInArrow(run, FOUND)
        return found if large is None else found.unionByName(counted_windows(rows, large, length))

    return search


def remove_repeated_bytes(
    df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, with_bytes: bool = False
) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans and kept_sha256; with ``with_bytes`` also kept_bytes.

    A byte of the UTF-8 text goes if it lies in ``length`` consecutive bytes of its document that also start anywhere
    else, in the same document included; strings are judged on the input. Spans are the maximal removed runs. Null and
    empty texts have no bytes, shorter texts no strings. Rows that repeat an id and text repeat each other's strings
    like any two rows. Columns of these names are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    rows = keyed(df, doc_id, text, kept)
    spans = repeated_spans(rows, sequence_of, length, min(ANCHOR_BYTES, length), suffix_search(length))

    def make():
        def compute(texts, spans):
            n_bytes, n_removed, n_spans, sha, left = [], [], [], [], []
            for value, flat in zip(texts, spans, strict=True):
                data = value.as_py()
                bounds = merged(flat.as_py())
                parts, at = [], 0
                for a, b in bounds.tolist():
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]])
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                n_spans.append(len(bounds))
                sha.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            return [n_bytes, n_removed, n_spans, sha, *([left] if with_bytes else [])]

        return compute

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return with_spans(rows, spans, ddl, make, kept)
