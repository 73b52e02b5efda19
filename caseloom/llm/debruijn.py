"""Substring dedup of words with a compacted De Bruijn graph.

Edges are windows of ``window`` words (k-mers), nodes the windows one word shorter at their ends. Edges that occur
once are dropped. Of the others, chains through nodes with one edge in and one out are compacted by joins: each edge
finds the end of its chain by doubling. The occurrences of a chain in a text then are one span, which its source
coordinates confirm.

Only fragments whose context is repeated with different surroundings need the graph; see ``repeats``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import settle
from caseloom.llm.fragments import Hashed
from caseloom.llm.repeats import keyed, merged, repeated_spans, texts_of, with_spans

ANCHOR_WORDS = 8
EDGE = "context long, digest long, m long, at int, edge long, tail long, head long"
KNOWN_WORDS = 1 << 17
_WORDS: dict[bytes, int] = {}  # hashes of frequent words in this worker


def sequence_of(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word."""
    words = data.split()
    known = _WORDS
    if len(known) > KNOWN_WORDS:
        known.clear()
    digest = xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w, 7)
        out.append(h)
    return np.array(out, "u8")


def edges_of(rows: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """An edge for each window of the fragments: its hash and those of its end nodes, and where it is."""

    def cut(data, wanted):
        symbols = sequence_of(data)
        for w in wanted:
            hashed = Hashed(symbols[w["first"] : w["first"] + w["n"] + window - 1], 1)
            edge, node = hashed.every(window).view("i8").tolist(), hashed.every(window - 1).view("i8").tolist()
            for at in range(w["n"]):
                yield w["context"], w["digest"], w["m"], at, edge[at], node[at], node[at + 1]

    return texts_of(rows, kinds, cut, EDGE)


def compact(edges: DataFrame) -> DataFrame:
    """(context, edge, end, steps): the last edge of each edge's chain and the edges on the way to it.

    ``edges``: distinct context, edge, tail and head. In each round an edge takes over the end of its present end, which
    doubles the steps. A chain that is longer than the steps so far has edges that arrive in the next round, so rounds
    stop when none arrives; what is left are circles, whose edges stay chains of their own.
    """
    one_out = edges.groupBy("context", F.col("tail").alias("node")).agg(F.count("*").alias("c"), F.min("edge").alias("next")).filter("c = 1")
    one_in = edges.groupBy("context", F.col("head").alias("node")).agg(F.count("*").alias("c")).filter("c = 1")
    through = one_out.join(one_in.select("context", "node"), ["context", "node"]).select("context", F.col("node").alias("head"), "next")
    state = edges.join(through, ["context", "head"], "left").select(
        "context", "edge", F.coalesce("next", "edge").alias("end"), F.when(F.isnull("next"), 0).otherwise(1).alias("steps"), F.isnull("next").alias("done")
    )
    state = settle(state, "chains")
    arrived = state.filter("done").count()
    total = state.count()
    while arrived < total:
        ahead = state.select("context", F.col("edge").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("more"), F.col("done").alias("done2"))
        state = settle(state.join(ahead, ["context", "end"]).select(
            "context", "edge", F.when(F.col("done"), F.col("end")).otherwise(F.col("end2")).alias("end"),
            (F.col("steps") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("steps"), (F.col("done") | F.col("done2")).alias("done"),
        ), "chains")
        before, arrived = arrived, state.filter("done").count()
        if arrived == before:
            break
    return state.select(
        "context", "edge", F.when(F.col("done"), F.col("end")).otherwise(F.col("edge")).alias("end"),
        F.when(F.col("done"), F.col("steps")).otherwise(0).alias("steps"),
    )


def graph_search(window: int):
    """The search of ``repeats`` by edges and chains."""

    def search(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        edges = settle(edges_of(rows, kinds, window), "edges")
        repeated = settle(
            edges.groupBy("context", "edge").agg(F.sum("m").alias("c"), F.min("tail").alias("tail"), F.min("head").alias("head")).filter("c > 1").drop("c"),
            "repeated_edges",
        )
        chains = compact(repeated)
        runs = edges.join(chains, ["context", "edge"]).groupBy("context", "digest", "end", (F.col("at") + F.col("steps")).alias("line")).agg(
            F.min("at").alias("a"), F.max("at").alias("b"), F.collect_list("at").alias("places")
        )
        confirmed = F.col("b") - F.col("a") + 1 == F.size("places")  # the source has every edge of the span
        spans = F.when(confirmed, F.array("a", F.col("b") + window)).otherwise(F.flatten(F.transform("places", lambda x: F.array(x, x + window))))
        return runs.select("context", "digest", spans.alias("spans")).groupBy("context", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    return search


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(data: bytes, bounds: np.ndarray) -> bytes:
    """``data`` without the runs of words (first, one past last) and the white space after each run."""
    if not len(bounds):
        return data
    places = [m.span() for m in WORD.finditer(data)]
    parts, at = [], 0
    for a, b in bounds.tolist():
        parts.append(data[at : places[a][0]])
        at = places[b][0] if b < len(places) else places[-1][1]
    return b"".join([*parts, data[at:]])


def remove_repeated_words(
    df: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, with_text: bool = False
) -> DataFrame:
    """``df`` with n_words, n_removed and kept_sha256; with ``with_text`` also kept_text, the text without them.

    A word goes if it lies in ``window`` consecutive words of its document that also start anywhere else, in the same
    document included; windows are judged on the input. Words stand between U+0020 and U+0009-U+000D. Null and empty
    texts have no words; shorter texts have no windows. In kept_text a removed run goes with the white space after it, all
    else stays as it was. Rows that repeat an id and text repeat each other's windows like
    any two rows. Columns of these names are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", "kept_sha256", "kept_text")]
    rows = keyed(df, doc_id, text, kept)
    spans = repeated_spans(rows, sequence_of, window, min(ANCHOR_WORDS, window), graph_search(window))

    def make():
        def compute(texts, spans):
            n_words, n_removed, sha, left = [], [], [], []
            for value, flat in zip(texts, spans, strict=True):
                data = value.as_py()
                words = data.split()
                bounds = merged(flat.as_py())
                parts, at = [], 0
                for a, b in bounds.tolist():
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                rest = b" ".join(parts)
                n_words.append(len(words))
                n_removed.append(len(words) - len(parts))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    left.append(without_words(data, bounds).decode("utf-8", "replace"))
            return [n_words, n_removed, sha, *([left] if with_text else [])]

        return compute

    return with_spans(rows, spans, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, make, kept)
