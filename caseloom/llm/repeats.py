"""Where long windows of a table's texts occur more than once: the part that both substring operators share.

1. Texts become fragments (see ``fragments``). 2. Contexts are counted; those seen once go. 3. Fragments whose context
always comes with the same text are repeated as a whole. 4. The others, one row for each different text, go to the
operator's own search with their text, read by its source coordinates. 5. Spans are gathered by document.

Counts are aggregated before they are shuffled, and joins by context or document can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import add_columns, arrow_type, as_bytes, column, fields_of, named, numbered, settle
from caseloom.llm.fragments import batches_of, fragments

KEYS = ["_doc", "_txt"]  # a row is named by hashes of its id and of its text


def keyed(df: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """The kept columns by number, the text's bytes and the row's key. Rows that repeat id and text share a key and a result."""
    return df.select(
        *numbered(keep), F.coalesce(as_bytes(text), F.lit(b"")).alias("_bytes"),
        F.xxhash64(column(doc_id)).alias("_doc"), F.xxhash64(column(text)).alias("_txt"),
    )


class Emitter:
    """Makes Arrow batches with the columns of a schema text; made on the driver, used in tasks."""

    def __init__(self, ddl: str):
        self.names = [f.name for f in fields_of(ddl)]
        self.types = [arrow_type(f.dataType) for f in fields_of(ddl)]

    def __call__(self, columns: list) -> pa.RecordBatch:
        columns = columns or [[]] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, self.types, strict=True)], names=self.names)


FRAGMENT = "_doc long, _txt long, first int, n short, context long, digest long"


def fragment_table(rows: DataFrame, sequence_of: Callable[[bytes], np.ndarray], length: int, k: int) -> DataFrame:
    emit = Emitter(FRAGMENT)

    def run(batches):
        for batch in batches:
            texts, docs, txts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for symbols, owner, place in batches_of((sequence_of(t.as_py()) for t in texts), length):
                f = fragments(symbols, owner, place, length, k)
                if len(f.owner):
                    yield emit([docs[f.owner], txts[f.owner], f.first.astype("i4"), f.n.astype("i2"), f.context, f.text])

    return rows.select("_bytes", *KEYS).mapInArrow(run, FRAGMENT)


def texts_of(rows: DataFrame, kinds: DataFrame, cut: Callable, ddl: str) -> DataFrame:
    """Rows made by ``cut(bytes, fragments)`` for the fragments of ``kinds``, each read at its source coordinates.

    ``kinds`` has context, digest, m and source (key, first, n). ``cut`` yields tuples of the columns of ``ddl``.
    """
    wanted = kinds.select("source.*", "context", "digest", "m").groupBy(*KEYS).agg(
        F.collect_list(F.struct("first", "n", "context", "digest", "m")).alias("_wanted")
    )
    # rows that repeat id and text share a key: one of them is read
    joined = rows.select("_bytes", *KEYS).join(wanted, KEYS).dropDuplicates(KEYS).select("_bytes", "_wanted")
    emit = Emitter(ddl)

    def run(batches):
        for batch in batches:
            for data, wanted in zip(*batch.columns, strict=True):
                yield emit([*zip(*cut(data.as_py(), wanted.as_py()), strict=True)])

    return joined.mapInArrow(run, ddl)


def repeated_spans(rows: DataFrame, sequence_of, length: int, k: int, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(key, spans): for each row with repeated windows, first and one-past-last symbol of spans, in any order.

    ``search(rows, kinds)`` returns (context, digest, spans) with the spans inside each of the given fragments whose
    windows occur elsewhere; ``kinds`` are the different texts of contexts that come with several.
    """
    table = settle(fragment_table(rows, sequence_of, length, k), "fragments")
    contexts = table.groupBy("context").agg(F.count("*").alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    # Written first, so that the join below gets its rows from an exchange that can be split where a context is frequent.
    contexts = settle(contexts.filter("c > 1").select("context", (F.col("lo") == F.col("hi")).alias("same")), "contexts")
    seen = settle(table.join(contexts, "context"), "repeated")
    several = seen.filter("NOT same")
    kinds = settle(several.groupBy("context", "digest").agg(
        F.count("*").alias("m"), F.min(F.struct(*KEYS, "first", "n")).alias("source")
    ), "kinds")
    found = settle(search(rows, kinds), "found").filter(F.size("spans") > 0)
    whole = seen.filter("same").select(*KEYS, F.array("first", F.col("first") + F.col("n") + (length - 1)).alias("spans"))
    part = several.join(found, ["context", "digest"]).select(*KEYS, F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
    return whole.unionByName(part).groupBy(*KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame, ddl: str, make, keep: list[str]) -> DataFrame:
    """The kept columns, by name, with columns computed from bytes and spans (an array of bounds; null for none)."""
    joined = rows.join(spans, KEYS, "left")
    out = add_columns(joined, [F.col("_bytes"), F.col("spans")], ddl, make, [f"k{i}" for i in range(len(keep))])
    return out.select(*named(keep), *[f.name for f in fields_of(ddl)])


def merged(flat) -> np.ndarray:
    """Bounds (a row each) of the union of spans given as first, stop, first, stop, ..."""
    if flat is None or not len(flat):
        return np.zeros((0, 2), "i8")
    pairs = np.unique(np.asarray(flat, "i8").reshape(-1, 2), axis=0)
    stop = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > stop[:-1])
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], stop[np.append(at[1:], len(pairs)) - 1]], axis=1)
