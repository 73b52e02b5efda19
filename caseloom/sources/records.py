"""Records of CSV files whose fields hold line breaks, read in many tasks a file.

Spark deals files out in byte blocks, and its text reader gives each block the lines that begin in it. Whether a line
begins inside a quoted field depends on all quotes before it, but only on whether their number is odd; a doubled quote
counts twice and changes nothing. So one pass counts the quotes of each block, a running sum over a file's blocks tells
which begin inside a field, and a second pass puts lines together to records. Only the records that go on beyond a block,
at most one a block, are put together across tasks.

As in RFC 4180, quotes stand only in quoted fields.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import settle

WHOLE, OPEN, END, MIDDLE = 0, 1, 2, 3  # a record; its beginning, its end, and a block that it fills
PIECE = "file long, block long, kind int, record string"


@dataclass
class Records:
    """Distinct headers with a file of each, and (header, record): the number of its file's header and the text of each record."""

    headers: list[tuple[tuple[str, ...], str]]
    records: DataFrame


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(place.alias("path"), F.xxhash64(place).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _segments(batch: pa.RecordBatch):
    """(file, block, first row, one past the last) of the runs of rows of one block."""
    file, block = (batch.column(i).to_numpy() for i in (0, 1))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield int(file[a]), int(block[a]), a, b


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)


def _counted(lines: DataFrame) -> DataFrame:
    """(path, file, block, quotes, head): a row for each run of lines of a block; head is a file's first line."""

    def run(batches):
        here = None
        for batch in batches:
            rows = []
            for file, block, a, b in _segments(batch):
                head = batch.column(2)[a].as_py() if block == 0 and (file, block) != here else None
                here = (file, block)
                rows.append((batch.column(3)[a].as_py(), file, block, int(_quotes(batch.column(2).slice(a, b - a)).sum()), head))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "file", "block", "quotes", "head"])

    counted = lines.select("file", "block", "value", "path").mapInArrow(run, "path string, file long, block long, quotes long, head string")
    return counted.groupBy("path", "file", "block").agg(F.sum("quotes").alias("quotes"), F.max("head").alias("head"))


class _Block:
    """Lines of a block put together to pieces."""

    def __init__(self, file: int, block: int, inside: bool):
        self.file, self.block, self.inside, self.began_inside = file, block, inside, inside
        self.held = pa.array([], pa.string())
        self.first, self.ended = True, False

    def add(self, lines: pa.Array):
        lines = pa.concat_arrays([self.held, lines])
        after = (np.cumsum(_quotes(lines)) + self.inside) % 2
        ends = np.flatnonzero(after == 0) + 1
        stop = int(ends[-1]) if len(ends) else 0
        self.held = lines.slice(stop)
        if not len(ends):
            return
        offsets = pa.array(np.append(0, ends).astype("i4"))
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(0, stop)), "\n")
        kinds = np.zeros(len(texts), "i4")
        if self.began_inside and not self.ended:
            kinds[0] = END
        drop = self.block == 0 and self.first  # the header
        self.inside, self.first, self.ended = False, False, True
        yield self.batch(texts.slice(int(drop)), kinds[int(drop):])

    def rest(self):
        if len(self.held):
            kind = MIDDLE if self.inside else OPEN
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(self.held)], pa.int32()), self.held), "\n")
            yield self.batch(texts, np.array([kind], "i4"))

    def batch(self, texts: pa.Array, kinds: np.ndarray) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict({
            "file": pa.array(np.full(n, self.file)), "block": pa.array(np.full(n, self.block)), "kind": pa.array(kinds), "record": texts.cast(pa.string()),
        })


def _pieces(lines: DataFrame, inside: set[tuple[int, int]]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches):
        now = None
        for batch in batches:
            for file, block, a, b in _segments(batch):
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        yield from now.rest()
                    now = _Block(file, block, (file, block) in shared.value)
                yield from now.add(batch.column(2).slice(a, b - a))
        if now is not None:
            yield from now.rest()

    return lines.select("file", "block", "value").mapInArrow(run, PIECE)


def csv_records(spark: SparkSession, path: str) -> Records:
    """The records of a file, folder or glob, without headers and empty lines. Line breaks in fields stay as they are.

    What reaches the driver, and is broadcast, are distinct headers, two numbers for each block that begins inside a
    field, and, where headers differ, two for each file: 13 MB for a hundred terabytes in usual blocks.
    """
    lines = _lines(spark, path)
    blocks = settle(_counted(lines), "csv_blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = blocks.withColumn("before", F.sum("quotes").over(before)).filter("before % 2 = 1").select("file", "block")
    inside = {(r["file"], r["block"]) for r in odd.collect()}
    heads = blocks.filter("block = 0").withColumn("head", F.regexp_replace("head", "^﻿|\r$", ""))
    firsts = heads.groupBy("head").agg(F.min("path").alias("path")).orderBy("path").collect()
    # written once, records and parts of records apart
    pieces = settle(_pieces(lines, inside).withColumn("is_cut", F.col("kind") != WHOLE), "csv_records", ["is_cut"])
    whole = pieces.filter("not is_cut").select("file", "record")
    in_order = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    cut = pieces.filter("is_cut").withColumn("n", F.sum((F.col("kind") == OPEN).cast("int")).over(in_order))
    parts = F.sort_array(F.collect_list(F.struct("block", (-F.col("kind")).alias("k"), "record")))
    joined = cut.groupBy("file", "n").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")).select("file", "record")
    both = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")
    if len(firsts) > 1:
        numbers = spark.createDataFrame([(r["head"], i) for i, r in enumerate(firsts)], "head string, header int")
        of = {r["file"]: r["header"] for r in heads.join(numbers, "head").select("file", "header").collect()}
        named = spark.createDataFrame(list(of.items()), "file long, header int")
        both = both.join(F.broadcast(named), "file").select("header", "record")
    else:
        both = both.select(F.lit(0).alias("header"), "record")
    return Records([(tuple(next(csv.reader([r["head"]]))), r["path"]) for r in firsts if r["head"]], both)
