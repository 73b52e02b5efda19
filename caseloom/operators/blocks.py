"""Rows of a sparse feature column packed in blocks, for solvers that pass over all rows many times.

A block is one row of a table: some hundred rows of the input with their entries by row and by feature, as binary columns.
Blocks are kept in files that tasks map to memory, so a pass does not send them from Spark to Python again. A pass maps each
block to a vector of sums; sums are added by pieces of the vector in a shuffle, so the driver gets one vector, as large as
the model, however many tasks there are.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import plain_folder, work_path

BLOCK_ENTRIES = 250_000  # of a block, and one row more
TASK_ENTRIES = 500_000  # that a task should have at least
WAVES = 4  # tasks for each core, at most
COMMON = 0.05  # of a block's rows: a feature in so many is a column of a plain matrix
CACHED = 8_192  # entries that are multiplied at a time, so that products stay in a core's cache
PIECE = 65_536  # numbers of a sum that are added in one task
DIRECT = 2  # partial sums that the driver adds itself

ENTRIES = "n int, starts binary, idx binary, val binary, col_starts binary, col_idx binary, col_rows binary, col_val binary"


class Block:
    """Entries by row (starts, idx, val), by feature (col_*), and the other columns by name."""

    def __init__(self, names: list[str], values: list):
        self.n = values[0]
        for name, value in zip(names[1:], values[1:], strict=True):
            kind = "i8" if name in ("starts", "col_starts") else "i4" if name in ("idx", "col_idx", "col_rows") else "f8"
            setattr(self, name, np.frombuffer(value, kind))

    def _split(self) -> None:
        """Entries of features in many rows as a matrix [row, feature], the others by feature, with the place of theirs among the rare."""
        if hasattr(self, "dense"):
            return
        counts = np.diff(np.append(self.col_starts, len(self.col_rows)))
        common = counts >= max(self.n * COMMON, 2)
        few = int(common.sum())
        if common[:few].all():  # as packed
            cut = int(counts[:few].sum())
            inside, outside = slice(0, cut), slice(cut, None)
        else:
            inside = np.repeat(common, counts)
            outside = ~inside
        self.common, self.rare = self.col_idx[common], self.col_idx[~common]
        matrix = np.zeros(few * self.n)
        np.add.at(matrix, np.repeat(np.arange(few) * self.n, counts[common]) + self.col_rows[inside], self.col_val[inside])
        self.dense = matrix.reshape(few, self.n).T
        self.rare_rows = self.col_rows[outside].astype("i8")
        self.rare_place = np.repeat(np.arange(len(self.rare)), counts[~common])
        self.rare_twice = np.repeat(self.col_val[outside], 2)  # for both numbers of a pair

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows times a matrix [feature, column]."""
        self._split()
        return self.dense @ w[self.common] + self._added_up(w[self.rare], self.rare_place, self.rare_rows, self.n)

    def transposed_times(self, r: np.ndarray, width: int) -> np.ndarray:
        """[feature, column] from a matrix [row, column]."""
        self._split()
        out = np.zeros((width, r.shape[1]))
        out[self.common] = self.dense.T @ r
        out[self.rare] = self._added_up(r, self.rare_rows, self.rare_place, len(self.rare))
        return out

    def _added_up(self, given: np.ndarray, source: np.ndarray, target: np.ndarray, size: int) -> np.ndarray:
        """[target, column]: rows ``source`` of ``given`` times the rare values, added at ``target``.

        Two columns are the parts of a complex number, which takes as long to fetch and to add as one of them.
        """
        k = given.shape[1]
        pairs = np.zeros((-(-k // 2), len(given), 2))
        for c in range(k):
            pairs[c // 2, :, c % 2] = given[:, c]
        pairs, out = pairs.view("c16")[:, :, 0], np.zeros((len(pairs), size), "c16")
        for a in range(0, len(source), CACHED):
            part = slice(a, a + CACHED)
            from_, to, twice = source[part], target[part], self.rare_twice[2 * a : 2 * (a + CACHED)]
            for p in range(len(pairs)):
                products = pairs[p].take(from_)
                numbers = products.view("f8")
                numbers *= twice
                np.add.at(out[p], to, products)
        return out.view("f8").reshape(len(pairs), size, 2).transpose(1, 0, 2).reshape(size, 2 * len(pairs))[:, :k]


def entries_of(features: str = "features") -> list[Column]:
    """Indices and values of a vector column, sparse or dense."""
    raw = F.unwrap_udt(features)
    indices = F.coalesce(raw["indices"], F.when(F.size(raw["values"]) > 0, F.sequence(F.lit(0), F.size(raw["values"]) - 1)), F.array().cast("array<int>"))
    return [indices.alias("idx"), raw["values"].alias("val")]


def width_of(df: DataFrame, features: str = "features") -> int:
    raw = F.unwrap_udt(features)
    row = df.select(F.coalesce(raw["size"], F.size(raw["values"])).alias("d")).first()
    if row is None:
        raise ValueError("a model needs rows to be trained on")
    return row["d"]


class Kept:
    """Arrow batches that passes read again until ``release``: ``run`` makes them of those of ``source``.

    Where the shared folder is a plain one, each task writes a file, which tasks map to memory. Otherwise they are a persisted table.
    """

    def __init__(self, source: DataFrame | Kept, run: Callable, ddl: str, name: str):
        self.ddl, spark = ddl, source.sparkSession
        self.sparkSession = spark
        self.folder = folder = plain_folder(spark, work_path(spark, name))
        if folder is None:
            self.table = (source.map if isinstance(source, Kept) else source.mapInArrow)(run, ddl).persist()
            self.table.count()
            return

        def file_of(batches) -> str | None:
            path, sink = f"{folder}/{uuid.uuid4().hex}.arrow", None
            for batch in batches:
                if sink is None:
                    os.makedirs(folder, exist_ok=True)
                    sink = pa.ipc.new_file(path, batch.schema)
                sink.write_batch(batch)
            if sink is None:
                return None
            sink.close()
            return path

        given = source.paths if isinstance(source, Kept) else None

        def written(batches):
            if given is None:
                made = [(0, file_of(run(batches)))]
            else:
                made = [(k, file_of(run(mapped(given[k])))) for batch in batches for k in batch.column(0).to_pylist()]
            for place, path in made:
                if path is not None:
                    yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "path": [path]})

        rows = (source.table if given is not None else source).mapInArrow(written, "place long, path string").collect()
        self.paths = [r["path"] for r in sorted(rows, key=lambda r: r["place"])]  # one for each task, or for each file of ``source``
        self.table = spark.range(0, len(self.paths), 1, max(len(self.paths), 1))

    def map(self, run: Callable, ddl: str) -> DataFrame:
        """``run`` of the batches of each task."""
        if self.folder is None:
            return self.table.mapInArrow(run, ddl)
        paths = self.paths
        return self.table.mapInArrow(lambda batches: run(x for batch in batches for k in batch.column(0).to_pylist() for x in mapped(paths[k])), ddl)

    def release(self) -> None:
        if self.folder is None:
            self.table.unpersist()
        else:
            shutil.rmtree(self.folder, ignore_errors=True)


def mapped(path: str) -> Iterator[pa.RecordBatch]:
    """Batches of a file of ``Kept``."""
    with pa.memory_map(path) as source:
        file = pa.ipc.open_file(source)
        for n in range(file.num_record_batches):
            yield file.get_batch(n)


class Blocks:
    """The packed table, kept until ``release``."""

    def __init__(self, df: DataFrame, columns: dict[str, Column], features: str = "features"):
        self.width = width_of(df, features)
        self.columns = list(columns)
        rows = df.select(*entries_of(features), *[c.cast("double").alias(n) for n, c in columns.items()])
        self.n_rows, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
        wanted = max(1, -(-entries // TASK_ENTRIES))
        have = rows.rdd.getNumPartitions()
        cores = df.sparkSession.sparkContext.defaultParallelism
        self.parts = min(wanted, max(min(have, WAVES * cores), cores))  # each sends a sum as large as the model
        rows = rows.coalesce(self.parts) if self.parts <= have else rows.repartition(self.parts)
        self.names = [f.split()[0] for f in ENTRIES.split(", ")] + self.columns
        self.kept = Kept(rows, _packer(self.columns), ENTRIES + "".join(f", {c} binary" for c in self.columns), "blocks")

    @property
    def df(self) -> DataFrame:
        """The blocks as a table."""
        return self.kept.map(lambda batches: batches, self.kept.ddl)

    def release(self) -> None:
        self.kept.release()

    def add_up(self, of_block: Callable[[Block, object], np.ndarray], state: object, length: int) -> np.ndarray:
        """The sum of ``of_block(block, state)``, vectors of ``length`` numbers, over all blocks."""
        names = self.names
        return add_up(self.kept, self.parts, lambda values: Block(names, values), of_block, state, length)


def in_place(batches) -> Iterator[list]:
    """Values of each row, a number and buffers: a batch may hold all blocks of a task, which are not copied."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [batch.column(0)[k].as_py(), *[c[k].as_buffer() for c in batch.columns[1:]]]


def add_up(kept: Kept, parts: int, as_block: Callable, of_block: Callable, state: object, length: int) -> np.ndarray:
    """The sum of ``of_block(as_block(row), state)``, vectors of ``length`` numbers, over the rows that ``parts`` tasks keep."""
    size = PIECE
    shared = kept.sparkSession.sparkContext.broadcast(state)

    def partial(batches):
        total = np.zeros(length)
        for values in in_place(batches):
            total += of_block(as_block(values), shared.value)
        yield _pieces(total, size)

    def added(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(values)
                totals[piece] = totals[piece] + part if piece in totals else part
        if totals:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(totals, pa.int32()), "total": [v.tobytes() for v in totals.values()]})

    sums = kept.map(partial, "piece int, total binary")
    if parts > DIRECT:
        sums = sums.repartition(min(parts, -(-length // size)), "piece").mapInArrow(added, "piece int, total binary")
    out = np.zeros(length)
    for row in sums.collect():
        out[row["piece"] * size : (row["piece"] + 1) * size] += np.frombuffer(row["total"])
    shared.destroy()
    return out


def _pieces(total: np.ndarray, size: int) -> pa.RecordBatch:
    parts = [total[k : k + size].tobytes() for k in range(0, len(total), size)]
    return pa.RecordBatch.from_pydict({"piece": pa.array(range(len(parts)), pa.int32()), "total": parts})


def _packer(columns: list[str]):
    def packed(lengths, idx, val, others):
        starts = np.cumsum(lengths) - lengths
        rows = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)
        there = val != 0
        if not there.all():
            lengths = np.bincount(rows[there], minlength=len(lengths))
            idx, val, rows, starts = idx[there], val[there], rows[there], np.cumsum(lengths) - lengths
        sizes = np.bincount(idx) if len(idx) else np.zeros(0, "i8")
        rare = sizes < max(len(lengths) * COMMON, 2)
        order = np.argsort(idx + rare[idx] * np.int64(len(rare)), kind="stable")  # features in many rows come first
        by = idx[order]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, "i8")
        arrays = [starts.astype("i8"), idx, val, first.astype("i8"), by[first], rows[order], val[order], *others]
        return pa.RecordBatch.from_pydict({
            "n": pa.array([len(lengths)], pa.int32()),
            **{name: [a.tobytes()] for name, a in zip(["starts", "idx", "val", "col_starts", "col_idx", "col_rows", "col_val", *columns], arrays, strict=True)},
        })

    def run(batches):
        held, size = [], 0
        for whole in batches:
            at = 0
            lengths = pa.compute.list_value_length(whole.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
            ends = np.cumsum(lengths)
            while at < whole.num_rows:
                before = ends[at - 1] if at else 0
                stop = min(int(np.searchsorted(ends, before + BLOCK_ENTRIES - size, "left")) + 1, whole.num_rows)
                part = whole.slice(at, stop - at)
                idx, val = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
                held.append((lengths[at:stop], idx.astype("i4"), val.astype("f8"), [c.to_numpy(zero_copy_only=False).astype("f8") for c in part.columns[2:]]))
                size += len(idx)
                at = stop
                if size >= BLOCK_ENTRIES:
                    yield packed(*joined(held))
                    held, size = [], 0
        if held:
            yield packed(*joined(held))

    def joined(held):
        others = [np.concatenate([h[3][k] for h in held]) for k in range(len(columns))]
        return *(np.concatenate([h[k] for h in held]) for k in range(3)), others

    return run
