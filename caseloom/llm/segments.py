"""Rows of a key gathered in order into segments of bounded size.

The table is dealt out by ranges of key and order, not by key alone, so that a key with a third of all rows lies in many
partitions. A key whose rows lie inside one partition and fit one segment is ``whole``; the segments of the others are
put in order by (part, seq).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.base import arrow_type

SEGMENT_ROWS = 1024
SEGMENT_BYTES = 128 << 10


def packed(
    df: DataFrame, key: Column, order: list[Column], values: dict[str, Column], size: str | None = None,
    most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(key, part, seq, whole, and each value as an array). ``size`` names the value that holds a row's bytes.

    Rows go by ``order``, nulls first; null keys are one key. A segment holds at most ``most_rows`` rows and, beyond its
    first row, ``most_bytes`` bytes.
    """
    sort = [F.col("key").asc_nulls_first()] + [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))]
    rows = df.select(key.alias("key"), *[o.alias(f"o{i}") for i, o in enumerate(order)], *[v.alias(n) for n, v in values.items()])
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("key", *values)
    kinds = [f.dataType for f in rows.schema.fields]
    out = T.StructType(
        [T.StructField("key", kinds[0]), *T.StructType.fromDDL("part int, seq int, whole boolean").fields]
        + [T.StructField(n, T.ArrayType(k)) for n, k in zip(values, kinds[1:], strict=True)]
    )
    sized = list(values).index(size) + 1 if size else None
    types = [arrow_type(f.dataType) for f in out.fields]

    def pieces_of(columns, at_end):
        """Bounds (from, to, cut) of segments; without ``at_end`` what may go on stays behind."""
        keys = columns[0]
        n = len(keys)
        same = pc.coalesce(pc.equal(keys[1:], keys[:-1]), pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])))
        starts = np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1])
        ends = np.append(starts[1:], n)
        weight = np.cumsum(pc.fill_null(columns[sized], 0).to_numpy(zero_copy_only=False)) if sized else np.zeros(n)
        found = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            before = weight[a - 1] if a else 0
            while b - a > most_rows or weight[b - 1] - before > most_bytes and b - a > 1:
                stop = min(a + most_rows, max(int(np.searchsorted(weight, before + most_bytes, "right")), a + 1), b)
                if stop == b:
                    break
                found.append((a, stop, True))
                a, before = stop, weight[stop - 1]
            if b < n or at_end:
                found.append((a, b, False))
        return found

    def run(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, None
        opened = True  # the first key of a partition may have begun in another one

        def emit(columns, found, at_end):
            nonlocal seq, opened
            if not found:
                return None
            whole = []
            for _, _, cut in found:
                whole.append(not opened and not cut and not at_end)
                opened = cut
            bounds = np.array([f[0] for f in found] + [found[-1][1]], "i4")
            arrays = [columns[0].take(pa.array(bounds[:-1])), pa.array([part] * len(found), pa.int32())]
            arrays += [pa.array(range(seq, seq + len(found)), pa.int32()), pa.array(whole)]
            seq += len(found)
            flat = [c.slice(0, int(bounds[-1])) for c in columns[1:]]
            offsets = pa.array(bounds, pa.int32())
            arrays += [pa.ListArray.from_arrays(offsets, c) for c in flat]
            return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types, strict=True)], names=out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns)
            if held is not None:
                columns = [pa.concat_arrays([h, c]) for h, c in zip(held, columns, strict=True)]
            found = pieces_of(columns, False)
            made = emit(columns, found, False)
            if made is not None:
                yield made
            rest = found[-1][1] if found else 0
            held = [c.slice(rest) for c in columns]
        if held is not None and len(held[0]):
            found = pieces_of(held, True)
            if len(found) > 1:
                yield emit(held, found[:-1], False)
                held = [c.slice(found[-1][0]) for c in held]
            yield emit(held, [(0, len(held[0]), False)], True)

    return rows.mapInArrow(run, out)


def streamed_sha256(pieces: DataFrame, keys: list[str], order: list[str], piece: str) -> DataFrame:
    """(keys, sha256) over the pieces (binary) of each key in order; a task holds one piece at a time, a null adds nothing."""
    rows = pieces.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, piece)
    out = T.StructType([*rows.schema.fields[: len(keys)], T.StructField("sha256", T.StringType())])
    types = [arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        here, digest = None, None

        def done():
            arrays = [pa.array([v], t) for v, t in zip([*here, digest.hexdigest()], types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=out.names)

        for batch in batches:
            for i in range(batch.num_rows):
                name = tuple(c[i].as_py() for c in batch.columns[:-1])
                if name != here:
                    if here is not None:
                        yield done()
                    here, digest = name, hashlib.sha256()
                digest.update(batch.column(len(keys))[i].as_py() or b"")
        if here is not None:
            yield done()

    return rows.mapInArrow(run, out)
