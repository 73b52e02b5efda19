"""Reading, settling and mapping of tables for the corpus operators.

Texts travel as UTF-8 bytes. ``bytes.split()`` splits at exactly U+0020 and U+0009-U+000D and ``bytes.lower()``
changes exactly A-Z, which is how the operators here define words and lower case.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.session import work_path

ROWS_AT_ONCE = 256  # rows whose texts a Python worker holds as objects at a time
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Arrow batches are kept short, as single texts may be very long."""
    if int(spark.conf.get(BATCH_ROWS)) > 1000:
        spark.conf.set(BATCH_ROWS, "1000")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go when the write ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    path = work_path(spark, name)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(name: str) -> Column:
    return column(name).cast("binary")


def numbered(names: list[str]) -> list[Column]:
    """The named columns as k0, k1, ..., so that working columns can't clash with them; ``named`` undoes that."""
    return [column(c).alias(f"k{i}") for i, c in enumerate(names)]


def named(names: list[str]) -> list[Column]:
    return [F.col(f"k{i}").alias(c) for i, c in enumerate(names)]


def fields_of(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def arrow_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def add_columns(
    df: DataFrame, inputs: list[Column], ddl: str, make: Callable[[], Callable], keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the columns of ``ddl``, computed in Arrow batches.

    ``make()`` is called once per task and gives a function from the Arrow arrays of ``inputs`` to one sequence per
    new column; its attribute ``release``, if there is one, is called at the end of the task. A column of ``df`` that has the
    name of a new one is replaced. ``keep`` limits what else is passed on.
    """
    new = fields_of(ddl)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*map(column, kept), *inputs)
    types = [arrow_type(f.dataType) for f in new]
    out = T.StructType(source.schema.fields[: len(kept)] + new)
    source = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # inputs may have the names of kept columns
    n_kept = len(kept)

    def run(batches):
        compute = make()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                made = compute(*batch.columns[n_kept:])
                arrays = [pa.array(values, type=kind) for values, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:n_kept] + arrays, names=out.names)
        if hasattr(compute, "release"):
            compute.release()

    return source.mapInArrow(run, out)
