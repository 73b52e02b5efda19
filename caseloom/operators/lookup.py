"""Joining a large table with a lookup table whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.config import BROADCAST_BYTES, BROADCAST_ROWS
from caseloom.session import settle

SALTS = 32


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``small`` has at most ``max_rows`` rows and ``max_bytes`` bytes of text; reads no more than one row beyond."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in small.schema.fields), F.lit(8))
    found = small.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return found["n"] <= max_rows and found["b"] <= max_bytes


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` with ``small``, whose ``on`` values are unique.

    The lookup table is written once, so its plan runs once. Within ``max_rows`` rows and ``BROADCAST_BYTES`` bytes it is
    broadcast and ``big`` is not shuffled.
    Beyond it both sides are shuffled on the key plus a salt, with the lookup rows
    repeated once per salt, so a key holding a third of ``big`` is spread over
    ``SALTS`` tasks. Both ways give the same rows.
    """
    small = settle(small, "lookup")
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The partition number keeps identical rows of different tasks apart.
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in _plain(big)]) + F.spark_partition_id()
    spread = big.withColumn("_salt", F.pmod(row_hash, F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in _HASHED]


_HASHED = {"string", "long", "integer", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz", "short", "byte"}
