"""The last event strictly before a date, without looking ahead.

Both tables are put in one order by key and time, and each row of the first takes the last event seen so far: one shuffle
and a sort, no range join. Where a key has more rows than a task should hold, its time is cut at quantiles into buckets; the
last event and the number of events of the buckets before are carried into each, so no task gets a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.lookup import lookup

SPLIT_ROWS = 1_000_000  # of a key in one bucket, about
BUCKETS = 256  # of a key


def events_before(
    rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, take: list[str], tie: str,
    strict: bool = True, split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """``rows`` with the columns ``take`` of the last event of the same ``key`` before ``time``, and ``n_before``, their number.

    With ``strict`` an event at the same time is not before it. Of events at one time the greatest ``tie`` is last. Events
    without key or time are no events; rows without key or time have none before them. Times are compared as timestamps.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    given = rows.select(
        F.col(key).alias("_key"), at(time).alias("_at"), F.lit(0 if strict else 2).alias("_side"),
        F.struct(*rows.columns).alias("_row"), F.lit(None).cast(events.schema[tie].dataType).alias("_tie"),
        F.lit(None).cast(events.select(F.struct(*take).alias("s")).schema["s"].dataType).alias("_event"),
    )
    seen = events.filter(F.col(key).isNotNull() & F.col(event_time).isNotNull()).select(
        F.col(key).alias("_key"), at(event_time).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(given.schema["_row"].dataType).alias("_row"), F.col(tie).alias("_tie"), F.struct(*take).alias("_event"),
    )
    timed = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    both = given.filter(timed).unionByName(seen)
    hot = both.groupBy("_key").count().filter(F.col("count") > split_rows)
    bounds = _bounds(both, hot, split_rows)
    split = not bounds.limit(1).isEmpty()
    if split:
        both = lookup(both, bounds, ["_key"]).withColumn("_bucket", F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<bigint>")), lambda b: b <= F.col("_at"))))
    else:
        both = both.withColumn("_bucket", F.lit(0))
    so_far = Window.partitionBy("_key", "_bucket").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("_last", F.last("_event", True).over(so_far)).withColumn("_n", F.count("_event").over(so_far)).filter("_row is not null")
    if split:
        last = lookup(last, _carried(both), ["_key", "_bucket"])
        last = last.withColumn("_last", F.coalesce("_last", "_before")).withColumn("_n", F.col("_n") + F.coalesce("_n_before", F.lit(0)))
    none = given.filter(~timed | F.col("_key").isNull() | F.col("_at").isNull()).select("_row", F.col("_event").alias("_last"), F.lit(0).cast("long").alias("_n"))
    every = last.select("_row", "_last", "_n").unionByName(none)
    taken = [F.col(f"_last.{c}").alias(c) for c in take]
    return every.select("_row.*", *taken, F.col("_n").alias("n_before"))


def _bounds(both: DataFrame, hot: DataFrame, split_rows: int) -> DataFrame:
    """(_key, _bounds): where the time of each hot key is cut; as many parts as it has ``split_rows`` rows, at most ``BUCKETS``."""
    parts = hot.select("_key", F.least(F.ceil(F.col("count") / split_rows), F.lit(BUCKETS)).cast("int").alias("_parts"))
    mine = lookup(both.select("_key", "_at"), parts, ["_key"], "inner")
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = mine.groupBy("_key").agg(F.max("_parts").alias("_parts"), F.percentile_approx("_at", shares, 100 * BUCKETS).alias("_all"))
    step = F.lit(BUCKETS) / F.col("_parts")
    chosen = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_all", F.round(i * step).cast("int")))
    return cuts.select("_key", F.array_distinct(chosen).alias("_bounds"))


def _carried(both: DataFrame) -> DataFrame:
    """(_key, _bucket, _before, _n_before) over the events of the buckets before."""
    events = both.filter("_event is not null")
    ends = events.groupBy("_key", "_bucket").agg(F.max_by("_event", F.struct("_at", "_tie")).alias("_end"), F.count("*").alias("_n"))
    # buckets without events are there too, so that rows in them find what was before
    every = both.select("_key", "_bucket").distinct().join(ends, ["_key", "_bucket"], "left")
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("_key", "_bucket", F.last("_end", True).over(before).alias("_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"))
