"""Row filters and exact-text deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions.text import strip, text_identity
from caseloom.operators.lookup import fits_broadcast
from caseloom.session import settle


def keep_usable(df: DataFrame, text: str = config.TEXT, tags: str = config.TAGS, min_chars: int = config.MIN_TEXT_CHARS) -> DataFrame:
    """Rows with a text of at least ``min_chars`` after stripping and with tags."""
    return df.filter(F.col(text).isNotNull() & (F.length(strip(text)) >= min_chars) & F.col(tags).isNotNull())


def keep_first_text(df: DataFrame, text: str = config.TEXT, key: str = config.KEY) -> DataFrame:
    """One row per exact text: the one with the smallest key.

    ``dropDuplicates`` would keep any row. The window is limited to rank 1, so Spark
    drops repeats before the shuffle: a text filling a third of the table sends one row
    per map task. Sorting starts with the 8-byte hash, texts are compared only on ties.
    """
    w = Window.partitionBy(F.xxhash64(text), text).orderBy(key)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def keep_first_texts(df: DataFrame, text: str = config.TEXT, key: str = config.KEY) -> DataFrame:
    """The rows of ``keep_first_text``, without a shuffle or sort of texts.

    Identities and keys are counted; texts found more than once, with their smallest key, are broadcast if a count of
    rows and bytes allows it, and a row stays if its text is not among them or its key is the smallest. Only rows that
    share text and smallest key with another one are ranked. ``df`` is read twice.
    """
    per_key = df.filter(F.col(text).isNotNull()).groupBy(text_identity(text).alias("_id"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct(F.col("_key").isNotNull(), "_key", "_n"))  # a missing key comes first
    repeated = per_key.groupBy("_id").agg(F.sum("_n").alias("_all"), first.alias("_first")).filter("_all > 1")
    repeated = settle(repeated.select("_id.*", F.col("_first._key").alias("_key"), F.col("_first._n").alias("_n")), "repeated")
    if not fits_broadcast(repeated):
        return keep_first_text(df, text, key)
    identity = text_identity(text)
    found = df.select("*", identity["h"].alias("h"), identity["m"].alias("m")).join(F.broadcast(repeated), ["h", "m"], "left")
    stays = F.col("_n").isNull() | F.col("_key").eqNullSafe(F.col(key))
    if repeated.filter("_n > 1").isEmpty() and not _holds_null(df, text):
        return found.filter(stays).select(*df.columns)
    alone = found.filter(stays & (F.coalesce("_n", F.lit(1)) == 1) & F.col(text).isNotNull()).select(*df.columns)
    ties = found.filter(stays & (F.col("_n") > 1) | F.col(text).isNull()).select(*df.columns)
    return alone.unionByName(keep_first_text(ties, text, key))


def _holds_null(df: DataFrame, text: str) -> bool:
    return not df.filter(F.col(text).isNull()).isEmpty()


def clean_reports(
    df: DataFrame,
    text: str = config.TEXT,
    tags: str = config.TAGS,
    key: str = config.KEY,
    min_chars: int = config.MIN_TEXT_CHARS,
    drop: tuple[str, ...] = config.DROPPED_COLUMNS,
) -> DataFrame:
    """Filter, drop unused columns, keep the first row of each text."""
    return keep_first_texts(keep_usable(df, text, tags, min_chars).drop(*drop), text, key)


def cleaning_counts(
    df: DataFrame, text: str = config.TEXT, tags: str = config.TAGS, min_chars: int = config.MIN_TEXT_CHARS
) -> DataFrame:
    """One row: rows read, dropped by each rule in order, repeats dropped, rows kept.

    Texts are grouped by identity, with repeats combined before the shuffle.
    """
    short = F.length(strip(text)) < min_chars
    fate = (
        F.when(F.col(text).isNull(), "null_text")
        .when(short, "short_text")
        .when(F.col(tags).isNull(), "null_tags")
        .otherwise("usable")
    )
    usable = fate == "usable"
    grouped = df.groupBy(fate.alias("fate"), F.when(usable, text_identity(text)).alias("_id")).agg(F.count(F.lit(1)).alias("n"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    def dropped(name: str) -> Column:
        return total(F.when(F.col("fate") == name, F.col("n")))

    return grouped.agg(
        total(F.col("n")).alias("n_rows"),
        dropped("null_text").alias("null_text"),
        dropped("short_text").alias("short_text"),
        dropped("null_tags").alias("null_tags"),
        total(F.when(F.col("fate") == "usable", F.col("n") - 1)).alias("repeats"),
        total(F.when(F.col("fate") == "usable", F.lit(1))).alias("kept"),
    )


def filed_until(df: DataFrame, date: str = config.FILED, year: int = config.TIME_TRAIN_MAX_YEAR) -> DataFrame:
    return df.filter(F.year(date) <= year)


def filed_after(df: DataFrame, date: str = config.FILED, year: int = config.TIME_TRAIN_MAX_YEAR) -> DataFrame:
    return df.filter(F.year(date) > year)
