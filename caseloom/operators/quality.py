"""Gates that stop a job and profiles that describe a table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import config
from caseloom.functions.records import reject_reason, tag_set
from caseloom.functions.text import content_words, strip, text_identity
from caseloom.functions.words import CODES
from caseloom.operators.lookup import lookup

# The columns a report table must have.
REQUIRED_COLUMNS = (
    "odiNumber", "manufacturer", "crash", "fire", "numberOfInjuries", "numberOfDeaths", "dateOfIncident",
    "dateComplaintFiled", "vin", "components", "summary", "products", "make", "model", "modelYear",
)


class DataQualityError(ValueError):
    """A table does not meet the contract of the job that reads it."""


def missing_columns(columns: list[str], required: tuple[str, ...] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(columns))


def surplus_rows(df: DataFrame, key: str | list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key. Counts are combined map-side."""
    keys = [key] if isinstance(key, str) else key
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    )


def assert_report_schema(df: DataFrame, header: list[str] | None = None, key: str = config.KEY) -> None:
    """Raise unless all required columns exist, there are rows, and the key is unique.

    ``header`` is the real header of a CSV: a schema given to the reader maps columns
    by position, so the DataFrame's own names prove nothing.
    """
    missing = missing_columns(header if header is not None else df.columns)
    if missing:
        raise DataQualityError(f"a report table must also have the columns {missing}")
    if df.isEmpty():
        raise DataQualityError("there are no reports to work on")
    surplus = surplus_rows(df, key).first()["surplus"]
    if surplus:
        raise DataQualityError(f"{surplus} rows repeat a value of {key}, which has to name one row")


def gate_report(df: DataFrame, key: str = config.KEY, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """The same three checks as rows ``(check, violations)``, for a quality log."""
    missing = len(missing_columns(df.columns, required))
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("zero rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus keys"),
    ).withColumn("missing columns", F.lit(missing).cast("long"))
    return totals.unpivot([], ["missing columns", "zero rows", "surplus keys"], "check", "violations")


def route_scoring_input(
    df: DataFrame, text: str = config.TEXT, low: int = config.SCORE_MIN_CHARS, high: int = config.SCORE_MAX_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Split into rows to score, text stripped, and rejects with a ``reject_reason``.

    One bad row is set aside; it does not fail the rest of the batch.
    """
    marked = df.withColumn("reject_reason", reject_reason(text, low, high))
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason").withColumn(text, strip(text))
    return good, marked.filter(F.col("reject_reason").isNotNull())


def assert_not_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise DataQualityError("the batch has no rows")


def texts_in_several_splits(df: DataFrame, text: str = config.TEXT, split: str = "split", names=("train", "val", "test")) -> DataFrame:
    """Texts occurring in more than one split, with one flag per split.

    First only 8-byte hashes are shuffled, with flags combined map-side. Whole texts are
    compared for the hashes that occur in several splits, normally none, so the exact
    check costs no shuffle of the text column.
    """
    flags = [F.max((F.col(split) == n).cast("int")).alias(f"in_{n}") for n in names]
    spread = reduce(lambda a, b: a + b, [F.col(f"in_{n}") for n in names]) > 1
    hashed = df.select(F.xxhash64(text).alias("_h"), split, text).filter(F.col(text).isNotNull())
    suspects = hashed.select("_h", split).groupBy("_h").agg(*flags).filter(spread).select("_h")
    return (
        lookup(hashed, suspects, ["_h"], "left_semi")
        .groupBy("_h", text).agg(*flags).filter(spread).drop("_h")
    )


def leakage_pairs(df: DataFrame, text: str = config.TEXT, split: str = "split", names=("train", "val", "test")) -> DataFrame:
    """``(split_a, split_b, shared_texts)`` for every pair of splits."""
    pairs = list(combinations(names, 2))
    shared = texts_in_several_splits(df, text, split, names)
    row = shared.agg(*[
        F.coalesce(F.sum(F.col(f"in_{a}") * F.col(f"in_{b}")), F.lit(0)).cast("long").alias(f"{a}|{b}") for a, b in pairs
    ])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "shared_texts")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("split_a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("split_b"),
        "shared_texts",
    )


def assert_no_text_leakage(df: DataFrame, text: str = config.TEXT, split: str = "split", names=("train", "val", "test")) -> None:
    shared = texts_in_several_splits(df, text, split, names).count()
    if shared:
        raise DataQualityError(f"{shared} texts are shared by splits that must not share any")


def row_agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, only on the left, only on the right."""
    both = left.select(key, F.lit(1).alias("_l")).join(right.select(key, F.lit(1).alias("_r")), key, "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def assert_same_rows(left: DataFrame, right: DataFrame, key: str) -> None:
    found = row_agreement(left, right, key).first()
    if found["left_only"] or found["right_only"]:
        raise DataQualityError(f"row mismatch: {found['left_only']} only left, {found['right_only']} only right")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_null)`` for every column, from one scan."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", "n_null")


def numeric_summary(df: DataFrame) -> DataFrame:
    """``(column_name, n, mean, sd, low, high)`` for every numeric column, from one scan."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    measures = (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))
    row = df.agg(*[fn(F.col(f"`{c}`").cast("double")).cast("double").alias(f"{c}|{m}") for c in names for m, fn in measures])
    long = row.unpivot([], row.columns, "pair", "value")
    parts = long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("column_name"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("measure"),
        "value",
    )
    wide = parts.groupBy("column_name").pivot("measure", [m for m, _ in measures]).agg(F.first("value"))
    return wide.withColumn("n", F.col("n").cast("long"))


def column_info(df: DataFrame) -> DataFrame:
    """``(position, column_name, type, n_present)``."""
    present = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "n_present")
    types = F.create_map(*[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())])
    places = F.create_map(*[v for i, c in enumerate(df.columns) for v in (F.lit(c), F.lit(i).cast("long"))])
    return present.select(places[F.col("column_name")].alias("position"), "column_name", types[F.col("column_name")].alias("type"), "n_present")


def cleaning_audit(df: DataFrame, text: str = config.TEXT, tags: str = config.TAGS, vin: str | None = None) -> DataFrame:
    """One row: null and short texts, missing vin share, repeated rows, texts with several labels.

    Texts are grouped by identity, so none is shuffled; repeats are combined map-side, so
    one text that fills a third of the table leaves each map task as a single row.
    """
    short = F.coalesce(F.length(strip(text)) < config.MIN_TEXT_CHARS, F.lit(False))
    absent = F.col(vin).isNull() if vin else F.lit(None).cast("boolean")
    known = F.col("_id").isNotNull()
    per_pair = df.groupBy(F.when(F.col(text).isNotNull(), text_identity(text)).alias("_id"), short.alias("_short"), tags).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(absent).alias("no_vin")
    )
    per_text = per_pair.groupBy("_id", "_short").agg(
        F.sum("n").alias("n"),
        F.sum("no_vin").alias("no_vin"),
        F.sum(F.when(known & F.col(tags).isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeats"),
        F.count(F.col(tags)).alias("labels"),
    )
    return per_text.agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_texts"),
        F.coalesce(F.sum(F.when(F.col("_short"), F.col("n"))), F.lit(0)).alias("short_texts"),
        (F.sum("no_vin") / F.sum("n")).alias("missing_vin_share"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeated_pairs"),
        F.count_if(known & (F.col("labels") > 1)).alias("texts_with_several_labels"),
    )


def vocabulary_audit(df: DataFrame, text: str = config.TEXT) -> DataFrame:
    """One row: distinct content words and the share that occurs once."""
    counts = df.select(F.explode(content_words(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count_if(F.col("n") == 1).alias("n_once"),
        F.avg((F.col("n") == 1).cast("double")).alias("once_share"),
    )


def code_prevalence(df: DataFrame, text: str | Column = config.TEXT) -> DataFrame:
    """One row: rows holding a transcription code and their share."""
    text = F.col(text) if isinstance(text, str) else text
    hit = F.coalesce(text.rlike("(?U)" + CODES), F.lit(False))
    return df.agg(F.count_if(hit).alias("n_coded"), F.avg(hit.cast("double")).alias("coded_share"))


def label_audit(df: DataFrame, tags: str = config.TAGS, label: str = config.LABEL, other: str = config.OTHER) -> DataFrame:
    """One row: classes, share of rows with several tags, rows folded into the rest class."""
    return df.agg(
        F.countDistinct(label).alias("n_classes"),
        F.avg((F.size(tag_set(tags)) > 1).cast("double")).alias("multi_tag_share"),
        F.count_if(F.col(label) == other).alias("folded_rows"),
    )
