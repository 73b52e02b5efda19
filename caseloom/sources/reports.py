"""Report tables: CSV with a fixed schema, text batches, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import strip
from caseloom.operators.quality import DataQualityError, assert_report_schema, missing_columns
from caseloom.session import settle
from caseloom.sources.records import csv_records

# The columns of a report file in file order.
REPORT_SCHEMA = T.StructType([
    T.StructField("odiNumber", T.LongType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("crash", T.BooleanType()),
    T.StructField("fire", T.BooleanType()),
    T.StructField("numberOfInjuries", T.LongType()),
    T.StructField("numberOfDeaths", T.LongType()),
    T.StructField("dateOfIncident", T.DateType()),
    T.StructField("dateComplaintFiled", T.DateType()),
    T.StructField("vin", T.StringType()),
    T.StructField("components", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("products", T.StringType()),
    T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("modelYear", T.LongType()),
])

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "dateFormat": "MM/dd/yyyy"}
DAMAGED = "damaged_line"


def csv_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names as they stand in the file (the first one of several)."""
    return spark.read.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "dateFormat"}).csv(path).columns


def _schema_in_file_order(header) -> T.StructType:
    """The schema's types under the file's own order; unknown columns are read as strings."""
    known = {f.name: f for f in REPORT_SCHEMA.fields}
    return T.StructType([known.get(name, T.StructField(name, T.StringType())) for name in header])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _read_by_header(spark: SparkSession, path: str, mode: str, damaged: bool = False, validate: bool = False) -> DataFrame:
    """All files, each under the schema of its own header, put together by column name."""
    found = csv_records(spark, path)
    if not found.headers:
        raise DataQualityError("there are no reports to work on")
    parts = []
    for i, (header, file) in enumerate(found.headers):
        if validate and missing_columns(list(header)):
            raise DataQualityError(f"{file} lacks columns that a report table must have: {missing_columns(list(header))}")
        schema = _schema_in_file_order(header)
        options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "multiLine")} | {"mode": mode}
        if damaged:
            schema = schema.add(DAMAGED, T.StringType())
            options["columnNameOfCorruptRecord"] = DAMAGED
        parts.append(found.records.filter(F.col("header") == i).select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def load_reports(spark: SparkSession, path: str, validate: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Read report CSV files with types. ``validate`` runs the schema, row and key checks.

    Types follow the names in the header of each file, so files with columns in another order, or in different orders,
    are read correctly. A file with line breaks in its fields is read in many tasks (``csv_records``). A validated table is
    parsed once and written to the shared folder; the checks and all later steps read that.
    """
    df = _read_by_header(spark, path, mode, validate=validate)
    if validate:
        df = settle(df, "reports")
        assert_report_schema(df)
    return df


def audit_malformed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read permissively and return (sound rows, damaged rows with their raw text).

    The parsed rows are written once, sound and damaged apart: a scan that prunes columns
    would not notice damage in the columns it skips.
    """
    df = _read_by_header(spark, path, "PERMISSIVE", damaged=True)
    parsed = settle(df.withColumn("_damaged", F.col(DAMAGED).isNotNull()), "audited", ["_damaged"])
    return parsed.filter("not _damaged").drop("_damaged", DAMAGED), parsed.filter("_damaged").drop("_damaged")


def write_reports_csv(df: DataFrame, path: str) -> None:
    """Write CSV that ``load_reports`` reads back unchanged."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet with only the named columns in the scan."""
    return spark.read.parquet(path).select(*columns)


def read_batch_csv(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The chosen text column of any CSV, as strings, nulls dropped."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "dateFormat"}
    df = spark.read.options(**options).csv(path)
    return df.filter(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text per line, stripped, blank lines dropped."""
    lines = spark.read.text(path).select(strip("value").alias("text"))
    return lines.filter(F.col("text") != "")


def write_results_csv(df: DataFrame, path: str) -> None:
    write_reports_csv(df, path)
