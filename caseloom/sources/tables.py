"""Tables the jobs leave behind: splits, taxonomy, runs, models, prediction log."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from caseloom import config
from caseloom.functions.text import preview
from caseloom.operators.evaluation import classification_report, confusion_counts, report_text
from caseloom.operators.errors import confused_pairs
from caseloom.operators.models import TrainedModel, load_model
from caseloom.sources.markers import Lease, create_once, names_in, newest_number, read_marker

SPLITS = ("train", "val", "test")


def write_splits(df: DataFrame, path: str) -> None:
    """One table partitioned by ``split``; a reader of one split opens only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """The split table; raises if any split is missing."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path} not found: build the dataset first") from missing
    present = {r["split"] for r in df.select("split").distinct().collect()}
    absent = [n for n in names if n not in present]
    if absent:
        raise FileNotFoundError(f"{path} lacks the splits {absent}: build the dataset first")
    return df


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    taxonomy.select("label").distinct().orderBy("label").write.mode("overwrite").json(path)


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string").json(path)


def _stamped(df: DataFrame, run_id: str, family: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id)).withColumn("family", F.lit(family))


def write_run(
    predictions: DataFrame, metrics: DataFrame, path: str, run_id: str, family: str = "baseline", top_pairs: int = 20,
    labels: list[str] | None = None,
) -> None:
    """Append one run: metrics, class report as rows and as text, confusion counts and confused pairs.

    ``predictions`` holds ``true`` and ``pred``; ``metrics`` is ``(scope, metric, value)``.
    """
    counts = confusion_counts(predictions)
    report = classification_report(predictions, labels=labels)
    for name, table in (
        ("run_metrics", metrics),
        ("run_report", report),
        ("run_report_text", report_text(report)),
        ("run_confusion", counts),
        ("run_pairs", confused_pairs(predictions, top_pairs)),
    ):
        _stamped(table, run_id, family).coalesce(1).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


RUN_TABLES = {  # columns of the tables of a run; a table without rows has no file that tells them
    "run_metrics": "scope string, metric string, value double",
    "run_report": "label string, precision double, recall double, f1 double, support long",
    "run_report_text": "line_no int, line string",
    "run_confusion": "true string, pred string, n long",
    "run_pairs": "true string, pred string, count long",
}


def latest_run(spark: SparkSession, path: str, table: str, family: str = "baseline") -> DataFrame:
    """Rows of the newest run of a family; run ids sort by time."""
    reader = spark.read.schema(f"{RUN_TABLES[table]}, family string, run_id string") if table in RUN_TABLES else spark.read
    df = reader.parquet(f"{path}/{table}").filter(F.col("family") == family)
    newest = df.agg(F.max("run_id").alias("run_id"))
    return df.join(F.broadcast(newest), "run_id", "left_semi")


def latest_run_tables(spark: SparkSession, path: str, family: str = "baseline") -> dict[str, DataFrame]:
    """All tables of the newest run of a family, by name."""
    return {name: latest_run(spark, path, name, family) for name in RUN_TABLES}


def append_experiments(df: DataFrame, path: str) -> None:
    """One row per trained combination: parameters, val metrics, times."""
    df.coalesce(1).write.mode("append").parquet(path)


def should_promote(full_run: bool, force: bool = False) -> bool:
    """A model trained on a subsample is not served unless forced."""
    return full_run or force


POINTER = "run_id string, home string, featurizer string, model string, has_lemmas boolean, fence long, promoted_at timestamp"


def promote(
    spark: SparkSession, path: str, run_id: str, featurizer: PipelineModel, featurizer_name: str, model: TrainedModel,
    lemmas: DataFrame | None = None, full_run: bool = True, force: bool = False, lease: Lease | None = None,
) -> bool:
    """Save model, featurizer and lemma table under the run, then append the pointer row.

    The pointer comes last and is only ever appended to, so a reader sees the old model or the new one, never half of
    either. A job whose lease has run out or was followed by another does not promote; the row carries the lease's
    number, and a later number wins whenever its row is written.
    """
    if not should_promote(full_run, force) or lease is not None and not lease.holds(spark):
        return False
    home = f"{path}/models/{run_id}"
    model.save(spark, f"{home}/model")
    featurizer.write().overwrite().save(f"{home}/featurizer")
    if lemmas is not None:
        lemmas.write.mode("overwrite").parquet(f"{home}/lemmas")
    if lease is not None and not lease.holds(spark):
        return False
    fence = newest_number(spark, f"{path}/retrain_lock") if lease is None else lease.number
    row = [(run_id, home, featurizer_name, model.kind, lemmas is not None, fence)]
    pointer = spark.createDataFrame(row, ", ".join(POINTER.split(", ")[:-1]))
    pointer.withColumn("promoted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/current_model")
    return True


def current_model(spark: SparkSession, path: str) -> dict:
    """The pointer row of the highest fence, and of these the one promoted last."""
    spark.read.parquet(f"{path}/current_model")  # raises if nothing was promoted
    table = spark.read.schema(POINTER).parquet(f"{path}/current_model")
    order = F.struct(F.coalesce("fence", F.lit(0)).alias("fence"), "promoted_at", "run_id")
    return table.agg(F.max_by(F.struct("*"), order).alias("r")).first()["r"].asDict()


def load_run(spark: SparkSession, path: str, run_id: str) -> tuple[PipelineModel, TrainedModel, DataFrame | None]:
    """Featurizer, model and lemma table of a promoted run."""
    row = spark.read.schema(POINTER).parquet(f"{path}/current_model").filter(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"run {run_id!r} was never promoted")
    lemmas = spark.read.parquet(f"{row['home']}/lemmas") if row["has_lemmas"] else None
    return PipelineModel.load(f"{row['home']}/featurizer"), load_model(spark, f"{row['home']}/model"), lemmas


def load_serving(spark: SparkSession, path: str, backend: str = "baseline") -> tuple[PipelineModel, TrainedModel, DataFrame | None]:
    """Featurizer, model and lemma table now in use. Only the trained backend is built in."""
    if backend != "baseline":
        raise ValueError(f"unknown scoring backend: {backend!r}")
    return load_run(spark, path, current_model(spark, path)["run_id"])


def pinned_run(spark: SparkSession, path: str, pins: str, epoch: int) -> str:
    """The run that an epoch of a stream is scored with: the one in use when it was first asked for, also for a replay."""
    place = f"{pins}/{epoch:012d}"
    if f"{epoch:012d}" not in names_in(spark, pins):
        create_once(spark, place, current_model(spark, path)["run_id"])
    return read_marker(spark, place)


LOG_SCHEMA = (
    "timestamp timestamp, text_preview string, predicted_label string, confidence double, "
    "model_backend string, latency_ms double"
)


def log_rows(scored: DataFrame, text: str = config.TEXT, at: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """Prediction-log records of scored rows; latency is batch time over rows."""
    return scored.select(
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        preview(text).alias("text_preview"),
        "predicted_label",
        "confidence",
        "model_backend",
        (F.lit(None).cast("double") if latency_ms is None else latency_ms).alias("latency_ms"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def log_metrics(log: DataFrame, label: str = "predicted_label", latency: str = "latency_ms", at: str = "timestamp") -> DataFrame:
    """One row: predictions, mean latency, counts per class, seconds between first and last.

    Counts are per class first, so the last step sees one row per class.
    """
    per_class = log.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(latency).alias("ms"), F.count(latency).alias("timed"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )
    seconds = F.unix_micros(F.max("last_at")) - F.unix_micros(F.min("first_at"))
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.round(F.try_divide(F.sum("ms"), F.sum("timed")), 3).alias("avg_latency_ms"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("class_distribution"),
        F.round(seconds / 1e6, 1).alias("span_seconds"),
    )
