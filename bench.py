"""Headline jobs on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each job starts from the given Parquet tables and ends with its result fully computed.
``rows_per_sec`` gives the throughput of the jobs the published numbers cover.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from caseloom import catalog
from caseloom.catalog.base import reports
from caseloom.operators import features, models
from caseloom.plans import dataset, scoring, training
from caseloom.session import build_session, work_path
from caseloom.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MIN_ROWS = 110
REGISTERED = (
    "clean_reports", "label_shares", "stratified_split", "text_leakage_pairs", "text_classical_clean", "text_light_clean",
    "word_vocabulary", "char_vocabulary", "word_tfidf", "classification_report", "multi_label_at_k", "confused_pairs",
    "error_breakdown", "top_alternatives", "word_frequencies", "log_metrics", "log_running_counts", "log_windowed_counts",
    "csv_typed_scan",
)


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        # Small inputs need as many tasks as cores; on a cluster the defaults apply.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.files.openCostInBytes": "128k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    raw = reports(spark, SF_DIR).withColumn(
        "dateComplaintFiled", F.date_add(F.lit("2022-06-01").cast("date"), (F.col("odiNumber") % 900).cast("int"))
    )
    n_rows = raw.count()  # also starts the JVM side, which is not part of any job
    out = work_path(spark, "bench")
    built = timed("dataset_build", lambda: dataset.run_dataset_build(raw, f"{out}/data", min_rows=MIN_ROWS))
    lemmas = spark.read.parquet(built.lemmas)
    splits = tables.load_splits(spark, built.splits)
    train = splits.filter("split = 'train'")
    timed("train_logistic_job", lambda: training.run_training(
        spark, built.splits, out, lemmas, {"word_tfidf": features.fit_word_tfidf}, {"logistic_regression": models.train_logistic},
    ))
    timed("score_explain_job", lambda: scoring.run_scoring(spark, reports(spark, SF_DIR), out, f"{out}/log"))
    small = features.fit_word_tfidf(train).transform(splits).select("odiNumber", "primary_component", "split", "features").persist()
    small.count()
    svm = timed("train_calibrated_svm", lambda: models.train_calibrated_svc(small.filter("split = 'train'")))
    timed("score_calibrated_svm", lambda: finish(svm.predict(small)))
    for name in REGISTERED:
        timed(name, lambda: finish(catalog.QUERIES[name](spark, SF_DIR)))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "rows": n_rows, "rows_per_sec": {k: round(n_rows / seconds[k], 1) for k in ("dataset_build", "train_logistic_job", "score_explain_job")},
    }))


if __name__ == "__main__":
    main()
