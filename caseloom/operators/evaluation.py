"""Classification metrics. One shuffle makes the confusion counts; the rest reads those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.records import tag_set


def confusion_counts(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """``(true, pred, n)``"""
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(confusion: DataFrame) -> DataFrame:
    """``(label, tp, support, predicted)`` over the union of true and predicted labels."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("true") == F.col("pred"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true").alias("label"), hit.alias("tp"), n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")),
    )
    return confusion.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_scores(df: DataFrame, true: str = "true", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)``; an undefined ratio is 0.

    With ``labels``, the label space of a training run, exactly these classes are listed, absent ones with zeros.
    """
    c = class_counts(confusion_counts(df, true, pred))
    if labels is not None:
        listed = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        c = listed.join(c, "label", "left").na.fill(0, ["tp", "support", "predicted"])
    return c.select(
        "label",
        "tp",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def compute_metrics(df: DataFrame, true: str = "true", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, weighted F1. Null for no rows."""
    total = F.sum("support")
    return class_scores(df, true, pred, labels).agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
    )


def classification_report(df: DataFrame, true: str = "true", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class, then accuracy and two averages."""
    scores = class_scores(df, true, pred, labels)
    total = F.sum("support")
    averages = scores.agg(
        (F.sum("tp") / total).alias("acc"),
        total.alias("total"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    none = F.lit(None).cast("double")

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("total").alias("support"))

    extra = averages.select(F.inline(F.array(
        row("accuracy", none, none, F.col("acc")),
        row("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
        row("weighted avg", F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1")),
    )))
    return scores.drop("tp").unionByName(extra)


def report_text(report: DataFrame) -> DataFrame:
    """The report as aligned text lines ``(line_no, line)``, classes first, averages last."""
    averages = F.col("label").isin("accuracy", "macro avg", "weighted avg")
    number = lambda c: F.coalesce(F.format_string("%9.3f", c), F.lit(" " * 9))
    line = F.concat(
        F.lpad("label", 28, " "),
        F.when(F.col("precision").isNull(), F.lit(" " * 9)).otherwise(number(F.col("precision"))),
        F.when(F.col("recall").isNull(), F.lit(" " * 9)).otherwise(number(F.col("recall"))),
        number(F.col("f1")),
        F.format_string("%9d", "support"),
    )
    return report.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(averages, "label")).alias("line_no"), line.alias("line"))


def confusion_matrix(df: DataFrame, labels: list[str], true: str = "true", pred: str = "pred") -> DataFrame:
    """One row per true label and one column per predicted label, in the given order.

    Pairs outside the list are dropped; labels without rows keep a row of zeros.
    """
    counts = confusion_counts(df, true, pred).filter(F.col("true").isin(labels) & F.col("pred").isin(labels))
    wide = counts.groupBy("true").pivot("pred", labels).agg(F.sum("n"))
    order = df.sparkSession.createDataFrame(list(enumerate(labels)), "pos long, true string")
    return order.join(wide, "true", "left").na.fill(0, labels).orderBy("pos").select(F.col("true").alias("true_label"), *[F.col(f"`{c}`") for c in labels])


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """One row: the accuracy of always answering the most frequent label."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_share"))


def lenient_accuracy(df: DataFrame, tags: str = "components", pred: str = "pred") -> DataFrame:
    """One row: share of predictions found anywhere in the listed tags."""
    hit = F.array_contains(tag_set(tags), F.col(pred))
    return df.agg(F.avg(hit.cast("double")).alias("lenient_accuracy"))


def metrics_at_k(df: DataFrame, ks: tuple[int, ...] = (1, 3), tags: str = "components", ranked: str = "ranked") -> DataFrame:
    """``(k, recall_at_k, full_coverage_at_k, precision_at_k)``, all k from one scan.

    ``ranked`` is an array of labels, best first.
    """
    truth = tag_set(tags)
    measures = []
    for k in ks:
        hits = F.size(F.array_intersect(truth, F.slice(F.col(ranked), 1, k))).cast("double")
        measures += [
            F.avg(hits / F.size(truth)).alias(f"recall_at_k|{k}"),
            F.avg((hits == F.size(truth)).cast("double")).alias(f"full_coverage_at_k|{k}"),
            F.avg(hits / F.lit(k)).alias(f"precision_at_k|{k}"),
        ]
    row = df.agg(*measures)
    names = ("recall_at_k", "full_coverage_at_k", "precision_at_k")
    per_k = [F.struct(F.lit(k).cast("long").alias("k"), *[F.col(f"{m}|{k}").alias(m) for m in names]) for k in ks]
    return row.select(F.inline(F.array(*per_k)))


def compare_models(metrics: DataFrame) -> DataFrame:
    """Rank runs by macro F1 and add lenient gap and latency ratio to the fastest.

    ``metrics`` holds ``name, accuracy, lenient_accuracy, macro_f1, latency_ms``, a row per run.
    """
    everything = Window.partitionBy(F.lit(0))
    return metrics.select(
        "name",
        "macro_f1",
        F.rank().over(everything.orderBy(F.desc("macro_f1"))).cast("long").alias("rank"),
        (F.col("lenient_accuracy") - F.col("accuracy")).alias("lenient_gap"),
        (F.col("latency_ms") / F.min("latency_ms").over(everything)).alias("latency_ratio"),
    )
