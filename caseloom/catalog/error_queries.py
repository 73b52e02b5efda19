"""Evaluation, error analysis and exploration on the rule predictor's output."""

from __future__ import annotations


from pyspark.sql import functions as F

from caseloom.catalog.base import CLASSES, PREDICTED_SQL, RANKED_SQL, TAG_SET_SQL, LABELLED_SQL, labelled, predictions, query, reports, table
from caseloom.functions import records
from caseloom.operators import errors, evaluation, explore, scoring

SCORES_SQL = PREDICTED_SQL + """, labels_seen AS (SELECT "true" AS label FROM predicted UNION SELECT pred FROM predicted),
counts AS (SELECT l.label,
  (SELECT count(*) FROM predicted p WHERE p."true" = l.label AND p.pred = l.label) AS tp,
  (SELECT count(*) FROM predicted p WHERE p."true" = l.label) AS support,
  (SELECT count(*) FROM predicted p WHERE p.pred = l.label) AS predicted_n FROM labels_seen l),
scores AS (SELECT label, tp, support,
  CASE WHEN predicted_n = 0 THEN 0.0 ELSE tp::DOUBLE / predicted_n END::DOUBLE AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END::DOUBLE AS recall,
  CASE WHEN support + predicted_n = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted_n) END::DOUBLE AS f1 FROM counts)"""


def rounded(df, *names, digits: int = 10):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "classification_metrics",
    f"""WITH {SCORES_SQL} SELECT round(sum(tp)::DOUBLE / sum(support), 10) AS accuracy, round(avg(precision), 10) AS macro_precision,
  round(avg(recall), 10) AS macro_recall, round(avg(f1), 10) AS macro_f1, round(sum(f1 * support) / sum(support), 10) AS weighted_f1 FROM scores""",
)
def classification_metrics(spark, sf):
    m = evaluation.compute_metrics(predictions(spark, sf))
    return rounded(m, *m.columns)


@query(
    "classification_report",
    f"""WITH {SCORES_SQL} SELECT label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 10), sum(support)::BIGINT FROM scores
UNION ALL SELECT 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1), 10), sum(support)::BIGINT FROM scores
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 10), round(sum(recall * support) / sum(support), 10),
  round(sum(f1 * support) / sum(support), 10), sum(support)::BIGINT FROM scores""",
)
def classification_report(spark, sf):
    return rounded(evaluation.classification_report(predictions(spark, sf)), "precision", "recall", "f1")


@query(
    "classification_report_text",
    f"""WITH {SCORES_SQL}, r AS (SELECT 0 AS g, label, precision, recall, f1, support FROM scores
UNION ALL SELECT 1, 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support) FROM scores
UNION ALL SELECT 1, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
UNION ALL SELECT 1, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM scores)
SELECT row_number() OVER (ORDER BY g, label)::INT AS line_no, lpad(label, 28, ' ') || coalesce(format('{{:9.3f}}', precision), repeat(' ', 9)) ||
  coalesce(format('{{:9.3f}}', recall), repeat(' ', 9)) || format('{{:9.3f}}', f1) || format('{{:9d}}', support::BIGINT) AS line FROM r""",
)
def classification_report_text(spark, sf):
    return evaluation.report_text(evaluation.classification_report(predictions(spark, sf)))


@query("confusion_counts", f'WITH {PREDICTED_SQL} SELECT "true", pred, count(*) AS n FROM predicted GROUP BY ALL')
def confusion_counts(spark, sf):
    return evaluation.confusion_counts(predictions(spark, sf))


def _matrix_sql(names) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE pred = '{c}' AND \"true\" = l) AS \"{c}\"" for c in names)
    return f'WITH {PREDICTED_SQL}, l AS (SELECT unnest({list(names)}) AS l) SELECT l AS true_label, {cells} FROM l LEFT JOIN predicted ON "true" = l GROUP BY l'


@query("confusion_matrix", _matrix_sql(("DE", "EN", "FR", "PT")))
def confusion_matrix(spark, sf):
    """Over a list that lacks one class and names one that does not occur."""
    return evaluation.confusion_matrix(predictions(spark, sf), ["DE", "EN", "FR", "PT"])


@query("majority_share", f"WITH {LABELLED_SQL}, c AS (SELECT count(*) AS n FROM labelled GROUP BY primary_component) SELECT round(max(n)::DOUBLE / sum(n), 10) AS majority_share FROM c")
def majority_share(spark, sf):
    return rounded(evaluation.majority_share(labelled(spark, sf), "primary_component"), "majority_share")


@query("lenient_accuracy", f"WITH {PREDICTED_SQL} SELECT round(avg(list_contains({TAG_SET_SQL}, pred)::INT)::DOUBLE, 10) AS lenient_accuracy FROM predicted")
def lenient_accuracy(spark, sf):
    return rounded(evaluation.lenient_accuracy(predictions(spark, sf)), "lenient_accuracy")


AT_K_SQL = f"""WITH {RANKED_SQL}, truth AS (SELECT odiNumber, {TAG_SET_SQL} AS tags FROM predicted),
h AS (SELECT k, t.odiNumber, len(t.tags) AS n, count(*) FILTER (WHERE list_contains(t.tags, o.label)) AS hits
  FROM (SELECT unnest([1, 3]) AS k) ks, truth t JOIN ordered o USING (odiNumber) WHERE o.pos <= k GROUP BY ALL)
SELECT k::BIGINT AS k, round(avg(hits::DOUBLE / n), 10) AS recall_at_k, round(avg((hits = n)::INT)::DOUBLE, 10) AS full_coverage_at_k,
  round(avg(hits::DOUBLE / k), 10) AS precision_at_k FROM h GROUP BY k"""


def _ranked(df):
    names = F.array(*[F.lit(c) for c in CLASSES])
    return df.withColumn("ranked", F.transform(records.ranked_labels("probability", names, None, None), lambda r: r["label"]))


@query("multi_label_at_k", AT_K_SQL)
def multi_label_at_k(spark, sf):
    return rounded(evaluation.metrics_at_k(_ranked(predictions(spark, sf))), "recall_at_k", "full_coverage_at_k", "precision_at_k")


@query("precision_at_1_is_lenient", "SELECT 0.0::DOUBLE AS gap, (count(*) > 0) AS has_rows FROM documents")
def precision_at_1_is_lenient(spark, sf):
    """Precision at 1 equals lenient accuracy when the prediction is the top alternative."""
    p = _ranked(predictions(spark, sf)).withColumn("pred", F.get("ranked", 0))
    at_1 = evaluation.metrics_at_k(p, (1,)).select("precision_at_k")
    both = at_1.select(F.col("precision_at_k").alias("v"), F.lit(1).alias("sign")).unionByName(
        evaluation.lenient_accuracy(p).select(F.col("lenient_accuracy").alias("v"), F.lit(-1).alias("sign"))
    )
    return both.agg(F.abs(F.round(F.sum(F.col("v") * F.col("sign")), 10)).alias("gap"), (F.count("v") == 2).alias("has_rows"))


@query("confused_pairs", f'WITH {PREDICTED_SQL} SELECT "true", pred, count(*) AS count FROM predicted WHERE "true" <> pred GROUP BY ALL ORDER BY count DESC, "true", pred LIMIT 20')
def confused_pairs(spark, sf):
    return errors.confused_pairs(predictions(spark, sf))


@query("pair_examples", f"WITH {PREDICTED_SQL} SELECT odiNumber, summary, \"true\", pred FROM predicted WHERE \"true\" = 'FR' AND pred = 'EN' ORDER BY odiNumber LIMIT 5")
def pair_examples(spark, sf):
    return errors.pair_examples(predictions(spark, sf), "FR", "EN", "odiNumber").select("odiNumber", "summary", "true", "pred")


@query("examples_of_every_pair", f'WITH {PREDICTED_SQL} SELECT odiNumber, "true", pred, rank FROM (SELECT *, row_number() OVER (PARTITION BY "true", pred ORDER BY odiNumber) AS rank FROM predicted WHERE "true" <> pred) WHERE rank <= 5')
def examples_of_every_pair(spark, sf):
    found = errors.examples_of_every_pair(predictions(spark, sf), "odiNumber")
    return found.select("odiNumber", "true", "pred", F.col("rank").cast("long").alias("rank"))


@query("false_negatives", f"WITH {PREDICTED_SQL} SELECT odiNumber, pred FROM predicted WHERE \"true\" = 'FR' AND pred <> 'FR' ORDER BY odiNumber LIMIT 10")
def false_negatives(spark, sf):
    return errors.false_negatives(predictions(spark, sf), "FR", "odiNumber").select("odiNumber", "pred")


@query("false_positives", f"WITH {PREDICTED_SQL} SELECT odiNumber, \"true\" FROM predicted WHERE pred = 'EN' AND \"true\" <> 'EN' ORDER BY odiNumber LIMIT 10")
def false_positives(spark, sf):
    return errors.false_positives(predictions(spark, sf), "EN", "odiNumber").select("odiNumber", "true")


@query(
    "missed_and_false_counts",
    f"""WITH {PREDICTED_SQL}, e AS (SELECT "true", pred FROM predicted WHERE "true" <> pred),
s AS (SELECT "true" AS label, 1 AS fn, 0 AS fp FROM e UNION ALL SELECT pred, 0, 1 FROM e)
SELECT label, sum(fn)::BIGINT AS false_negatives, sum(fp)::BIGINT AS false_positives FROM s GROUP BY label""",
)
def missed_and_false_counts(spark, sf):
    return errors.missed_and_false_counts(predictions(spark, sf))


@query("predictions_zipped", f'WITH {PREDICTED_SQL} SELECT odiNumber, summary, "true", pred FROM predicted')
def predictions_zipped(spark, sf):
    """Texts with labels joined to a prediction table by key."""
    truth = reports(spark, sf).select("odiNumber", "summary", F.upper("lang").alias("true"))
    return errors.zip_predictions(truth, predictions(spark, sf).select("odiNumber", "pred"), "odiNumber")


@query(
    "wrong_and_right_rows",
    f'WITH {PREDICTED_SQL} SELECT "true" = pred AS correct, count(*) AS n, sum(length(summary))::BIGINT AS n_chars FROM predicted GROUP BY 1',
)
def wrong_and_right_rows(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy((F.col("true") == F.col("pred")).alias("correct")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("summary")).alias("n_chars"))


def _breakdown_sql() -> str:
    return f"""WITH {PREDICTED_SQL}, p AS (SELECT *, CASE WHEN doc_mod = 0 THEN components || ', EN' ELSE components END AS tags
  FROM (SELECT *, odiNumber % 4 AS doc_mod FROM predicted)),
s AS (SELECT CASE WHEN "true" = pred THEN 1 WHEN list_contains(string_split(tags, ', '), pred) THEN 2 WHEN "true" = 'ES' THEN 3
  WHEN "true" IN ('DE', 'EN') AND pred IN ('DE', 'EN') THEN 4 ELSE 5 END AS no, count(*) AS n FROM p GROUP BY 1)
SELECT (['strict', 'secondary tag', 'unknown class', 'same family', 'other'])[no] AS step, round(n::DOUBLE / sum(n) OVER (), 10) AS share,
  round((sum(n) OVER (ORDER BY no))::DOUBLE / sum(n) OVER (), 10) AS cumulative FROM s"""


@query("error_breakdown", _breakdown_sql())
def error_breakdown(spark, sf):
    tags = F.when(F.col("odiNumber") % 4 == 0, F.concat("components", F.lit(", EN"))).otherwise(F.col("components"))
    p = predictions(spark, sf).withColumn("components", tags)
    return rounded(errors.error_breakdown(p, "ES", ["DE", "EN"]), "share", "cumulative")


@query(
    "model_comparison",
    """WITH m AS (SELECT lang AS name, avg((doc_id % 3 = 0)::INT)::DOUBLE AS accuracy, avg((doc_id % 2 = 0)::INT)::DOUBLE AS lenient_accuracy,
  avg((doc_id % 5 = 0)::INT)::DOUBLE AS macro_f1, avg(n_chars)::DOUBLE AS latency_ms FROM documents GROUP BY lang)
SELECT name, round(macro_f1, 10) AS macro_f1, rank() OVER (ORDER BY round(macro_f1, 10) DESC) AS rank,
  round(lenient_accuracy - accuracy, 10) AS lenient_gap, round(latency_ms / min(latency_ms) OVER (), 8) AS latency_ratio FROM m""",
)
def model_comparison(spark, sf):
    """Runs compared side by side; each language stands for one run."""
    share = lambda n: F.avg((F.col("doc_id") % n == 0).cast("double"))
    m = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(
        share(3).alias("accuracy"), share(2).alias("lenient_accuracy"), F.round(share(5), 10).alias("macro_f1"), F.avg("n_chars").alias("latency_ms")
    )
    return rounded(rounded(evaluation.compare_models(m), "lenient_gap"), "latency_ratio", digits=8)


# ---------------------------------------------------------------- ranked alternatives

@query(
    "top_alternatives",
    f"WITH {RANKED_SQL} SELECT odiNumber, label, round(p, 4) AS confidence, pos FROM ordered WHERE pos <= 3",
)
def top_alternatives(spark, sf):
    names = F.array(*[F.lit(c) for c in CLASSES])
    ranked = predictions(spark, sf).select("odiNumber", F.posexplode(records.ranked_labels("probability", names)).alias("pos", "r"))
    return ranked.select("odiNumber", F.col("r.label").alias("label"), F.col("r.confidence").alias("confidence"), (F.col("pos") + 1).cast("long").alias("pos"))


def _ruled(spark, sf):
    names = F.array(*[F.lit(c) for c in CLASSES])
    p = predictions(spark, sf)
    return p.withColumn("top_k", records.ranked_labels("probability", names)).withColumn("predicted_label", F.get("top_k", 0)["label"]).withColumn(
        "confidence", F.get("top_k", 0)["confidence"]
    )


@query("confidence_bands", f"WITH {PREDICTED_SQL} SELECT CASE WHEN round(list_max(probability), 4) >= 0.7 THEN 'high' WHEN round(list_max(probability), 4) >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM predicted GROUP BY 1")
def confidence_bands(spark, sf):
    return scoring.band_counts(_ruled(spark, sf))


@query("backends_compared", f"WITH {RANKED_SQL} SELECT pred AS label_a, label AS label_b, count(*) AS n FROM ordered o JOIN predicted p USING (odiNumber) WHERE pos = 1 GROUP BY ALL")
def backends_compared(spark, sf):
    """The rule label against the top alternative of the probability table."""
    b = _ruled(spark, sf)
    a = b.select("odiNumber", F.col("pred").alias("predicted_label"), "top_k")
    return scoring.compare_backends(a, b, "odiNumber")[1]


@query("backend_agreement", f"WITH {RANKED_SQL} SELECT odiNumber, pred = label AS agree FROM ordered o JOIN predicted p USING (odiNumber) WHERE pos = 1")
def backend_agreement(spark, sf):
    b = _ruled(spark, sf)
    a = b.select("odiNumber", F.col("pred").alias("predicted_label"), "top_k")
    return scoring.compare_backends(a, b, "odiNumber")[0].select("odiNumber", "agree")


@query(
    "report_rows",
    f"""WITH {RANKED_SQL} SELECT p.summary AS text, max(label) FILTER (WHERE pos = 1) AS predicted_label, round(max(o.p) FILTER (WHERE pos = 1), 4) AS confidence,
  max(label) FILTER (WHERE pos = 2) AS top_2, round(max(o.p) FILTER (WHERE pos = 2), 4) AS top_2_confidence,
  string_agg(label, ', ' ORDER BY pos) FILTER (WHERE pos <= 3) AS top_terms FROM ordered o JOIN predicted p USING (odiNumber) GROUP BY odiNumber, p.summary""",
)
def report_rows(spark, sf):
    terms = F.transform("top_k", lambda t: F.struct(t["label"].alias("term"), t["confidence"].alias("contribution")))
    return scoring.report_rows(_ruled(spark, sf).withColumn("explanation", terms))


@query(
    "example_report",
    f"""WITH {RANKED_SQL}, x AS (SELECT odiNumber, "true" AS true_label, label AS predicted_label, label = "true" AS correct FROM ordered JOIN predicted USING (odiNumber)
  WHERE pos = 1 ORDER BY md5(odiNumber::VARCHAR || '|42'), odiNumber LIMIT 10)
SELECT *, round(avg(correct::INT) OVER ()::DOUBLE, 10) AS sample_accuracy FROM x""",
)
def example_report(spark, sf):
    d = scoring.example_report(_ruled(spark, sf), 10, "odiNumber", "true")
    return rounded(d.select("odiNumber", "true_label", "predicted_label", "correct", "sample_accuracy"), "sample_accuracy")


# ---------------------------------------------------------------- exploration

@query("distinct_labels", "SELECT count(DISTINCT p_type) AS n_distinct FROM part")
def distinct_labels(spark, sf):
    return explore.distinct_count(table(spark, sf, "part"), "p_type")


@query("label_value_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def label_value_counts(spark, sf):
    return explore.value_counts(table(spark, sf, "part"), "p_brand")


@query("top_ten_makes", "SELECT upper(p_brand) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_ten_makes(spark, sf):
    return explore.value_counts(table(spark, sf, "part"), F.upper("p_brand"), 10)


@query(
    "extreme_classes",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT (SELECT event_type FROM c ORDER BY n DESC, event_type LIMIT 1) AS most_frequent, max(n) AS most_rows,
  (SELECT event_type FROM c ORDER BY n, event_type LIMIT 1) AS least_frequent, min(n) AS least_rows FROM c""",
)
def extreme_classes(spark, sf):
    return explore.extreme_classes(table(spark, sf, "events"), "event_type")
