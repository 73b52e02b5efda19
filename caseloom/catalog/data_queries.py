"""Sources and sinks, quality gates, cleaning, labels, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.catalog.base import (
    CLEANED_SQL,
    LABELLED_SQL,
    MIN_ROWS,
    PREDICTED_SQL,
    REPORTS_SQL,
    SPLIT_SQL,
    TAG_SET_SQL,
    cleaned,
    labelled,
    order_sql,
    predictions,
    query,
    quota_sql,
    reports,
    split_reports,
    table,
    ws,
)
from caseloom.functions import records
from caseloom.operators import asof, cleaning, labels, quality, splits
from caseloom.operators.quality import REQUIRED_COLUMNS
from caseloom.session import work_path
from caseloom.sources import reports as report_files
from caseloom.sources import tables

# ---------------------------------------------------------------- sources and sinks

TYPED_SQL = """SELECT doc_id AS "odiNumber", 'Maker, "' || source || '"' AS manufacturer, doc_id % 7 = 0 AS crash,
  CASE WHEN doc_id % 11 <> 0 THEN doc_id % 5 = 0 END AS fire, doc_id % 4 AS "numberOfInjuries",
  CASE WHEN doc_id % 10 <> 0 THEN doc_id % 2 END AS "numberOfDeaths",
  DATE '2019-01-01' + (doc_id % 900)::INT AS "dateOfIncident", DATE '2019-03-01' + (doc_id % 2100)::INT AS "dateComplaintFiled",
  CASE WHEN doc_id % 50 <> 0 THEN 'VIN' || doc_id END AS vin, upper(lang) AS components, text AS summary,
  '[{"type": "' || source || '"}]' AS products, source AS make, lang AS model,
  CASE WHEN doc_id <> 1 THEN 1990 + doc_id % 35 END AS "modelYear" FROM documents"""


def _typed(spark, sf) -> DataFrame:
    """The documents in the fifteen columns of a report file."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        k.alias("odiNumber"),
        F.concat(F.lit('Maker, "'), "source", F.lit('"')).alias("manufacturer"),
        (k % 7 == 0).alias("crash"),
        F.when(k % 11 != 0, k % 5 == 0).alias("fire"),
        (k % 4).alias("numberOfInjuries"),
        F.when(k % 10 != 0, k % 2).alias("numberOfDeaths"),
        F.date_add(F.lit("2019-01-01").cast("date"), (k % 900).cast("int")).alias("dateOfIncident"),
        F.date_add(F.lit("2019-03-01").cast("date"), (k % 2100).cast("int")).alias("dateComplaintFiled"),
        F.when(k % 50 != 0, F.concat(F.lit("VIN"), k.cast("string"))).alias("vin"),
        F.upper("lang").alias("components"),
        F.col("text").alias("summary"),
        F.concat(F.lit('[{"type": "'), "source", F.lit('"}]')).alias("products"),
        F.col("source").alias("make"),
        F.col("lang").alias("model"),
        F.when(k != 1, 1990 + k % 35).alias("modelYear"),
    )


@query("csv_typed_scan", TYPED_SQL)
def csv_typed_scan(spark, sf):
    """Write the reports as CSV and read them back through the typed, validated scan."""
    path = work_path(spark, "reports-csv")
    report_files.write_reports_csv(_typed(spark, sf), path)
    return report_files.load_reports(spark, path)


@query("csv_split_scan", TYPED_SQL)
def csv_split_scan(spark, sf):
    """Files with line breaks in their fields, one for each task that reads the table, read in byte blocks by several tasks a file."""
    path, blocks = work_path(spark, "split-csv"), "spark.sql.files.maxPartitionBytes"
    report_files.write_reports_csv(_typed(spark, sf), path)
    size = spark.read.format("binaryFile").load(f"{path}/*.csv").agg(F.max("length")).first()[0]
    before = spark.conf.get(blocks)
    spark.conf.set(blocks, str(max(size // 8, 1)))
    try:
        return report_files.load_reports(spark, path)
    finally:
        spark.conf.set(blocks, before)


@query("csv_mixed_headers", TYPED_SQL)
def csv_mixed_headers(spark, sf):
    """Files with columns in different orders in one folder, each read by its own header."""
    path = work_path(spark, "mixed-csv")
    typed = _typed(spark, sf)
    for k, names in enumerate((typed.columns, typed.columns[::-1], sorted(typed.columns))):
        report_files.write_reports_csv(typed.filter(F.col("odiNumber") % 3 == k).select(*names), f"{path}/part{k}")
    return report_files.load_reports(spark, f"{path}/*/*.csv").select(*typed.columns)


@query(
    "csv_malformed_audit",
    "SELECT CASE WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN 'damaged' ELSE 'sound' END AS state, count(*) AS n, "
    "sum(length(CASE WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN '' ELSE text END))::BIGINT AS n_chars FROM documents GROUP BY 1",
)
def csv_malformed_audit(spark, sf):
    """Numbers and dates that cannot be read send a row to the damaged side, with its text."""
    path = work_path(spark, "damaged-csv")
    key = F.col("odiNumber")
    damaged = (
        _typed(spark, sf)
        .withColumn("modelYear", F.when(key % 9 == 0, F.lit("unknown")).otherwise(F.col("modelYear").cast("string")))
        .withColumn("dateOfIncident", F.when(key % 13 == 0, F.lit("13/40/2020")).otherwise(F.date_format("dateOfIncident", "MM/dd/yyyy")))
    )
    report_files.write_reports_csv(damaged, path)
    sound, bad = report_files.audit_malformed(spark, path)
    both = sound.select(F.lit("sound").alias("state"), F.length("summary").alias("c")).unionByName(
        bad.select(F.lit("damaged").alias("state"), F.lit(0).alias("c"))
    )
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("n_chars"))


@query("parquet_pruned_scan", "SELECT doc_id, lang FROM documents")
def parquet_pruned_scan(spark, sf):
    return report_files.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


@query("split_table_round_trip", f"WITH {SPLIT_SQL} SELECT split, primary_component, count(*) AS n FROM split_reports GROUP BY ALL")
def split_table_round_trip(spark, sf):
    """Write the split table partitioned by split, load it checked, count it."""
    path = work_path(spark, "splits")
    tables.write_splits(split_reports(spark, sf), path)
    return tables.load_splits(spark, path).groupBy("split", "primary_component").agg(F.count(F.lit(1)).alias("n"))


@query("taxonomy_round_trip", f"WITH {LABELLED_SQL}, applied AS (SELECT odiNumber, primary_component FROM labelled) SELECT * FROM applied")
def taxonomy_round_trip(spark, sf):
    """Write the taxonomy as JSON, read it back and apply it."""
    path = work_path(spark, "taxonomy")
    tables.write_taxonomy(labels.build_taxonomy(cleaned(spark, sf), min_rows=MIN_ROWS), path)
    done, _ = labels.engineer_labels(cleaned(spark, sf), tables.load_taxonomy(spark, path))
    return done.select("odiNumber", "primary_component")


@query("prediction_log_round_trip", f'WITH {PREDICTED_SQL} SELECT substr(summary, 1, 200) AS text_preview, pred AS predicted_label, list_max(probability) AS confidence, \'rules\' AS model_backend, 0.5::DOUBLE AS latency_ms FROM predicted')
def prediction_log_round_trip(spark, sf):
    """Append prediction records to a JSON log and read it back."""
    path = work_path(spark, "log")
    scored = predictions(spark, sf).select(
        "summary", F.col("pred").alias("predicted_label"), F.array_max("probability").alias("confidence"), F.lit("rules").alias("model_backend")
    )
    tables.append_log(tables.log_rows(scored, latency_ms=F.lit(0.5)), path)
    return tables.read_log(spark, path).drop("timestamp")


LINES_SQL = f"""SELECT trim(line, {ws()}) AS text, count(*) AS n FROM
  (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, {ws()}) <> '' GROUP BY 1"""


@query("batch_lines_input", LINES_SQL)
def batch_lines_input(spark, sf):
    """Texts given one per line: every line of every document, blank ones dropped."""
    path = work_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.mode("overwrite").text(path)
    return report_files.read_batch_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("batch_csv_input", "SELECT text FROM documents WHERE doc_id % 6 <> 0")
def batch_csv_input(spark, sf):
    """The chosen text column of a CSV with other columns, nulls dropped."""
    path = work_path(spark, "batch-csv")
    d = table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("complaint"))
    report_files.write_reports_csv(d, path)
    return report_files.read_batch_csv(spark, path, "complaint")


@query("results_csv_export", f'WITH {PREDICTED_SQL} SELECT odiNumber, pred, summary FROM predicted')
def results_csv_export(spark, sf):
    path = work_path(spark, "results-csv")
    report_files.write_results_csv(predictions(spark, sf).select("odiNumber", "pred", "summary"), path)
    options = {k: v for k, v in report_files.CSV_OPTIONS.items() if k != "dateFormat"}
    return spark.read.schema("odiNumber long, pred string, summary string").options(**options).csv(path)


RUN_SQL = f"""WITH {PREDICTED_SQL}, c AS (SELECT "true", pred, count(*) AS n FROM predicted GROUP BY ALL)
SELECT '20240202T000000Z' AS run_id, "true", pred, n FROM c"""


@query("latest_run_confusion", RUN_SQL)
def latest_run_confusion(spark, sf):
    """Append three runs, one of another family, and read the newest of the first family."""
    path = work_path(spark, "runs")
    p = predictions(spark, sf)
    worse = p.withColumn("pred", F.lit("EN"))
    from caseloom.operators.evaluation import compute_metrics
    from caseloom.plans.training import long_metrics

    for rows, run_id, family in ((worse, "20240101T000000Z", "baseline"), (p, "20240202T000000Z", "baseline"), (worse, "20240303T000000Z", "transformer")):
        tables.write_run(rows, long_metrics(compute_metrics(rows), "test"), path, run_id, family)
    return tables.latest_run(spark, path, "run_confusion").select("run_id", "true", "pred", "n")


# ---------------------------------------------------------------- quality gates

@query(
    "schema_gate",
    "SELECT unnest(['missing columns', 'zero rows', 'surplus keys']) AS \"check\", "
    "unnest([13, 0, (SELECT count(*) - count(DISTINCT summary) FROM (SELECT text AS summary FROM documents))]) AS violations",
)
def schema_gate(spark, sf):
    """The three schema checks on the documents, with the text as the claimed key."""
    d = table(spark, sf, "documents").select(F.col("text").alias("summary"), F.col("lang").alias("components"))
    return quality.gate_report(d, "summary")


@query("key_surplus", "SELECT (count(*) - count(DISTINCT user_id))::BIGINT AS surplus FROM events")
def key_surplus(spark, sf):
    return quality.surplus_rows(table(spark, sf, "events"), "user_id")


REJECT_SQL = f"""SELECT odiNumber, CASE WHEN summary IS NULL OR length(trim(summary, {ws()})) = 0 THEN 'empty'
  WHEN length(trim(summary, {ws()})) < 5 THEN 'too short' WHEN length(trim(summary, {ws()})) > 10000 THEN 'too long' END AS reject_reason
  FROM (SELECT doc_id AS odiNumber, CASE doc_id % 40 WHEN 0 THEN '     ' WHEN 1 THEN NULL WHEN 2 THEN ' hi ' ELSE text END AS summary FROM documents)"""


@query("scoring_input_routes", REJECT_SQL)
def scoring_input_routes(spark, sf):
    """Every text with the reason it cannot be scored, or none."""
    k = F.col("odiNumber") % 40
    marked = reports(spark, sf).withColumn(
        "summary", F.when(k == 0, "     ").when(k == 1, F.lit(None)).when(k == 2, " hi ").otherwise(F.col("summary"))
    )
    good, rejected = quality.route_scoring_input(marked)
    return good.select("odiNumber", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("odiNumber", "reject_reason"))


LEAK_SQL = """WITH s AS (SELECT text, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM documents),
f AS (SELECT text, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM s WHERE text IS NOT NULL GROUP BY text)
SELECT 'train' AS split_a, 'val' AS split_b, count(*) FILTER (WHERE a AND b) AS shared_texts FROM f
UNION ALL SELECT 'train', 'test', count(*) FILTER (WHERE a AND c) FROM f
UNION ALL SELECT 'val', 'test', count(*) FILTER (WHERE b AND c) FROM f"""


@query("text_leakage_pairs", LEAK_SQL)
def text_leakage_pairs(spark, sf):
    """Texts shared between parts when the documents are split without deduplication."""
    k = F.col("odiNumber") % 5
    marked = reports(spark, sf).withColumn("split", F.when(k == 0, "test").when(k == 1, "val").otherwise("train"))
    return quality.leakage_pairs(marked)


@query("text_leakage_after_split", "SELECT unnest(['train', 'train', 'val']) AS split_a, unnest(['val', 'test', 'test']) AS split_b, 0::BIGINT AS shared_texts")
def text_leakage_after_split(spark, sf):
    """The same check on the real splits finds nothing."""
    return quality.leakage_pairs(split_reports(spark, sf))


@query("row_agreement", "SELECT count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS left_only, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS right_only FROM documents d LEFT JOIN labels l USING (doc_id)")
def row_agreement(spark, sf):
    return quality.row_agreement(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "null_counts",
    f"SELECT unnest([{', '.join(repr(c) for c in REQUIRED_COLUMNS)}]) AS column_name, "
    f"unnest([{', '.join(f'count(*) - count({chr(34)}{c}{chr(34)})' for c in REQUIRED_COLUMNS)}]) AS n_null FROM ({TYPED_SQL})",
)
def null_counts(spark, sf):
    return quality.null_counts(_typed(spark, sf))


def _summary_sql(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c})::DOUBLE, 8) AS mean, round(stddev_samp({c})::DOUBLE, 8) AS sd, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM orders"
        for c in names
    )


@query("numeric_summary", _summary_sql(["o_orderkey", "o_custkey", "o_totalprice"]))
def numeric_summary(spark, sf):
    return quality.numeric_summary(table(spark, sf, "orders")).withColumn("mean", F.round("mean", 8)).withColumn("sd", F.round("sd", 8))


@query(
    "column_info",
    "SELECT unnest([0, 1, 2, 3, 4]::BIGINT[]) AS position, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name, "
    "unnest(['bigint', 'string', 'string', 'string', 'bigint']) AS type, unnest([count(doc_id), count(text), count(lang), count(source), count(n_chars)]) AS n_present FROM documents",
)
def column_info(spark, sf):
    return quality.column_info(table(spark, sf, "documents"))


AUDIT_SQL = f"""WITH {REPORTS_SQL}, r AS (SELECT *, CASE WHEN odiNumber % 50 <> 0 THEN 'v' END AS vin FROM reports),
p AS (SELECT summary, components, count(*) AS n FROM r WHERE summary IS NOT NULL AND components IS NOT NULL GROUP BY ALL),
t AS (SELECT summary, count(DISTINCT components) AS k FROM r WHERE summary IS NOT NULL GROUP BY summary)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE summary IS NULL) AS null_texts,
  count(*) FILTER (WHERE length(trim(summary, {ws()})) < 10) AS short_texts,
  round(avg((vin IS NULL)::INT)::DOUBLE, 10) AS missing_vin_share,
  (SELECT sum(n - 1)::BIGINT FROM p) AS repeated_pairs, (SELECT count(*) FROM t WHERE k > 1) AS texts_with_several_labels FROM r"""


@query("cleaning_audit", AUDIT_SQL)
def cleaning_audit(spark, sf):
    vin = F.when(F.col("odiNumber") % 50 != 0, "v")
    return quality.cleaning_audit(reports(spark, sf).withColumn("vin", vin), vin="vin").withColumn("missing_vin_share", F.round("missing_vin_share", 10))


@query(
    "label_audit",
    f"WITH {LABELLED_SQL} SELECT count(DISTINCT primary_component) AS n_classes, round(avg((len({TAG_SET_SQL}) > 1)::INT)::DOUBLE, 10) AS multi_tag_share, "
    "count(*) FILTER (WHERE primary_component = 'OTHER') AS folded_rows FROM labelled",
)
def label_audit(spark, sf):
    return quality.label_audit(labelled(spark, sf)).withColumn("multi_tag_share", F.round("multi_tag_share", 10))


# ---------------------------------------------------------------- cleaning

@query("clean_reports", f"WITH {CLEANED_SQL} SELECT odiNumber, summary, components FROM cleaned")
def clean_reports(spark, sf):
    """Filter and keep the first report of every exact text."""
    return cleaning.clean_reports(reports(spark, sf)).select("odiNumber", "summary", "components")


COUNTS_SQL = f"""WITH {CLEANED_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE summary IS NULL) AS null_text,
  count(*) FILTER (WHERE length(trim(summary, {ws()})) < 10) AS short_text, 0::BIGINT AS null_tags,
  count(*) FILTER (WHERE length(trim(summary, {ws()})) >= 10) - (SELECT count(*) FROM cleaned) AS repeats,
  (SELECT count(*) FROM cleaned) AS kept FROM reports"""


@query("cleaning_counts", COUNTS_SQL)
def cleaning_counts(spark, sf):
    return cleaning.cleaning_counts(reports(spark, sf))


@query(
    "orders_by_year_cut",
    "SELECT CASE WHEN year(d) <= 1999 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM "
    "(SELECT CASE WHEN o_orderkey % 20 <> 0 THEN o_orderdate END AS d, o_totalprice FROM orders) WHERE d IS NOT NULL GROUP BY 1",
)
def orders_by_year_cut(spark, sf):
    """Year filters on both sides of a cut; a missing date is on neither side."""
    d = table(spark, sf, "orders").withColumn("d", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderdate")))
    sides = [
        part(d, "d", 1999).groupBy(F.lit(name).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        for name, part in (("train", cleaning.filed_until), ("test", cleaning.filed_after))
    ]
    return reduce(DataFrame.unionByName, sides)


@query(
    "time_split",
    "SELECT o_orderkey, CASE WHEN year(d) <= 1999 THEN 'train' WHEN year(d) > 1999 THEN 'test' END AS time_split FROM "
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 20 <> 0 THEN o_orderdate END AS d FROM orders)",
)
def time_split(spark, sf):
    d = table(spark, sf, "orders").withColumn("d", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderdate")))
    return splits.time_split(d, "d", 1999).select("o_orderkey", "time_split")


# ---------------------------------------------------------------- labels

@query("label_shares", f"WITH {LABELLED_SQL} SELECT primary_component, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 10) AS share FROM labelled GROUP BY 1")
def label_shares(spark, sf):
    """Share of every kept label after cleaning."""
    done, _ = labels.engineer_labels(cleaning.clean_reports(reports(spark, sf)), min_rows=MIN_ROWS)
    sizes = splits.class_sizes(done, "primary_component")
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("share", F.round(F.col("n") / total, 10))


@query("first_tags", f"WITH {REPORTS_SQL} SELECT odiNumber, trim(split_part(components, ',', 1), {ws()}) AS tag FROM reports")
def first_tags(spark, sf):
    return reports(spark, sf).select("odiNumber", records.first_tag("components").alias("tag"))


@query("label_taxonomy", f"WITH {LABELLED_SQL} SELECT label FROM taxonomy")
def label_taxonomy(spark, sf):
    return labels.build_taxonomy(cleaned(spark, sf), min_rows=MIN_ROWS)


@query("engineered_labels", f"WITH {LABELLED_SQL} SELECT odiNumber, primary_component FROM labelled")
def engineered_labels(spark, sf):
    return labelled(spark, sf).select("odiNumber", "primary_component")


@query("labels_by_given_taxonomy", f"WITH {REPORTS_SQL} SELECT odiNumber, CASE WHEN lang IN ('en', 'de') THEN upper(lang) ELSE 'OTHER' END AS primary_component FROM reports")
def labels_by_given_taxonomy(spark, sf):
    """A taxonomy from elsewhere: tags it does not know fold into the rest class."""
    given = table(spark, sf, "documents").filter(F.col("lang").isin("en", "de")).select(F.upper("lang").alias("label")).distinct()
    return labels.engineer_labels(reports(spark, sf), given)[0].select("odiNumber", "primary_component")


TOP_SQL = "SELECT p_type AS label, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 3"


@query("labels_grouped_to_top", f"SELECT p_partkey, coalesce(label, 'Other') AS label_grouped FROM part LEFT JOIN ({TOP_SQL}) ON p_type = label")
def labels_grouped_to_top(spark, sf):
    return labels.group_to_top(table(spark, sf, "part"), "p_type", 3).select("p_partkey", "label_grouped")


@query("rows_of_top_labels", f"SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT label FROM ({TOP_SQL}))")
def rows_of_top_labels(spark, sf):
    return labels.rows_of_top(table(spark, sf, "part"), "p_type", 3).select("p_partkey", "p_type")


@query("label_space", f"WITH {SPLIT_SQL} SELECT primary_component AS label, row_number() OVER (ORDER BY primary_component) - 1 AS idx FROM (SELECT DISTINCT primary_component FROM split_reports WHERE split = 'train')")
def label_space(spark, sf):
    return labels.label_space(split_reports(spark, sf).filter("split = 'train'"))


@query("labels_indexed", f"WITH {LABELLED_SQL} SELECT odiNumber, (dense_rank() OVER (ORDER BY primary_component) - 1)::DOUBLE AS label_idx, primary_component AS name FROM labelled")
def labels_indexed(spark, sf):
    """Label to index and back."""
    d = labelled(spark, sf)
    space = labels.label_space(d)
    indexed = labels.index_labels(d, space)
    return labels.labels_from_index(indexed, space, "label_idx", "name").select("odiNumber", "label_idx", "name")


@query("tag_sets", f"WITH {REPORTS_SQL} SELECT odiNumber, array_to_string(list_sort({TAG_SET_SQL}), '|') AS tags, len({TAG_SET_SQL})::BIGINT AS n_tags FROM reports")
def tag_sets(spark, sf):
    tags = records.tag_set("components")
    return reports(spark, sf).select("odiNumber", F.array_join(F.sort_array(tags), "|").alias("tags"), F.size(tags).cast("long").alias("n_tags"))


@query(
    "labels_one_hot",
    f"WITH {LABELLED_SQL}, i AS (SELECT odiNumber, dense_rank() OVER (ORDER BY primary_component) - 1 AS k FROM labelled) "
    "SELECT odiNumber, [CASE WHEN k = j THEN 1.0 ELSE 0.0 END::DOUBLE for j in range((SELECT max(k) + 1 FROM i))] AS one_hot FROM i",
)
def labels_one_hot(spark, sf):
    d = labelled(spark, sf)
    space = labels.label_space(d)
    return labels.index_labels(d, space).select("odiNumber", labels.one_hot("label_idx", space.count()).alias("one_hot"))


# ---------------------------------------------------------------- splits and samples

@query("stratified_split", f"WITH {SPLIT_SQL} SELECT odiNumber, primary_component, split FROM split_reports")
def stratified_split(spark, sf):
    return splits.stratified_split(labelled(spark, sf)).select("odiNumber", "primary_component", "split")


@query("split_quotas", f"WITH {LABELLED_SQL}, {quota_sql('labelled', 'primary_component', 0.15, 0.15)} SELECT * FROM quotas")
def split_quotas(spark, sf):
    return splits.split_quotas(splits.class_sizes(labelled(spark, sf), "primary_component"), "primary_component")


HOLDOUT_SQL = f"""WITH {quota_sql('events', 'event_type', 0.2, 0.0)},
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id')}) AS rn FROM events)
SELECT event_id, event_type, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS split FROM r JOIN quotas USING (event_type)"""


@query("stratified_holdout", HOLDOUT_SQL)
def stratified_holdout(spark, sf):
    return splits.holdout_split(table(spark, sf, "events"), "event_type", "event_id").select("event_id", "event_type", "split")


@query("random_holdout", f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {order_sql('event_id')}) <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM events")
def random_holdout(spark, sf):
    return splits.random_holdout(table(spark, sf, "events"), "event_id").select("event_id", "split")


def _subsample_sql(n: int) -> str:
    return f"""WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT *, sum(n) OVER () AS total FROM s),
a AS (SELECT *, n::DOUBLE / total * least(total, {n}) AS share FROM t),
b AS (SELECT *, least(total, {n}) - sum(floor(share)) OVER () AS spare FROM a),
q AS (SELECT event_type, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, event_type) <= spare THEN 1 ELSE 0 END AS take FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order_sql('event_id')}) AS rn FROM events)
SELECT event_id, event_type FROM r JOIN q USING (event_type) WHERE rn <= take"""


@query("stratified_subsample", _subsample_sql(777))
def stratified_subsample(spark, sf):
    return splits.stratified_subsample(table(spark, sf, "events"), 777, "event_type", "event_id").select("event_id", "event_type")


@query("seeded_sample", f"WITH {SPLIT_SQL} SELECT odiNumber, summary FROM split_reports WHERE split = 'test' ORDER BY {order_sql()} LIMIT 10")
def seeded_sample(spark, sf):
    """Ten seeded examples of the test split."""
    return splits.seeded_sample(split_reports(spark, sf).filter("split = 'test'"), 10).select("odiNumber", "summary")


DOWN_SQL = f"""WITH {LABELLED_SQL}, s AS (SELECT primary_component, count(*) AS n FROM labelled GROUP BY 1),
big AS (SELECT primary_component FROM s ORDER BY n DESC, primary_component LIMIT 1),
r AS (SELECT *, row_number() OVER (PARTITION BY primary_component ORDER BY {order_sql()}) AS rn FROM labelled)
SELECT odiNumber, primary_component FROM r
WHERE primary_component NOT IN (SELECT * FROM big) OR rn <= (SELECT min(n) FROM s)"""


@query("majority_downsampled", DOWN_SQL)
def majority_downsampled(spark, sf):
    return splits.downsample_majority(labelled(spark, sf), "primary_component", "odiNumber").select("odiNumber", "primary_component")


UP_SQL = f"""WITH {LABELLED_SQL}, s AS (SELECT primary_component, count(*) AS n, max(count(*)) OVER () AS top FROM labelled GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY primary_component ORDER BY {order_sql()}) AS rn FROM labelled),
c AS (SELECT odiNumber, primary_component, top // n + CASE WHEN rn <= top % n THEN 1 ELSE 0 END AS k FROM r JOIN s USING (primary_component))
SELECT odiNumber, primary_component, unnest(range(1, k + 1)) AS copy FROM c"""


@query("classes_upsampled", UP_SQL)
def classes_upsampled(spark, sf):
    return splits.upsample_classes(labelled(spark, sf), "primary_component", "odiNumber").select("odiNumber", "primary_component", "copy")


@query("rows_shuffled", f"WITH {CLEANED_SQL} SELECT odiNumber, row_number() OVER (ORDER BY {order_sql()}) AS place FROM cleaned")
def rows_shuffled(spark, sf):
    """All rows in seeded order, numbered by partition counts, without one global task."""
    ordered = splits.shuffled(cleaned(spark, sf).select("odiNumber"), "odiNumber")
    numbered = ordered.select("odiNumber", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    from pyspark.sql import Window

    settled = numbered.persist()
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settled.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", before.alias("start"))
    offset = F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)
    return settled.join(F.broadcast(starts), "p").select("odiNumber", (F.col("start") + offset + 1).alias("place"))


FOLD_SQL = f"""WITH {LABELLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY primary_component ORDER BY {order_sql()}) AS rn,
  count(*) OVER (PARTITION BY primary_component) AS n FROM labelled)
SELECT odiNumber, primary_component, (CASE WHEN rn <= n // 3 THEN 0 WHEN rn <= 2 * n // 3 THEN 1 ELSE 2 END)::BIGINT AS fold FROM r"""


@query("stratified_folds", FOLD_SQL)
def stratified_folds(spark, sf):
    d = splits.stratified_folds(labelled(spark, sf), "primary_component", "odiNumber")
    return d.select("odiNumber", "primary_component", F.col("fold").cast("long").alias("fold"))


# A third of the reports share one user, whose rows are many enough here to be cut into buckets.
HOT_ROWS = 200
FILED_SQL = "SELECT doc_id AS odiNumber, CASE WHEN doc_id % 3 = 0 THEN 8 ELSE doc_id % 160 END AS user_id, (DATE '2023-12-30' + (doc_id % 35)::INT)::TIMESTAMP AS filed FROM documents"


@query(
    "events_before_filing",
    f"""WITH filed AS ({FILED_SQL}), before AS (
  SELECT f.odiNumber, count(*) AS n, max(struct_pack(ts := e.ts, id := e.event_id)) AS last FROM filed f JOIN events e ON e.user_id = f.user_id AND e.ts < f.filed GROUP BY f.odiNumber)
SELECT f.odiNumber, f.user_id, e.event_id, e.event_type, coalesce(b.n, 0) AS n_before
FROM filed f LEFT JOIN before b USING (odiNumber) LEFT JOIN events e ON e.event_id = b.last.id""",
)
def events_before_filing(spark, sf):
    """The last event of a report's user strictly before the filing date, and how many there were; the hot user is split."""
    docs = table(spark, sf, "documents")
    user = F.when(F.col("doc_id") % 3 == 0, F.lit(8)).otherwise(F.col("doc_id") % 160).cast("long")
    filed = F.date_add(F.lit("2023-12-30").cast("date"), (F.col("doc_id") % 35).cast("int"))
    rows = docs.select(F.col("doc_id").alias("odiNumber"), user.alias("user_id"), filed.cast("timestamp").alias("filed"))
    found = asof.events_before(rows, table(spark, sf, "events"), "user_id", "filed", "ts", ["event_id", "event_type"], "event_id", split_rows=HOT_ROWS)
    return found.drop("filed")
