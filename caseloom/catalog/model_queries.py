"""Training, selection, scoring and explanation on the documents, language as label.

What a model predicts has no SQL twin, but what must hold of any model has: every row is
scored once, probabilities sum to one, explanations add up to the margin.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.catalog.base import SPLIT_SQL, once, query, reports, split_reports, table, ws
from caseloom.catalog.feature_queries import clean_split, train_rows
from caseloom.catalog.text_queries import _tokens
from caseloom.config import CLEAN_TEXT, LABEL
from caseloom.functions.text import classical_clean
from caseloom.operators import attribution, features, models, quality, scoring
from caseloom.operators.lemma import lemma_table, token_counts
from caseloom.plans import dataset, scoring as scoring_plan, training
from caseloom.session import work_path
from caseloom.sources import markers, tables
from caseloom.streaming import predlog

# Features, iterations, rounds, tree depth and layers are the defaults of the jobs.
OPTIONS = {"linear_svc": {"key": "odiNumber"}}
MARGIN = 0.1  # above the share of the commonest label of the same split

_MODELS: dict[tuple, tuple] = {}


def featurizer(spark, sf):
    place = (spark.sparkContext.applicationId, sf, "featurizer")
    if place not in _MODELS:
        _MODELS[place] = features.fit_word_tfidf(train_rows(spark, sf))
    return _MODELS[place]


def featurized(spark, sf) -> DataFrame:
    return once(spark, sf, "featurized", lambda: featurizer(spark, sf).transform(clean_split(spark, sf)).select("odiNumber", LABEL, "components", "split", "features"))


def trained(spark, sf, kind: str):
    place = (spark.sparkContext.applicationId, sf, kind)
    if place not in _MODELS:
        _MODELS[place] = models.MODELS[kind](featurized(spark, sf).filter("split = 'train'"), **OPTIONS.get(kind, {}))
    return _MODELS[place]


CHECKED_SQL = f"WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, count(*) AS n_sum_to_one, count(*) AS n_known_label, true AS above_floor FROM split_reports GROUP BY split"


def floors(rows: DataFrame) -> DataFrame:
    """Share of the commonest label of each split."""
    sizes = rows.groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("split").agg((F.max("n") / F.sum("n")).alias("floor"))


def checked(model, rows: DataFrame) -> DataFrame:
    """Per split: rows scored, probabilities that sum to 1, known labels, clearly better than the commonest label."""
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    found = model.predict(rows).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_to_one"),
        F.count_if(F.col("predicted_label").isin(*model.labels)).alias("n_known_label"),
        F.avg((F.col("predicted_label") == F.col(LABEL)).cast("double")).alias("right"),
    )
    above = F.col("right") >= F.col("floor") + MARGIN
    return found.join(floors(rows), "split").select("split", "n_rows", "n_sum_to_one", "n_known_label", above.alias("above_floor"))


@query("logistic_regression_scored", CHECKED_SQL)
def logistic_regression_scored(spark, sf):
    return checked(trained(spark, sf, "logistic_regression"), featurized(spark, sf))


@query("calibrated_svm_scored", CHECKED_SQL)
def calibrated_svm_scored(spark, sf):
    return checked(trained(spark, sf, "linear_svc"), featurized(spark, sf))


@query("boosted_trees_scored", CHECKED_SQL)
def boosted_trees_scored(spark, sf):
    return checked(trained(spark, sf, "xgboost"), featurized(spark, sf))


@query("model_round_trip", CHECKED_SQL.replace("true AS above_floor", "count(*) AS n_same"))
def model_round_trip(spark, sf):
    """A saved and loaded featurizer and model predict the same labels."""
    path = work_path(spark, "model")
    model, fitted = trained(spark, sf, "linear_svc"), featurizer(spark, sf)
    model.save(spark, f"{path}/model")
    fitted.write().overwrite().save(f"{path}/featurizer")
    from pyspark.ml import PipelineModel

    again = models.load_model(spark, f"{path}/model")
    rows = PipelineModel.load(f"{path}/featurizer").transform(clean_split(spark, sf))
    before = model.predict(featurized(spark, sf)).select("odiNumber", F.col("predicted_label").alias("before"))
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    return again.predict(rows).join(before, "odiNumber").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_to_one"),
        F.count_if(F.col("predicted_label").isin(*model.labels)).alias("n_known_label"),
        F.count_if(F.col("predicted_label") == F.col("before")).alias("n_same"),
    )


@query("coefficient_table", f"WITH {SPLIT_SQL} SELECT primary_component AS label, true AS each_once, true AS none_zero, true AS all_named FROM split_reports WHERE split = 'train' GROUP BY primary_component")
def coefficient_table(spark, sf):
    """Fold-averaged coefficients of the calibrated SVM with their terms: each class has each term at most once."""
    coefs = models.coefficient_table(spark, trained(spark, sf, "linear_svc"))
    named = coefs.join(features.feature_table(spark, featurizer(spark, sf)), "idx", "left")
    return named.groupBy("label").agg(
        (F.count(F.lit(1)) == F.countDistinct("idx")).alias("each_once"),
        (F.count_if((F.col("coef") == 0) | F.isnan("coef")) == 0).alias("none_zero"),
        (F.count_if(F.isnull("term")) == 0).alias("all_named"),
    )


@query("fold_average_coefficients", f"WITH {SPLIT_SQL} SELECT DISTINCT primary_component AS label, 0::BIGINT AS n_off FROM split_reports WHERE split = 'train'")
def fold_average_coefficients(spark, sf):
    """Averaging the folds' own coefficients gives the coefficients that explanations use."""
    model = trained(spark, sf, "linear_svc")
    width = len(features.feature_names(featurizer(spark, sf)))
    rows = [(fold, label, coefs.tolist()) for fold, parts in enumerate(model.coefs) for label, coefs in zip(model.labels, parts)]
    folds = spark.createDataFrame(rows, "fold int, label string, c array<double>").select("fold", "label", F.posexplode("c").alias("idx", "coef"))
    averaged = models.average_fold_coefficients(folds.withColumn("idx", F.col("idx").cast("long"))).withColumnRenamed("coef", "averaged")
    both = averaged.join(models.coefficient_table(spark, model), ["label", "idx"], "left")
    off = (F.abs(F.col("averaged") - F.coalesce("coef", F.lit(0.0))) > 1e-9) | (F.col("idx") >= width)
    return both.groupBy("label").agg(F.count_if(off).alias("n_off"))


@query("explanations_add_up", f"WITH {SPLIT_SQL} SELECT count(*) AS n_rows, count(*) AS n_add_up FROM split_reports")
def explanations_add_up(spark, sf):
    """Contributions of all terms plus the intercept give the predicted label's margin."""
    model = trained(spark, sf, "logistic_regression")
    rows = model.predict(featurized(spark, sf))
    _, intercepts = model.linear_parts()
    names = F.array(*[F.lit(x) for x in model.labels])
    place = F.array_position(names, F.col("predicted_label")).cast("int")
    margins = models.add_margins(rows, model.linear_parts(), "_raw").select(
        "odiNumber", (F.element_at("_raw", place) - F.element_at(F.array(*[F.lit(float(b)) for b in intercepts]), place)).alias("margin")
    )
    sums = scoring.term_contributions(rows, featurizer(spark, sf), model, "odiNumber").groupBy("odiNumber").agg(F.sum("contribution").alias("total"))
    both = margins.join(sums, "odiNumber", "left")
    gap = F.abs(F.coalesce("total", F.lit(0.0)) - F.col("margin"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gap < 1e-8).alias("n_add_up"))


@query("scored_records", f"WITH {SPLIT_SQL} SELECT odiNumber, 3::BIGINT AS n_alternatives, true AS label_is_first, true AS descending, true AS terms_ordered FROM split_reports")
def scored_records(spark, sf):
    """Full records for every row: alternatives ranked, label first, terms in order."""
    scored = scoring.score_records(clean_split(spark, sf), featurizer(spark, sf), trained(spark, sf, "linear_svc"))
    c = F.transform("top_k", lambda t: t["confidence"])
    e = F.transform("explanation", lambda t: t["contribution"])
    return scored.select(
        "odiNumber",
        F.size("top_k").cast("long").alias("n_alternatives"),
        (F.get("top_k", 0)["label"] == F.col("predicted_label")).alias("label_is_first"),
        (c == F.sort_array(c, asc=False)).alias("descending"),
        ((e == F.sort_array(e, asc=False)) & (F.size(e) <= 10)).alias("terms_ordered"),
    )


@query("tree_explanations_add_up", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, count(*) AS n_add_up, true AS terms_ordered FROM split_reports GROUP BY split")
def tree_explanations_add_up(spark, sf):
    """Contributions of terms to a boosted score, all of them, add up to it with the score of no term; records hold the largest."""
    model, fitted = trained(spark, sf, "xgboost"), featurizer(spark, sf)
    rows = model.predict(featurized(spark, sf))
    k = len(model.labels)
    bases = [attribution.paths_of(attribution.class_forest(model.forest, c, k)).base for c in range(k)]
    names = F.array(*[F.lit(x) for x in model.labels])
    place = F.array_position(names, F.col("predicted_label")).cast("int")
    margins = models.add_scores(rows, "_m", k, models.boosted_margins, (model.forest, model.width, k)).select(
        "odiNumber", "split", (F.element_at("_m", place) - F.element_at(F.array(*[F.lit(float(b)) for b in bases]), place)).alias("margin")
    )
    every = scoring.with_explanation(rows, fitted, model, top=1 << 30).select("odiNumber", F.transform("explanation", lambda t: t["contribution"]).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, v: a + v)
    # contributions are rounded to four digits
    close = F.abs(total - F.col("margin")) <= 1e-4 * (F.size("c") + 1)
    return margins.join(every, "odiNumber").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(close).alias("n_add_up"), F.every(F.col("c") == F.sort_array("c", asc=False)).alias("terms_ordered")
    )


@query("scored_explanations", f"WITH {SPLIT_SQL} SELECT odiNumber, true AS leading_terms, true AS none_lost FROM split_reports")
def scored_explanations(spark, sf):
    """The terms of a record are the ten largest contributions; supporting and opposing ones together are all of them."""
    fitted, model = featurizer(spark, sf), trained(spark, sf, "logistic_regression")
    scored = scoring.signed_terms(scoring.score_records(clean_split(spark, sf), fitted, model))
    parts = scoring.term_contributions(model.predict(featurized(spark, sf)), fitted, model, "odiNumber").groupBy("odiNumber").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list("contribution"))), 1, 10).alias("best")
    )
    given = F.transform("explanation", lambda t: t["contribution"])
    best = F.coalesce("best", F.array().cast("array<double>"))
    same = (F.size(given) == F.size(best)) & F.forall(F.zip_with(given, best, lambda a, b: F.abs(a - b) < 1e-4), lambda x: x)
    nonzero = F.size(F.filter(given, lambda x: x != 0))
    return scored.join(parts, "odiNumber", "left").select(
        "odiNumber", same.alias("leading_terms"), (F.size("supporting") + F.size("opposing") >= nonzero).alias("none_lost")
    )


BAKE_SQL = f"""WITH {SPLIT_SQL} SELECT f || '__' || m AS combo, (SELECT count(*) FROM split_reports WHERE split = 'train') AS n_train, true AS above_floor, true AS f1_above_rule
FROM (SELECT unnest(['word_tfidf', 'word_char_tfidf']) AS f), (SELECT unnest(['logistic_regression', 'linear_svc', 'xgboost']) AS m)"""


@query("bake_off", BAKE_SQL)
def bake_off(spark, sf):
    """Two featurizers and three models; each clearly beats the commonest label in accuracy, and a half in macro F1."""
    experiments, _ = training.bake_off(spark, clean_split(spark, sf), "catalog", model_options=OPTIONS)
    floor = floors(featurized(spark, sf)).filter("split = 'val'").first()["floor"]
    return experiments.select("combo", "n_train", (F.col("accuracy") >= floor + MARGIN).alias("above_floor"), (F.col("macro_f1") > 0.5).alias("f1_above_rule"))


@query("winner_selected", "SELECT lang AS combo, round(avg((doc_id % 5 = 0)::INT)::DOUBLE, 10) AS macro_f1, min(doc_id) AS position FROM documents GROUP BY lang ORDER BY macro_f1 DESC, position LIMIT 1")
def winner_selected(spark, sf):
    """Best macro F1, the earlier combination on a tie; each language stands for a combination."""
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("combo")).agg(
        F.round(F.avg((F.col("doc_id") % 5 == 0).cast("double")), 10).alias("macro_f1"), F.min("doc_id").alias("position")
    )
    return training.select_best(rows)


JOB_SQL = f"""WITH {SPLIT_SQL}, good AS (SELECT * FROM documents WHERE length(trim(text, {ws()})) BETWEEN 5 AND 10000)
SELECT 'train' AS state, (SELECT count(*) FROM split_reports WHERE split = 'train') AS n UNION ALL
SELECT 'val', (SELECT count(*) FROM split_reports WHERE split = 'val') UNION ALL
SELECT 'test', (SELECT count(*) FROM split_reports WHERE split = 'test') UNION ALL
SELECT 'scored', (SELECT count(*) FROM good) UNION ALL SELECT 'logged', (SELECT count(*) FROM good) UNION ALL
SELECT 'rejected', (SELECT count(*) FROM documents) - (SELECT count(*) FROM good)"""


@query("whole_job", JOB_SQL)
def whole_job(spark, sf):
    """Build the dataset, train, promote, score every document, log: rows at each stage."""
    out = work_path(spark, "job")
    raw = reports(spark, sf).withColumn("dateComplaintFiled", F.date_add(F.lit("2022-06-01").cast("date"), (F.col("odiNumber") % 900).cast("int")))
    built = dataset.run_dataset_build(raw, f"{out}/data", min_rows=110)
    training.run_training(
        spark, built.splits, out, spark.read.parquet(built.lemmas),
        featurizers={"word_tfidf": features.fit_word_tfidf}, models={"logistic_regression": models.train_logistic},
        model_options=OPTIONS,
    )
    scored, rejected = scoring_plan.run_scoring(spark, reports(spark, sf), out, f"{out}/log")
    states = [
        tables.load_splits(spark, built.splits).select(F.col("split").alias("state")),
        scored.select(F.lit("scored").alias("state")),
        rejected.select(F.lit("rejected").alias("state")),
        tables.read_log(spark, f"{out}/log").select("timestamp").select(F.lit("logged").alias("state")),
    ]
    from functools import reduce

    return reduce(DataFrame.unionByName, states).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("promotion_gate", "SELECT unnest([1, 2, 3]) AS run_id, unnest([true, false, true]) AS promoted, unnest([1, 1, 3]) AS serving FROM (SELECT count(*) FROM documents)")
def promotion_gate(spark, sf):
    """Full runs are promoted, subsample runs only if forced; the pointer names what is served after each run."""
    path = work_path(spark, "promotions")
    fitted, model = featurizer(spark, sf), trained(spark, sf, "logistic_regression")
    rows = []
    for n, full, force in ((1, True, False), (2, False, False), (3, False, True)):
        promoted = tables.promote(spark, path, str(n), fitted, "word_tfidf", model, None, full, force)
        rows.append((n, promoted, int(tables.current_model(spark, path)["run_id"])))
    return spark.createDataFrame(rows, "run_id int, promoted boolean, serving int")


TESTED_SQL = f"WITH {SPLIT_SQL} SELECT count(*) AS n_rows, count(DISTINCT odiNumber) AS n_keys, true AS above_floor FROM split_reports WHERE split = 'test'"


def tested(spark, sf, predicted: DataFrame) -> DataFrame:
    """Each test row once, clearly better than the commonest label."""
    floor = floors(featurized(spark, sf)).filter("split = 'test'").first()["floor"]
    right = F.avg((F.col("predicted_label") == F.col(LABEL)).cast("double"))
    return predicted.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("odiNumber").alias("n_keys"), (right >= floor + MARGIN).alias("above_floor"))


@query("plain_svm_scored", TESTED_SQL)
def plain_svm_scored(spark, sf):
    """The older uncalibrated one-vs-rest SVM: label of the largest margin."""
    members, labels = models.train_plain_svm(featurized(spark, sf).filter("split <> 'test'"), LABEL)
    margins = models.add_margins(featurized(spark, sf).filter("split = 'test'"), members, "probability")
    return tested(spark, sf, models.predict(margins, labels))


@query("dense_network_scored", TESTED_SQL)
def dense_network_scored(spark, sf):
    """The older dense network with its own layers, on the older feature block."""
    old = features.fit_legacy_tfidf(train_rows(spark, sf))
    rows = old.transform(clean_split(spark, sf)).select("odiNumber", LABEL, "split", "features")
    net = models.train_dense_network(rows.filter("split = 'train'"))
    return tested(spark, sf, net.predict(rows.filter("split = 'test'")))


def trained_job(spark, sf) -> str:
    """Folder of one training job on the split reports, shared by the queries that read its tables."""
    place = (spark.sparkContext.applicationId, sf, "job")
    if place not in _MODELS:
        out = work_path(spark, "trained")
        tables.write_splits(split_reports(spark, sf).withColumn(CLEAN_TEXT, classical_clean("summary")), f"{out}/splits")
        options = {"featurizers": {"word_tfidf": features.fit_word_tfidf}, "models": {"logistic_regression": models.train_logistic}}
        with ThreadPool(2) as pool:
            states = pool.map(lambda _: training.run_retrain(spark, f"{out}/splits", out, **options), range(2))
        _MODELS[place] = (out, states)
    return _MODELS[place]


@query("retrain_guard", "SELECT unnest(['started', 'already_running']) AS state, 1::BIGINT AS n_calls FROM (SELECT count(*) FROM documents)")
def retrain_guard(spark, sf):
    """Of two retrains started at once exactly one runs."""
    _, states = trained_job(spark, sf)
    return spark.createDataFrame([(s,) for s in states], "state string").groupBy("state").agg(F.count(F.lit(1)).alias("n_calls"))


BATCH_SQL = f"""SELECT batch, count(doc_id) AS n_rows, count(doc_id) > 0 AS accepted
FROM (SELECT unnest(['src0', 'src1', 'src2', 'none']) AS batch) b LEFT JOIN documents d ON d.source = b.batch GROUP BY batch"""


@query("batches_checked", BATCH_SQL)
def batches_checked(spark, sf):
    """A batch of texts to score is taken if it has a row; an empty one is refused before any model is read."""
    rows = []
    for batch in ("src0", "src1", "src2", "none"):
        texts = reports(spark, sf).filter(F.col("source") == batch)
        try:
            quality.assert_not_empty(texts)
            rows.append((batch, texts.count(), True))
        except quality.DataQualityError:
            rows.append((batch, 0, False))
    return spark.createDataFrame(rows, "batch string, n_rows long, accepted boolean")


@query("backend_chosen", f"SELECT unnest(['baseline', 'transformer']) AS backend, unnest([count(*), 0]) AS n_scored FROM documents WHERE length(trim(text, {ws()})) BETWEEN 5 AND 10000")
def backend_chosen(spark, sf):
    """Scoring under a backend's name: the trained one scores and logs its name, one that is not built in is refused."""
    path = work_path(spark, "backends")
    tables.promote(spark, path, "1", featurizer(spark, sf), "word_tfidf", trained(spark, sf, "logistic_regression"))
    found = []
    for backend in ("baseline", "transformer"):
        try:
            scored, _ = scoring_plan.run_scoring(spark, reports(spark, sf), path, f"{path}/log", explain=False, backend=backend)
            found.append((backend, scored.filter(F.col("model_backend") == backend).count()))
        except ValueError:
            found.append((backend, 0))
    return spark.createDataFrame(found, "backend string, n_scored long")


@query("late_job_not_promoted", "SELECT unnest(['late', 'in time']) AS job, unnest([false, true]) AS promoted, '2' AS serving FROM (SELECT count(*) FROM documents)")
def late_job_not_promoted(spark, sf):
    """A job whose lease ran out and was taken by another does not promote its model; the other one does."""
    path = work_path(spark, "fenced")
    fitted, model = featurizer(spark, sf), trained(spark, sf, "logistic_regression")
    late = markers.take_lease(spark, f"{path}/retrain_lock", "late", hours=0.0)
    in_time = markers.take_lease(spark, f"{path}/retrain_lock", "in time")
    done = [(lease.job, tables.promote(spark, path, str(lease.number), fitted, "word_tfidf", model, lease=lease)) for lease in (in_time, late)]
    serving = tables.current_model(spark, path)["run_id"]
    return spark.createDataFrame([(job, promoted, serving) for job, promoted in done], "job string, promoted boolean, serving string")


SWAP_SQL = f"""SELECT doc_id % 2 AS epoch, (doc_id % 2 + 1)::VARCHAR AS run_id, count(*) AS n_logged, count(*) AS n_as_batch
FROM documents WHERE length(trim(text, {ws()})) BETWEEN 5 AND 10000 GROUP BY 1, 2"""


@query("stream_swaps_models", SWAP_SQL)
def stream_swaps_models(spark, sf):
    """Another model is promoted between two micro-batches; each batch is logged as a table scored with its own model."""
    path = work_path(spark, "swap")
    fitted, kinds = featurizer(spark, sf), ("logistic_regression", "linear_svc")
    docs = table(spark, sf, "documents")
    for epoch, kind in enumerate(kinds):
        docs.filter(F.col("doc_id") % 2 == epoch).write.parquet(f"{path}/in/part={epoch}")
        tables.promote(spark, path, str(epoch + 1), fitted, "word_tfidf", trained(spark, sf, kind))
        arriving = predlog.file_stream(spark, f"{path}/in/*", docs.schema)
        texts = arriving.select(F.col("doc_id").alias("odiNumber"), F.col("text").alias("summary"))
        predlog.drain(lambda: scoring_plan.score_arriving_in_use(texts, path, f"{path}/log", f"{path}/state"))
    names = ["epoch", "text_preview", "predicted_label", "confidence"]
    log = spark.read.parquet(f"{path}/log").groupBy(*names).agg(F.count(F.lit(1)).alias("n_logged"), F.max("run_id").alias("run_id"))
    batches = []
    for epoch, kind in enumerate(kinds):
        part = reports(spark, sf).filter(F.col("odiNumber") % 2 == epoch)
        scored, _ = scoring_plan.score_rows(part, fitted, trained(spark, sf, kind), None, explain=False)
        batches.append(tables.log_rows(scored).withColumn("epoch", F.lit(epoch)))
    batch = batches[0].unionByName(batches[1]).groupBy(*names).agg(F.count(F.lit(1)).alias("n_batch"))
    both = log.join(batch, names, "left")
    return both.groupBy(F.col("epoch").cast("long").alias("epoch"), "run_id").agg(
        F.sum("n_logged").alias("n_logged"), F.sum(F.least("n_logged", F.coalesce("n_batch", F.lit(0)))).alias("n_as_batch")
    )


@query(
    "latest_run_metrics",
    f"WITH {SPLIT_SQL} SELECT unnest(['run_confusion', 'run_report', 'run_report_text']) AS part, unnest([count(*), count(*), count(DISTINCT primary_component) + 3]) AS n, "
    "true AS as_measured FROM split_reports WHERE split = 'test'",
)
def latest_run_metrics(spark, sf):
    """The tables of the newest run agree: rows of the test split, and accuracy from the confusion counts."""
    run = tables.latest_run_tables(spark, trained_job(spark, sf)[0])
    stated = run["run_metrics"].filter("scope = 'test' AND metric = 'accuracy'").first()["value"]
    c = run["run_confusion"].agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("v"))
    r = run["run_report"].filter("label = 'accuracy'").select(F.col("support").alias("n"), F.col("f1").alias("v"))
    t = run["run_report_text"].agg(F.count(F.lit(1)).alias("n"), F.lit(stated).alias("v"))
    parts = [d.select(F.lit(name).alias("part"), "n", (F.abs(F.col("v") - stated) < 1e-9).alias("as_measured")) for name, d in (("run_confusion", c), ("run_report", r), ("run_report_text", t))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "experiment_rows",
    f"WITH {SPLIT_SQL} SELECT 'word_tfidf__logistic_regression' AS combo, count(*) AS n_train, 1000 AS max_iter, '[1, 2, 3, 30000]' AS word, 42 AS seed FROM split_reports WHERE split = 'train'",
)
def experiment_rows(spark, sf):
    """What an experiment was trained with is in its row."""
    rows = spark.read.parquet(f"{trained_job(spark, sf)[0]}/experiments")
    value = lambda path: F.get_json_object("parameters", path)
    return rows.select(
        "combo", "n_train", value("$.model.max_iter").cast("int").alias("max_iter"),
        F.replace(value("$.features.word"), F.lit(","), F.lit(", ")).alias("word"), value("$.seed").cast("int").alias("seed"),
    )


STREAM_SQL = f"""SELECT count(*) AS n_logged, count(DISTINCT substr(trim(text, {ws()}), 1, 200)) AS n_previews,
  (SELECT count(*) FROM documents) - count(*) AS n_rejected, 0::BIGINT AS n_other_label
FROM documents WHERE length(trim(text, {ws()})) BETWEEN 5 AND 10000"""


@query("stream_equals_batch", STREAM_SQL)
def stream_equals_batch(spark, sf):
    """Arriving documents are cleaned with lemmas, labelled, logged and rejected as a batch would be."""
    lemmas = lemma_table(token_counts(_tokens(spark, sf), "tokens"))
    out, fitted, model = work_path(spark, "scored-stream"), featurizer(spark, sf), trained(spark, sf, "logistic_regression")
    docs = predlog.file_stream(spark, sf, table(spark, sf, "documents").schema, glob="documents.parquet")
    texts = docs.select(F.col("doc_id").alias("odiNumber"), F.col("text").alias("summary"))
    predlog.drain(lambda: scoring_plan.score_arriving(texts, fitted, model, lemmas, out, f"{out}_state"))
    log = spark.read.parquet(out)
    scored, _ = scoring_plan.score_rows(reports(spark, sf), fitted, model, lemmas, explain=False)
    batch = tables.log_rows(scored)
    names = ["text_preview", "predicted_label", "confidence"]
    count = [d.groupBy(*names).agg(F.count(F.lit(1)).alias(n)) for d, n in ((log, "a"), (batch, "b"))]
    off = count[0].join(count[1], names, "full").agg(F.sum(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))).alias("n_other_label"))
    rejects = spark.read.parquet(scoring_plan.rejects_of(out)).agg(F.count(F.lit(1)).alias("n_rejected"))
    totals = log.agg(F.count(F.lit(1)).alias("n_logged"), F.countDistinct("text_preview").alias("n_previews"))
    one = F.lit(1)
    return totals.withColumn("o", one).join(rejects.withColumn("o", one), "o").join(off.withColumn("o", one), "o").drop("o")


@query(
    "rejects_written",
    f"SELECT doc_id AS odiNumber, CASE WHEN length(trim(text, {ws()})) = 0 THEN 'empty' WHEN length(trim(text, {ws()})) < 200 THEN 'too short' ELSE 'too long' END AS reject_reason "
    f"FROM documents WHERE length(trim(text, {ws()})) NOT BETWEEN 200 AND 3000",
)
def rejects_written(spark, sf):
    """Rows that a scoring job sets aside, with bounds of the caller, read back from the reject table."""
    path = work_path(spark, "serving")
    tables.promote(spark, path, "1", featurizer(spark, sf), "word_tfidf", trained(spark, sf, "logistic_regression"))
    scoring_plan.run_scoring(spark, reports(spark, sf), path, f"{path}/log", explain=False, low=200, high=3000)
    return spark.read.parquet(scoring_plan.rejects_of(f"{path}/log")).select("odiNumber", "reject_reason")


@query("texts_scored_from_stream", f"SELECT count(*) AS n_logged, count(DISTINCT substr(trim(text, {ws()}), 1, 200)) AS n_previews FROM documents WHERE length(trim(text, {ws()})) BETWEEN 5 AND 10000")
def texts_scored_from_stream(spark, sf):
    """Arriving documents scored by a stream and added to the log."""
    out = work_path(spark, "scored-stream")
    docs = predlog.file_stream(spark, sf, table(spark, sf, "documents").schema, glob="documents.parquet")
    texts = docs.select(F.col("doc_id").alias("odiNumber"), F.col("text").alias("summary"))
    predlog.drain(lambda: scoring_plan.score_arriving(texts, featurizer(spark, sf), trained(spark, sf, "logistic_regression"), None, out, f"{out}_state"))
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n_logged"), F.countDistinct("text_preview").alias("n_previews"))
