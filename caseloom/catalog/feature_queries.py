"""N-gram features fitted on the train split, and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.catalog.base import LABELLED_SQL, SPLIT_SQL, labelled, once, query, split_reports
from caseloom.catalog.text_queries import tokens_sql, words_sql
from caseloom.config import CHAR_SPEC, CLEAN_TEXT, WORD_SPEC, NgramSpec
from caseloom.functions.text import classical_clean
from caseloom.functions.words import STOPWORDS
from caseloom.operators import features, heavy, weights


def clean_split(spark, sf) -> DataFrame:
    return once(spark, sf, "clean-split", lambda: split_reports(spark, sf).withColumn(CLEAN_TEXT, classical_clean("summary")).drop("summary"))


def train_rows(spark, sf) -> DataFrame:
    return clean_split(spark, sf).filter("split = 'train'")


CLEAN_SPLIT_SQL = SPLIT_SQL + f", lined AS (SELECT *, {tokens_sql('summary')} AS tokens FROM split_reports)"
WORD_GRAMS_SQL = """
w AS (SELECT odiNumber, split, primary_component, [x for x in tokens if length(x) > 1] AS w FROM lined),
word_grams AS (SELECT odiNumber, split, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams FROM w)"""
CHAR_GRAMS_SQL = """
p AS (SELECT odiNumber, split, pos, ' ' || t || ' ' AS p FROM (SELECT odiNumber, split, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM lined)),
windows AS (SELECT odiNumber, split, substr(p, i, n) AS term FROM
  (SELECT *, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT *, unnest([3, 4, 5]) AS n FROM p) WHERE length(p) >= n))"""


def terms_sql(spec: NgramSpec, name: str, rows: str, fitted: str = "split = 'train'") -> str:
    """CTEs ``{name}_terms(term, tf, df)`` and ``{name}_vocabulary(term, idx, idf)``."""
    return f"""
{name}_terms AS (SELECT term, count(*) AS tf, count(DISTINCT odiNumber) AS df FROM {rows} WHERE {fitted} GROUP BY term
  HAVING count(DISTINCT odiNumber) >= {spec.min_df} ORDER BY tf DESC, term LIMIT {spec.max_features}),
{name}_vocabulary AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx,
  ln((1.0 + (SELECT count(*) FROM lined WHERE {fitted})) / (1.0 + df)) + 1.0 AS idf FROM {name}_terms)"""


def weights_sql(name: str, rows: str) -> str:
    """CTE ``{name}_weights(odiNumber, idx, weight)``, each row scaled to length 1."""
    return f"""
{name}_raw AS (SELECT odiNumber, idx, count(*)::DOUBLE * any_value(idf) AS v FROM {rows} JOIN {name}_vocabulary USING (term) GROUP BY odiNumber, idx),
{name}_weights AS (SELECT odiNumber, idx, v / sqrt(sum(v * v) OVER (PARTITION BY odiNumber)) AS weight FROM {name}_raw)"""


WORD_ROWS_SQL = "word_rows AS (SELECT odiNumber, split, unnest(grams) AS term FROM word_grams)"
DIGEST_SQL = "SELECT odiNumber, count(*) AS n_terms, sum(idx)::BIGINT AS idx_sum, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS top_weight FROM"


def digest(long: DataFrame) -> DataFrame:
    """Per row: number of terms, sum of their indices, sum and maximum of the weights."""
    return long.groupBy("odiNumber").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("idx").alias("idx_sum"),
        F.round(F.sum("weight"), 6).alias("weight_sum"), F.round(F.max("weight"), 6).alias("top_weight"),
    )


@query("word_vocabulary", f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')} SELECT term, tf, df FROM word_terms")
def word_vocabulary(spark, sf):
    """The most frequent word 1-2-grams of the train split."""
    return features.word_vocabulary(train_rows(spark, sf)).select("term", "tf", "df")


VOCABULARY_SQL = f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')} SELECT term, tf, df FROM word_terms"
CHARACTERS_SQL = f"WITH {CLEAN_SPLIT_SQL}, {CHAR_GRAMS_SQL}, {terms_sql(CHAR_SPEC, 'char', 'windows')} SELECT term, tf, df FROM char_terms"


@query("word_vocabulary_by_sketch", VOCABULARY_SQL)
def word_vocabulary_by_sketch(spark, sf):
    """The same vocabulary from tables of bounded size and, where they overflow, counts of candidates alone."""
    return heavy.word_vocabulary(train_rows(spark, sf)).select("term", "tf", "df")


@query("char_vocabulary_by_sketch", CHARACTERS_SQL)
def char_vocabulary_by_sketch(spark, sf):
    return heavy.char_vocabulary(train_rows(spark, sf)).select("term", "tf", "df")


@query("char_vocabulary", f"WITH {CLEAN_SPLIT_SQL}, {CHAR_GRAMS_SQL}, {terms_sql(CHAR_SPEC, 'char', 'windows')} SELECT term, tf, df FROM char_terms")
def char_vocabulary(spark, sf):
    """The most frequent character 3-5-grams within words of the train split."""
    return features.char_vocabulary(train_rows(spark, sf)).select("term", "tf", "df")


@query(
    "word_tfidf",
    f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')}, {weights_sql('word', 'word_rows')} {DIGEST_SQL} word_weights GROUP BY odiNumber",
)
def word_tfidf(spark, sf):
    """Fitted on train, applied to all splits."""
    model = features.fit_word_tfidf(train_rows(spark, sf))
    return digest(features.explode_features(model.transform(clean_split(spark, sf)), "odiNumber"))


@query(
    "word_char_tfidf",
    f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {CHAR_GRAMS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')}, {terms_sql(CHAR_SPEC, 'char', 'windows')}, "
    f"{weights_sql('word', 'word_rows')}, {weights_sql('char', 'windows')}, both_weights AS (SELECT * FROM word_weights UNION ALL "
    f"SELECT odiNumber, idx + (SELECT count(*) FROM word_vocabulary), weight FROM char_weights) {DIGEST_SQL} both_weights GROUP BY odiNumber",
)
def word_char_tfidf(spark, sf):
    """Word block and character block side by side, each scaled on its own."""
    model = features.fit_word_char_tfidf(train_rows(spark, sf))
    return digest(features.explode_features(model.transform(clean_split(spark, sf)), "odiNumber"))


@query(
    "feature_names",
    f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {CHAR_GRAMS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')}, {terms_sql(CHAR_SPEC, 'char', 'windows')} "
    "SELECT idx, term FROM word_vocabulary UNION ALL SELECT idx + (SELECT count(*) FROM word_vocabulary), 'char:' || term FROM char_vocabulary",
)
def feature_names(spark, sf):
    return features.feature_table(spark, features.fit_word_char_tfidf(train_rows(spark, sf)))


LEGACY = NgramSpec(1, 2, 1, 5000)
LEGACY_GRAMS_SQL = f"""
w AS (SELECT odiNumber, split, [x for x in tokens if length(x) > 1 AND x NOT IN {words_sql(STOPWORDS)}] AS w FROM lined),
word_rows AS (SELECT odiNumber, split, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM w)"""


@query(
    "legacy_tfidf",
    f"WITH {CLEAN_SPLIT_SQL}, {LEGACY_GRAMS_SQL}, {terms_sql(LEGACY, 'word', 'word_rows', 'true')}, "
    f"{weights_sql('word', 'word_rows')} {DIGEST_SQL} word_weights GROUP BY odiNumber",
)
def legacy_tfidf(spark, sf):
    """The older block: 5,000 terms over all rows, stopwords out."""
    d = clean_split(spark, sf)
    return digest(features.explode_features(features.fit_legacy_tfidf(d).transform(d), "odiNumber"))


@query(
    "max_abs_scaled",
    f"WITH {CLEAN_SPLIT_SQL}, {WORD_GRAMS_SQL}, {WORD_ROWS_SQL}, {terms_sql(WORD_SPEC, 'word', 'word_rows')}, {weights_sql('word', 'word_rows')}, "
    f"scaled AS (SELECT odiNumber, idx, weight / max(weight) OVER (PARTITION BY idx) AS weight FROM word_weights) {DIGEST_SQL} scaled GROUP BY odiNumber",
)
def max_abs_scaled(spark, sf):
    model = features.fit_word_tfidf(train_rows(spark, sf))
    scaled = features.scale_by_max(model.transform(clean_split(spark, sf)))
    return digest(features.explode_features(scaled, "odiNumber", "scaled"))


@query("balanced_class_weights", f"WITH {LABELLED_SQL}, c AS (SELECT primary_component, count(*) AS n FROM labelled GROUP BY 1) SELECT primary_component, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 10) AS weight FROM c")
def balanced_class_weights(spark, sf):
    return weights.balanced_weights(labelled(spark, sf)).withColumn("weight", F.round("weight", 10))


@query(
    "root_class_weights",
    f"WITH {LABELLED_SQL}, s AS (SELECT * FROM labelled WHERE primary_component <> 'FR'), c AS (SELECT primary_component, count(*) AS n FROM s GROUP BY 1), "
    "b AS (SELECT primary_component AS label, sqrt(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n)) AS weight FROM c) "
    "SELECT l.label, round(coalesce(b.weight, 1.0), 10) AS weight FROM (SELECT DISTINCT primary_component AS label FROM labelled) l LEFT JOIN b USING (label)",
)
def root_class_weights(spark, sf):
    """Square-root weights of a sample that lacks one class."""
    from caseloom.operators.labels import label_space

    d = labelled(spark, sf)
    return weights.root_weights(d.filter(F.col("primary_component") != "FR"), label_space(d)).withColumn("weight", F.round("weight", 10))


@query("row_weights_sum", f"WITH {LABELLED_SQL} SELECT count(*) AS n_rows, count(*)::DOUBLE AS weight_sum FROM labelled")
def row_weights_sum(spark, sf):
    """Balanced row weights sum to the number of rows."""
    return weights.with_balanced_weights(labelled(spark, sf)).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 6).alias("weight_sum"))
