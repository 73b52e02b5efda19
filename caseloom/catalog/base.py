"""Registry, the report view of the given tables, and SQL fragments shared by oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.words import WHITESPACE
from caseloom.operators.cleaning import clean_reports
from caseloom.operators.labels import engineer_labels
from caseloom.operators.splits import stratified_split
from caseloom.session import settle, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIN_ROWS = 110  # taxonomy threshold for the given tables


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread for heavy work per row."""
    return spread(table(spark, sf, "documents"), "doc_id")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as reports: text, and a comma list with the language first."""
    d = table(spark, sf, "documents")
    tags = F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit(", "), F.upper("source"))
    ).otherwise(F.upper("lang"))
    return d.select(F.col("doc_id").alias("odiNumber"), F.col("text").alias("summary"), tags.alias("components"), "lang", "source")


_SETTLED: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries start from, written once per session and folder."""
    place = (spark.sparkContext.applicationId, sf, name)
    if place not in _SETTLED:
        _SETTLED[place] = settle(build(), name)
    return _SETTLED[place]


def planned(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made of a settled one by little work per row: its lookups are written, its rows are not written again."""
    place = (spark.sparkContext.applicationId, sf, name)
    if place not in _SETTLED:
        _SETTLED[place] = build()
    return _SETTLED[place]


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "cleaned", lambda: clean_reports(reports(spark, sf)))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf, "labelled", lambda: engineer_labels(cleaned(spark, sf), min_rows=MIN_ROWS)[0])


def split_reports(spark: SparkSession, sf: str) -> DataFrame:
    return planned(spark, sf, "split", lambda: stratified_split(labelled(spark, sf)))


# Marker words of the rule predictor and the probability table.
MARKERS = {"DE": (" der ", " und "), "EN": (" the ", " and "), "ES": (" el ", " los "), "FR": (" le ", " les ")}
CLASSES = tuple(sorted(MARKERS))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction table made by rules: marker words decide, English if there are none."""
    t = F.lower("summary")

    def has(name: str):
        a, b = MARKERS[name]
        return F.contains(t, F.lit(a)) | F.contains(t, F.lit(b))

    rule = F.when(has("DE"), "DE").when(has("FR"), "FR").when(has("ES"), "ES").otherwise("EN")

    def hits(name: str):
        return sum((((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m)).cast("long") for m in MARKERS[name]), F.lit(1))

    raw = F.array(*[hits(c).cast("double") for c in CLASSES])
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    return (
        reports(spark, sf).withColumn("true", F.upper("lang")).withColumn("pred", rule).withColumn("_raw", raw)
        .withColumn("probability", F.transform("_raw", lambda v: v / total)).drop("_raw")
    )


def ws() -> str:
    """The white-space set as a SQL string literal."""
    return "'" + WHITESPACE + "'"


REPORTS_SQL = """reports AS (
  SELECT doc_id AS odiNumber, text AS summary,
         CASE WHEN doc_id % 3 = 0 THEN upper(lang) || ', ' || upper(source) ELSE upper(lang) END AS components,
         lang, source
  FROM documents)"""

CLEANED_SQL = REPORTS_SQL + f""", cleaned AS (
  SELECT odiNumber, summary, components, lang, source FROM (
    SELECT *, row_number() OVER (PARTITION BY summary ORDER BY odiNumber) AS rn FROM reports
    WHERE summary IS NOT NULL AND components IS NOT NULL AND length(trim(summary, {ws()})) >= 10)
  WHERE rn = 1)"""

LABELLED_SQL = CLEANED_SQL + f""", tagged AS (
  SELECT *, trim(split_part(components, ',', 1), {ws()}) AS raw_label FROM cleaned),
taxonomy AS (SELECT raw_label AS label FROM tagged WHERE raw_label IS NOT NULL GROUP BY raw_label HAVING count(*) >= {MIN_ROWS}),
labelled AS (
  SELECT t.odiNumber, t.summary, t.components, t.lang, t.source, coalesce(x.label, 'OTHER') AS primary_component
  FROM tagged t LEFT JOIN taxonomy x ON t.raw_label = x.label)"""


def order_sql(key: str = "odiNumber", seed: int = 42) -> str:
    return f"md5({key}::VARCHAR || '|{seed}'), {key}"


def quota_sql(source: str, label: str, test: float, val: float, name: str = "quotas") -> str:
    """CTEs ending in ``name(label, n, n_test, n_val, n_train)``."""
    rest_share = val / (1 - test)

    def share_out(step: str, src: str, n: str, draws: str, out: str) -> str:
        return f"""
{step}_a AS (SELECT *, {n}::DOUBLE / sum({n}) OVER () * {draws} AS share FROM {src}),
{step}_b AS (SELECT *, floor(share) AS whole, {draws} - sum(floor(share)) OVER () AS spare FROM {step}_a),
{step} AS (SELECT * EXCLUDE (share, whole, spare),
  (whole + CASE WHEN row_number() OVER (ORDER BY share - whole DESC, {label}) <= spare THEN 1 ELSE 0 END)::BIGINT AS {out}
  FROM {step}_b)"""

    return f"""
{name}_n AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label}),
{name}_0 AS (SELECT *, (sum(n) OVER ())::BIGINT AS total FROM {name}_n),
{name}_1 AS (SELECT *, total - ceil({test!r}::DOUBLE * total)::BIGINT AS rest FROM {name}_0),{share_out(name + "_2", name + "_1", "n", "rest", "n_rest")},
{name}_3 AS (SELECT *, rest - ceil({rest_share!r}::DOUBLE * rest)::BIGINT AS train FROM {name}_2),{share_out(name + "_4", name + "_3", "n_rest", "train", "n_train")},
{name} AS (SELECT {label}, n, n - n_rest AS n_test, n_rest - n_train AS n_val, n_train FROM {name}_4)"""


SPLIT_SQL = LABELLED_SQL + "," + quota_sql("labelled", "primary_component", 0.15, 0.15) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY primary_component ORDER BY {order_sql()}) AS rn FROM labelled),
split_reports AS (
  SELECT r.* EXCLUDE (rn), CASE WHEN rn <= q.n_test THEN 'test' WHEN rn <= q.n_test + q.n_val THEN 'val' ELSE 'train' END AS split
  FROM ranked r JOIN quotas q USING (primary_component))"""


def _has(name: str) -> str:
    return "(" + " OR ".join(f"contains(lower(summary), '{m}')" for m in MARKERS[name]) + ")"


def _hits(name: str) -> str:
    parts = [f"(length(lower(summary)) - length(replace(lower(summary), '{m}', ''))) // {len(m)}" for m in MARKERS[name]]
    return f"(1 + {' + '.join(parts)})::DOUBLE"


PREDICTED_SQL = REPORTS_SQL + f""", hits AS (
  SELECT *, upper(lang) AS "true",
    CASE WHEN {_has('DE')} THEN 'DE' WHEN {_has('FR')} THEN 'FR' WHEN {_has('ES')} THEN 'ES' ELSE 'EN' END AS pred,
    [{', '.join(_hits(c) for c in CLASSES)}] AS raw
  FROM reports),
predicted AS (SELECT * EXCLUDE (raw), [v / list_sum(raw) for v in raw] AS probability FROM hits)"""

TAG_SET_SQL = f"list_distinct([trim(x, {ws()}) for x in string_split(components, ',')])"
RANKED_SQL = PREDICTED_SQL + f""", long AS (
  SELECT odiNumber, unnest([{', '.join(repr(c) for c in CLASSES)}]) AS label, unnest(probability) AS p FROM predicted),
ordered AS (SELECT *, row_number() OVER (PARTITION BY odiNumber ORDER BY p DESC, label) AS pos FROM long)"""
