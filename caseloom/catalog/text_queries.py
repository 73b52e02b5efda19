"""Text normalisation over whole texts of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog.base import REPORTS_SQL, documents, once, query, reports, table
from caseloom.functions import records, text
from caseloom.functions.words import CODES, CONTRACTIONS, NOUN_ENDINGS, STOPWORDS, STOPWORDS_KEEPING_NEGATION, WHITESPACE
from caseloom.operators.lemma import apply_lemmas, legacy_lemmatised, lemma_table, token_counts
from caseloom.session import spread

# The given texts hold no codes or contractions, so both are added around each text.
ADDED_HEAD, ADDED_TAIL = "TL* ", " it doesn't *TR they'll *EA WON'T stop, can't we're"
MARKED_SQL = f"'{ADDED_HEAD}' || text || '{ADDED_TAIL}'".replace("doesn't", "doesn''t").replace(
    "they'll", "they''ll").replace("WON'T", "WON''T").replace("can't", "can''t").replace("we're", "we''re")


def _marked():
    return F.concat(F.lit(ADDED_HEAD), F.col("text"), F.lit(ADDED_TAIL))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_codes_sql(t: str) -> str:
    return f"regexp_replace({t}, {_quoted(CODES)}, ' ', 'g')"


def expand_sql(t: str, lower_case: bool = False) -> str:
    out = f"replace({t}, '’', '''')"
    for pattern, written in CONTRACTIONS:
        if not lower_case:
            out = f"regexp_replace({out}, {_quoted(text._shout(pattern))}, {_quoted(written.upper().replace('$1', chr(92) + '1'))}, 'g')"
        flags = "'g'" if lower_case else "'gi'"
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(written.replace('$1', chr(92) + '1'))}, {flags})"
    return out


def words_sql(words) -> str:
    return "(" + ", ".join(_quoted(w) for w in words) + ")"


def tokens_sql(t: str, keep: str = "a-z") -> str:
    parts = f"string_split_regex({expand_sql('lower(' + strip_codes_sql(t) + ')', True)}, '[^{keep}]+')"
    return f"[w for w in {parts} if w <> '' AND w NOT IN {words_sql(STOPWORDS_KEEPING_NEGATION)}]"


SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
SPACES = f"[{SPACE_CLASS}]+"


def light_sql(t: str) -> str:
    return f"trim(regexp_replace({expand_sql(strip_codes_sql(t))}, '{SPACES}', ' ', 'g'), ' ')"


@query("text_nfkc", "SELECT doc_id, text FROM documents")
def text_nfkc(spark, sf):
    """Undo wide letters and separate accents put into every text."""
    wide = F.replace(F.translate("text", "aeouAEOU0123", "ａｅｏｕＡＥＯＵ０１２３"), F.lit("\u00e9"), F.lit("e\u0301"))
    return documents(spark, sf).select("doc_id", text.nfkc(wide).alias("text"))


@query("text_strip_codes", f"SELECT doc_id, {strip_codes_sql(MARKED_SQL)} AS stripped FROM documents")
def text_strip_codes(spark, sf):
    return documents(spark, sf).select("doc_id", text.strip_codes(_marked()).alias("stripped"))


@query("text_expand_contractions", f"SELECT doc_id, {expand_sql(MARKED_SQL)} AS expanded FROM documents")
def text_expand_contractions(spark, sf):
    return documents(spark, sf).select("doc_id", text.expand_contractions(_marked()).alias("expanded"))


@query("text_lower", "SELECT doc_id, lower(text) AS lowered FROM documents")
def text_lower(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lowered"))


@query(
    "text_letters_only",
    f"SELECT doc_id, regexp_replace(lower(text), '[^a-z{SPACE_CLASS}]', ' ', 'g') AS letters, "
    f"regexp_replace(lower(text), '[^a-z0-9{SPACE_CLASS}]', ' ', 'g') AS letters_digits FROM documents",
)
def text_letters_only(spark, sf):
    low = F.lower("text")
    return documents(spark, sf).select(
        "doc_id", text.letters_only(low).alias("letters"), text.letters_only(low, keep_digits=True).alias("letters_digits")
    )


@query("text_collapse_spaces", f"SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g'), ' ') AS spaced FROM documents")
def text_collapse_spaces(spark, sf):
    return documents(spark, sf).select("doc_id", text.collapse_spaces("text").alias("spaced"))


@query(
    "text_stopwords_removed",
    f"SELECT doc_id, array_to_string([w for w in string_split(lower(text), ' ') if w <> '' AND w NOT IN {words_sql(STOPWORDS_KEEPING_NEGATION)}], ' ') AS kept, "
    f"len([w for w in string_split(lower(text), ' ') if w <> '' AND w NOT IN {words_sql(STOPWORDS_KEEPING_NEGATION)}])::BIGINT AS n_kept FROM documents",
)
def text_stopwords_removed(spark, sf):
    kept = text.remove_words(F.split(F.lower("text"), " "))
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("kept"), F.size(kept).cast("long").alias("n_kept"))


@query("text_classical_clean", f"SELECT doc_id, array_to_string({tokens_sql(MARKED_SQL)}, ' ') AS clean FROM documents")
def text_classical_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.classical_clean(_marked()).alias("clean"))


@query("text_classical_clean_digits", f"SELECT doc_id, array_to_string({tokens_sql('text', 'a-z0-9')}, ' ') AS clean FROM documents")
def text_classical_clean_digits(spark, sf):
    return documents(spark, sf).select("doc_id", text.classical_clean("text", keep_digits=True).alias("clean"))


@query("text_light_clean", f"SELECT doc_id, {light_sql(MARKED_SQL)} AS clean FROM documents")
def text_light_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.light_clean(_marked()).alias("clean"))


@query(
    "text_legacy_clean",
    f"SELECT doc_id, array_to_string([w for w in string_split_regex(regexp_replace(lower({MARKED_SQL}), '[^a-z{SPACE_CLASS}]', '', 'g'), '{SPACES}') "
    f"if w <> '' AND w NOT IN {words_sql(STOPWORDS)}], ' ') AS clean FROM documents",
)
def text_legacy_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.legacy_clean(_marked()).alias("clean"))


CONTENT_SQL = (
    r"[w for w in regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') if length(w) > 2 AND w NOT IN " + words_sql(STOPWORDS) + "]"
)


@query("text_content_words", f"SELECT doc_id, array_to_string({CONTENT_SQL}, ' ') AS words, len({CONTENT_SQL})::BIGINT AS n_words FROM documents")
def text_content_words(spark, sf):
    words = text.content_words("text")
    return documents(spark, sf).select("doc_id", F.array_join(words, " ").alias("words"), F.size(words).cast("long").alias("n_words"))


@query("text_upper", "SELECT s_suppkey, upper(s_name) AS make FROM supplier")
def text_upper(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.upper("s_name").alias("make"))


@query("text_preview", "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents")
def text_preview(spark, sf):
    return documents(spark, sf).select("doc_id", text.preview("text").alias("preview"))


@query("model_display_names", "SELECT doc_id, source AS display FROM documents")
def model_display_names(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", records.model_display_name(F.concat("lang", F.lit("/"), "source", F.lit("-finetuned"))).alias("display"))


@query("run_stamps", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, round(value, 4) AS value FROM events")
def run_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", records.run_stamp(F.col("ts")).alias("run_id"), F.round("value", 4).alias("value"))


def _forms_sql() -> str:
    parts = [
        f"SELECT token, left(token, length(token) - {len(e)}) || '{w}' AS lemma FROM counts WHERE suffix(token, '{e}') AND length(token) > {len(e)}" + (" AND NOT suffix(token, 'ss')" if e == "s" else "")
        for e, w in NOUN_ENDINGS
    ]
    return " UNION ".join(parts)


LEMMA_SQL = REPORTS_SQL + f""", lines AS (SELECT odiNumber, {tokens_sql('summary')} AS tokens FROM reports),
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM lines) GROUP BY token),
forms AS ({_forms_sql()}),
lemmas AS (SELECT token, lemma FROM (
  SELECT f.token, f.lemma, row_number() OVER (PARTITION BY f.token ORDER BY length(f.lemma), f.lemma) AS rn
  FROM forms f JOIN counts c ON c.token = f.lemma JOIN counts t ON t.token = f.token WHERE f.lemma <> '' AND c.n >= 0.1 * t.n) WHERE rn = 1)"""


def _tokens(spark, sf):
    """Normalised tokens of every report, written once for the lemma queries."""
    return once(spark, sf, "tokens", lambda: spread(reports(spark, sf), "odiNumber").select("odiNumber", text.classical_tokens("summary").alias("tokens")))


@query("lemma_table", f"WITH {LEMMA_SQL} SELECT token, lemma FROM lemmas")
def lemmas_of_tokens(spark, sf):
    return lemma_table(token_counts(_tokens(spark, sf), "tokens"))


@query(
    "text_lemmatised",
    f"WITH {LEMMA_SQL}, spots AS (SELECT odiNumber, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lines) "
    "SELECT l.odiNumber, coalesce(x.clean, '') AS clean FROM lines l LEFT JOIN (SELECT s.odiNumber, "
    "string_agg(coalesce(m.lemma, s.token), ' ' ORDER BY s.pos) AS clean FROM spots s LEFT JOIN lemmas m USING (token) GROUP BY s.odiNumber) x USING (odiNumber)",
)
def text_lemmatised(spark, sf):
    """The full cleaner: normalised tokens, each replaced by its checked lemma."""
    tokens = _tokens(spark, sf)
    done = apply_lemmas(tokens, "tokens", lemma_table(token_counts(tokens, "tokens")))
    return done.select("odiNumber", F.array_join("tokens", " ").alias("clean"))


LEGACY_LINES = (
    f"SELECT odiNumber, [w for w in string_split_regex(regexp_replace(lower(summary), '[^a-z{SPACE_CLASS}]', '', 'g'), '{SPACES}') "
    f"if w <> '' AND w NOT IN {words_sql(STOPWORDS)}] AS tokens FROM reports"
)
LEGACY_LEMMA_SQL = LEMMA_SQL.replace(f"SELECT odiNumber, {tokens_sql('summary')} AS tokens FROM reports", LEGACY_LINES)


@query(
    "text_legacy_lemmatised",
    f"WITH {LEGACY_LEMMA_SQL}, spots AS (SELECT odiNumber, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lines) "
    "SELECT l.odiNumber, coalesce(x.clean, '') AS clean FROM lines l LEFT JOIN (SELECT s.odiNumber, "
    "string_agg(coalesce(m.lemma, s.token), ' ' ORDER BY s.pos) AS clean FROM spots s LEFT JOIN lemmas m USING (token) GROUP BY s.odiNumber) x USING (odiNumber)",
)
def text_legacy_lemmatised(spark, sf):
    """The older cleaner with its last step, lemmas of its own tokens."""
    return legacy_lemmatised(spread(reports(spark, sf), "odiNumber").select("odiNumber", "summary"), "summary", "clean").select("odiNumber", "clean")


@query(
    "text_lemmatised_by_join",
    f"WITH {LEMMA_SQL}, spots AS (SELECT odiNumber, unnest(tokens) AS token FROM lines) "
    "SELECT coalesce(m.lemma, s.token) AS lemma, count(*) AS n FROM spots s LEFT JOIN lemmas m USING (token) GROUP BY 1",
)
def text_lemmatised_by_join(spark, sf):
    """The way taken when the lemma table is too large to broadcast; here as lemma counts."""
    tokens = _tokens(spark, sf)
    lemmas = lemma_table(token_counts(tokens, "tokens"))
    done = apply_lemmas(tokens, "tokens", lemmas, max_rows=0)
    return token_counts(done, "tokens").withColumnRenamed("token", "lemma")


BOTH_SQL = f"WITH {LEMMA_SQL} SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM (SELECT * FROM lines UNION ALL SELECT * FROM lines)"


@query("lemmas_both_ways", BOTH_SQL)
def lemmas_both_ways(spark, sf):
    """Dictionary and join give the same rows, also where keys repeat or are missing: each row comes twice here."""
    tokens = _tokens(spark, sf)
    lemmas = lemma_table(token_counts(tokens, "tokens"))
    twice = tokens.unionByName(tokens).withColumn("odiNumber", F.when(F.col("odiNumber") % 3 != 0, F.col("odiNumber") % 7))
    ways = [apply_lemmas(twice, "tokens", lemmas, max_rows=n).withColumn("way", F.lit(k)) for k, n in enumerate((0, 10**6))]
    counts = [F.count_if(F.col("way") == k).alias(f"n{k}") for k in range(2)]
    both = ways[0].unionByName(ways[1]).groupBy("odiNumber", "tokens").agg(*counts)
    return both.agg(F.sum("n0").alias("n_rows"), F.sum(F.abs(F.col("n0") - F.col("n1"))).alias("n_different"))


@query(
    "word_frequencies",
    f"SELECT word AS value, count(*) AS n FROM (SELECT unnest({CONTENT_SQL}) AS word FROM documents) GROUP BY word",
)
def word_frequencies(spark, sf):
    from caseloom.operators.explore import word_frequencies as count_words

    return count_words(table(spark, sf, "documents"), "text")


@query(
    "vocabulary_audit",
    f"WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({CONTENT_SQL}) AS word FROM documents) GROUP BY word) "
    "SELECT count(*) AS n_terms, count(*) FILTER (WHERE n = 1) AS n_once, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 10) AS once_share FROM c",
)
def vocabulary_audit(spark, sf):
    from caseloom.operators.quality import vocabulary_audit as audit

    return audit(table(spark, sf, "documents"), "text").withColumn("once_share", F.round("once_share", 10))


@query(
    "code_prevalence",
    f"SELECT count(*) FILTER (WHERE hit) AS n_coded, round(avg(hit::INT)::DOUBLE, 10) AS coded_share FROM "
    f"(SELECT regexp_matches(CASE WHEN doc_id % 16 = 0 THEN {MARKED_SQL} ELSE text END, {_quoted(CODES)}) AS hit FROM documents)",
)
def code_prevalence(spark, sf):
    from caseloom.operators.quality import code_prevalence as prevalence

    marked = F.when(F.col("doc_id") % 16 == 0, _marked()).otherwise(F.col("text"))
    return prevalence(table(spark, sf, "documents"), marked).withColumn("coded_share", F.round("coded_share", 10))
