"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is an expression over the text that says whether a document is rejected. On a sample, the cost of each rule is
timed and its rejected share counted; the cascade then asks the rules in the order of rejections per cost, and a CASE
leaves at the first rule that rejects. The order never changes the verdict, only what is spent on it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import column, settle

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2000  # rows the rules are timed on


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more in the text.

    64-bit hashes of windows are sorted together with their places; neighbours that are equal are repeats. Their places,
    sorted, are then walked once: each adds the words up to the next place, a window at most.
    """

    def covered(w: Column) -> Column:
        spots = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.struct(F.xxhash64(F.slice(w, i, window)).alias("s"), i.alias("i")),
        )
        return let(F.sort_array(spots), lambda s: let(F.sort_array(F.transform(F.filter(s, _repeated(s)), lambda x: x["i"])), _span))

    def _repeated(s: Column):
        return lambda x, k: (F.get(s, k - 1)["s"] == x["s"]) | F.coalesce(F.get(s, k + 1)["s"] == x["s"], F.lit(False))

    def _span(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(window)), F.lit(window))),
            F.lit(0).cast("long"), lambda a, x: a + x,
        )

    return let(words(text), lambda w: F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(covered(w)))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text has no words."""
    t = F.coalesce(column(text), F.lit(""))
    return df.withColumns({
        "n_words": n_words(t), "word_chars": word_chars(t), "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(t),
    })


def base_rules(text: Column) -> list[Rule]:
    """The two rules that every verdict contains."""
    return [
        Rule("few_words", n_words(text) < 10),
        Rule("repeated_words", n_repeat_words(text) * 100 > n_words(text) * 20),
    ]


def style_rules(text: Column) -> list[Rule]:
    """Rules on symbols, cries, capitals, word lengths and repeated lines. Their bounds are far from what prose has."""
    chars = F.greatest(word_chars(text), F.lit(1))
    count = F.greatest(n_words(text), F.lit(1))
    return [
        Rule("symbols", count_of(text, SYMBOLS) * 100 > count * 20),
        Rule("cries", count_of(text, "!") * 100 > count * 30),
        Rule("capitals", count_of(text, "[A-Z]") * 100 > chars * 60),
        Rule("long_words", chars > count * 30),
        Rule("repeated_lines", n_dup_lines(text) * 100 > F.size(lines(text)) * 60),
    ]


def ordered_rules(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on a bounded sample of ``df``; without rows the order stays."""
    share = min(1.0, 2.0 * sample_rows / max(df.count(), 1))  # a plain limit would send sample_rows of each task to one
    part = settle(df.sample(share, seed=7).limit(sample_rows), "rule_sample")
    base = 0.0
    rated = []
    for k, rule in enumerate([Rule("none", F.lit(False)), *rules]):
        start = time.perf_counter()
        hits = part.agg(F.count_if(rule.rejects)).first()[0]
        took = time.perf_counter() - start
        if k == 0:
            base = took  # reading and job start, the same for all
        else:
            rated.append((-hits / max(took - base, 1e-3), k, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), rule.name)
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")


def apply_cascade(df: DataFrame, text: str = "text", rules=None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with kept (boolean) and rejected_by (the rule at which the cascade stopped, null for kept rows).

    ``rules`` is a function from the text column to rules; by default the base and style rules. A null text counts as
    empty and has too few words. Columns named kept and rejected_by are replaced. Rows are independent: repeated rows
    get the same verdict and nothing is shuffled. Which rule is named for a document that several rules reject depends
    on the measured order.
    """
    own = [c for c in df.columns if c.lower() not in ("kept", "rejected_by")]
    df = df.select(*map(column, own))
    t = F.coalesce(column(text), F.lit(""))
    listed = rules(t) if rules else [*base_rules(t), *style_rules(t)]
    order = ordered_rules(df.select(column(text)), listed, sample_rows)
    return df.withColumn("rejected_by", cascade(order)).withColumn("kept", F.isnull("rejected_by"))


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The measures, base_failed and kept for each row of ``df``. Style rules are only asked where the base passes."""
    t = F.coalesce(column(text), F.lit(""))
    order = ordered_rules(df.select(column(text)), style_rules(t), sample_rows)
    full = measures(df, text)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    verdict = F.when(failed, F.lit(False)).otherwise(F.isnull(cascade(order)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    return full.withColumn("base_failed", failed).withColumn("kept", verdict).select(*map(column, kept), *names)
