"""Small Column helpers: tags, ranked alternatives, report fields, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.config import SCORE_MAX_CHARS, SCORE_MIN_CHARS, TOP_K
from caseloom.functions.text import strip


def first_tag(tags: Column | str) -> Column:
    """First entry of a comma list, stripped. A leading comma gives an empty tag."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return strip(F.element_at(F.split(tags, ","), 1))


def tag_set(tags: Column | str) -> Column:
    """All distinct entries of a comma list, stripped; empty entries are kept."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_distinct(F.transform(F.split(tags, ","), strip))


def reject_reason(text: Column | str, low: int = SCORE_MIN_CHARS, high: int = SCORE_MAX_CHARS) -> Column:
    """Why a text cannot be scored; null if it can. Lengths are taken after stripping."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(strip(text))
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(n < low, "too short")
        .when(n > high, "too long")
    )


def ranked_labels(probabilities: Column | str, labels: Column, k: int | None = TOP_K, digits: int | None = 4) -> Column:
    """``array<struct<label, confidence>>``, best first, equal values by label.

    ``labels`` is an array Column in the order of the probability array.
    """
    probabilities = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    pairs = F.zip_with(
        labels, probabilities, lambda name, p: F.struct((-p).alias("down"), name.alias("label"))
    )
    best = F.sort_array(pairs)
    if k is not None:
        best = F.slice(best, 1, k)
    shown = (lambda v: F.round(v, digits)) if digits is not None else (lambda v: v)
    return F.transform(best, lambda s: F.struct(s["label"].alias("label"), shown(-s["down"]).alias("confidence")))


def confidence_band(confidence: Column | str) -> Column:
    """high at .7 and above, medium at .4 and above, low below."""
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def model_display_name(name: Column | str) -> Column:
    """Drop a ``-finetuned`` ending and everything up to the last slash."""
    name = F.col(name) if isinstance(name, str) else name
    return F.element_at(F.split(F.regexp_replace(name, "-finetuned$", ""), "/"), -1)


def leading_terms(explanation: Column | str, n: int = 5) -> Column:
    """The first ``n`` explanation terms as one comma-separated string."""
    explanation = F.col(explanation) if isinstance(explanation, str) else explanation
    return F.array_join(F.transform(F.slice(explanation, 1, n), lambda e: e["term"]), ", ")


def split_by_sign(explanation: Column | str) -> tuple[Column, Column]:
    """Supporting and opposing terms, each in ascending order of contribution."""
    explanation = F.col(explanation) if isinstance(explanation, str) else explanation
    ordered = F.transform(
        F.sort_array(F.transform(explanation, lambda e: F.struct(e["contribution"].alias("contribution"), e["term"].alias("term")))),
        lambda e: F.struct(e["term"].alias("term"), e["contribution"].alias("contribution")),
    )
    return (
        F.filter(ordered, lambda e: e["contribution"] >= 0),
        F.filter(ordered, lambda e: e["contribution"] < 0),
    )


def run_stamp(moment: Column) -> Column:
    """UTC run id of the form 20240131T235959Z."""
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")
