"""Defaults shared by all jobs. Every one can be passed as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Column names and thresholds a result depends on.
KEY = "odiNumber"
TEXT = "summary"
TAGS = "components"
LABEL = "primary_component"
CLEAN_TEXT = "clean_summary"
FILED = "dateComplaintFiled"
OTHER = "OTHER"

MIN_CLASS_ROWS = 200
MIN_TEXT_CHARS = 10
SCORE_MIN_CHARS = 5
SCORE_MAX_CHARS = 10_000
SEED = 42
TEST_SHARE = 0.15
VAL_SHARE = 0.15
TIME_TRAIN_MAX_YEAR = 2023
TOP_K = 3
EXPLAIN_TERMS = 10
PREVIEW_CHARS = 200
DROPPED_COLUMNS = ("vin", "products")

# A lookup table is broadcast only after a count shows it holds no more rows
# and bytes than this; a larger one goes through a salted shuffle join instead.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class NgramSpec:
    """One n-gram block: lengths, document-frequency floor and size limit."""

    low: int
    high: int
    min_df: int
    max_features: int


WORD_SPEC = NgramSpec(low=1, high=2, min_df=3, max_features=30_000)
CHAR_SPEC = NgramSpec(low=3, high=5, min_df=3, max_features=20_000)
