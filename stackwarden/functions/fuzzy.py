"""Ratcliff-Obershelp similarity of short tokens."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .paths import _c

MIN_RATIO = 0.85
MAX_LENGTH_GAP = 2
MIN_NEEDLE = 4


@F.pandas_udf(DoubleType())
def _ratio(needle: pd.Series, token: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(needle, token)], dtype="float64")


def fuzzy_ratio(needle, token) -> Column:
    """Similarity in 0..1. The order of the arguments matters to ties inside the measure."""
    return _ratio(_c(needle), _c(token))


def edit_bound(needle, token) -> Column:
    """Most edits two tokens can be apart and still reach the ratio: with T letters in all and L in
    common order, edits <= T - 2L, and the ratio counts at most L matches, so edits <= (1 - ratio) T."""
    total = F.length(_c(needle)) + F.length(_c(token))
    return F.floor(total * (1.0 - MIN_RATIO) + 1e-9).cast("int")


def may_match(needle, token, max_edits: int | None = None) -> Column:
    """Cheap test on the JVM that no matching pair fails. A known upper limit of the edits that can be
    allowed at all lets the distance stop early."""
    a, b = _c(needle), _c(token)
    edits = F.levenshtein(a, b) if max_edits is None else F.levenshtein(a, b, max_edits)
    return (
        (F.length(a) >= MIN_NEEDLE)
        & (F.abs(F.length(a) - F.length(b)) <= MAX_LENGTH_GAP)
        & edits.between(F.lit(0), edit_bound(a, b))
    )


def most_edits(longest_needle: int) -> int:
    return int((2 * longest_needle + MAX_LENGTH_GAP) * (1.0 - MIN_RATIO) + 1e-9)
