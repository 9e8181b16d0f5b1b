"""Rules that decide whether and how a question is answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least score of evidence, how many hits are looked at, and the share of the best keyword score that is strong evidence.
EVIDENCE_LEAST, EVIDENCE_WINDOW, STRONG_SHARE = 0.10, 5, 0.2


def evidence_missing(results: Column, top_score: Column, number_asked: Column, number_found: Column) -> Column:
    """The reason why evidence doesn't suffice, else null."""
    return F.when(results == 0, "no_results").when(top_score < EVIDENCE_LEAST, "weak").when(number_asked & ~number_found, "no_number")


def no_access(denied: Column, accessible: Column, denied_strong: Column, accessible_strong: Column, denied_score: Column, accessible_score: Column) -> Column:
    """Whether the answer is hidden rather than absent."""
    return F.when(denied == 0, False).when(accessible == 0, True).otherwise(denied_strong & (~accessible_strong | (denied_score > accessible_score)))
