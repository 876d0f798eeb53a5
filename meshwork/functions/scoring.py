"""Scores of binary classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; 0 where the denominator is 0."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(below == 0, 0.0).otherwise((tp * tn - fp * fn) / F.when(below != 0, below))


def positive_probability(logit0: Column, logit1: Column) -> Column:
    """Softmax of two logits, at the second."""
    return 1 / (1 + F.exp(logit0 - logit1))
