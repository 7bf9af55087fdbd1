"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squared_l2(left: Column, right: Column) -> Column:
    """Squared Euclidean distance in DOUBLE, summed in element order."""
    terms = F.zip_with(
        left,
        right,
        lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    return F.when(F.size(left) == F.size(right), total).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )
