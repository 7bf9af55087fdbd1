"""Price buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# (exclusive upper bound, label, shown minimum, shown maximum) (fixed values).
# A price is placed by the upper bounds alone; the shown maxima are labels, so
# 99.995 is still in the first bucket.
BUCKETS = (
    (100, "Under ₹100", 0.0, 99.99),
    (250, "₹100 - ₹250", 100.0, 249.99),
    (500, "₹250 - ₹500", 250.0, 499.99),
    (1000, "₹500 - ₹1,000", 500.0, 999.99),
    (2500, "₹1,000 - ₹2,500", 1000.0, 2499.99),
    (5000, "₹2,500 - ₹5,000", 2500.0, 4999.99),
    (None, "Above ₹5,000", 5000.0, 999999.0),
)
LABELS = tuple(bucket[1] for bucket in BUCKETS)


def bucket_number(price: Column) -> Column:
    """0-based bucket; null for a null price."""
    chosen = F.when(price.isNull(), F.lit(None).cast("int"))
    for number, (upper, *_) in enumerate(BUCKETS):
        if upper is not None:
            chosen = chosen.when(price < upper, F.lit(number))
    return chosen.otherwise(F.lit(len(BUCKETS) - 1))


def _attribute(number: Column, position: int) -> Column:
    values = F.array(*[F.lit(bucket[position]) for bucket in BUCKETS])
    return F.when(number.isNotNull(), F.element_at(values, number + 1))


def bucket_label(number: Column) -> Column:
    return _attribute(number, 1)


def bucket_min(number: Column) -> Column:
    return _attribute(number, 2)


def bucket_max(number: Column) -> Column:
    return _attribute(number, 3)


def in_price_window(price: Column) -> Column:
    """Prices that are counted: above 0 and below 100000."""
    return (price > 0) & (price < 100000)
