"""Dates: tolerant parsing, recency, months. The day of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AGING_MONTHS, DATE_FORMATS, DECAY, DECAY_DAYS, FRESH_MONTHS, HIGH, LOW, MODERATE, MONTH_DAYS


def parse_date(raw: Column) -> Column:
    """The first format that fits the text, else the part before T; null where none does."""
    text = F.trim(raw)
    tries = [F.try_to_timestamp(t, F.lit(f)) for t in (text, F.split(text, "T")[0]) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("date")


def parse_timestamp(raw: Column, missing: Column | None = None) -> Column:
    """ISO-8601 with or without a zone; null, or missing, where it can't be read."""
    found = F.try_to_timestamp(raw)
    return found if missing is None else F.coalesce(found, missing)


def age_days(day: Column, reference: Column) -> Column:
    """Whole days before the reference; a day in the future has age 0."""
    return F.greatest(F.datediff(reference, day), F.lit(0))


def recency(day: Column, reference: Column) -> Column:
    """Exponential decay to six places; 0 without a day."""
    return F.coalesce(F.bround(F.exp(-DECAY * age_days(day, reference) / DECAY_DAYS), 6), F.lit(0.0))


def recency_warning(raw: Column, day: Column, reference: Column) -> Column:
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), "missing_date")
        .when(day.isNull(), "invalid_date")
        .when(day > reference, "future_date")
    )


def months(day: Column, reference: Column) -> Column:
    """Whole days between, in months of 30.44 days."""
    return F.datediff(reference, day) / F.lit(MONTH_DAYS)


def age_cap(day: Column, reference: Column) -> Column:
    m = months(day, reference)
    return F.when(m <= FRESH_MONTHS, HIGH).when(m <= AGING_MONTHS, MODERATE).otherwise(LOW)
