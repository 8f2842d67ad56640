"""Measures: overlap, relevance, contribution, bands, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    BANDS,
    BM25_B,
    BM25_K1,
    CERTAINTY,
    DEFAULT_STRENGTH,
    SCORE_BANDS,
    STRUCTURAL_BASE,
    STRUCTURAL_BONUS,
    TEXTUAL_CAP,
    TEXTUAL_LEAST,
    TEXTUAL_SLOPE,
)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def relevance(structural: Column, shared: Column) -> Column:
    """To four places: a declared skill starts high, one only in the text is capped or absent (0)."""
    linked = F.least(F.lit(1.0), STRUCTURAL_BASE + STRUCTURAL_BONUS * shared)
    textual = F.when(shared >= TEXTUAL_LEAST, F.least(F.lit(TEXTUAL_CAP), TEXTUAL_SLOPE * shared)).otherwise(0.0)
    return F.bround(F.when(structural, linked).otherwise(textual), 4)


def match_type(structural: Column, shared: Column) -> Column:
    return (
        F.when(structural & (shared > 0), "structural+textual")
        .when(structural, "structural")
        .when(shared >= TEXTUAL_LEAST, "textual_only")
        .otherwise("none")
    )


def strength(raw: Column) -> Column:
    """Number in 0 to 1; what is missing or unreadable is the neutral value."""
    value = raw.try_cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), F.lit(DEFAULT_STRENGTH))


def rounded(x: Column, places: int) -> Column:
    """Half-even on the scaled double. bround() would round the shortest decimal form, which ends in 5 where the double lies beside the tie."""
    return F.rint(x * 10.0**places) / 10.0**places


def contribution(s: Column, r: Column, recency: Column) -> Column:
    return rounded(s * r * recency, 6)


def score_band(score: Column) -> Column:
    out = None
    for name, least in SCORE_BANDS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("NONE")


def band_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), code.cast("int") + 1)


def product_band(strength_: Column, recency_: Column) -> Column:
    """Band of one piece of evidence by strength times recency."""
    return score_band(strength_ * recency_)


def status(before: Column, after: Column) -> Column:
    """Lost if nothing is left, Degraded if less is."""
    return F.when((before > 0) & (after == 0), "Lost").when(after < before, "Degraded").otherwise("Maintained")


def certainty_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CERTAINTY)), name).cast("int") - 1


def weaker_certainty(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CERTAINTY)), F.greatest(certainty_rank(a), certainty_rank(b)) + 1)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def bm25_idf(documents: Column, frequency: Column) -> Column:
    return F.log1p((documents - frequency + 0.5) / (frequency + 0.5))


def bm25_term(weight: Column, idf: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))
