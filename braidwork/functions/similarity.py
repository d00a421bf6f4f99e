"""Similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions.text import jamo


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on code points; 1 for two equal texts, empty ones included."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jamo_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the spelled-out texts."""
    return edit_similarity(jamo(a), jamo(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """M9: of two arrays of numbers, added in double; 0 for unequal lengths, empty arrays or zero norms."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot / scale).otherwise(zero)
