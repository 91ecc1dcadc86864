"""Vector functions over array columns, and an offline embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def distance_score(distance: Column | str) -> Column:
    """``1 - d/2``: the similarity of unit vectors at a distance, linearly."""
    return 1 - col(distance) / 2


def rounded(vector: Column | str, digits: int = 6) -> Column:
    return F.transform(col(vector), lambda x: F.round(x.cast("double"), digits))


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """A unit vector of signed hash counts of the words: the offline stand-in for a model."""
    words = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.aggregate(hashed, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dim)) == i, F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)),
    )
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(v).cast("float"))
