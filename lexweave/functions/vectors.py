"""Cosine arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.constants import NORM_EPSILON
from lexweave.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return let(
        norm(a) + NORM_EPSILON, lambda n: F.transform(a, lambda x: x.cast("double") / n)
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + NORM_EPSILON) * (norm(b) + NORM_EPSILON))


def clamp_score(score: Column) -> Column:
    """Score limited to [0, 1]; a missing score counts as zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))
