"""Vector expressions over arrays, accumulated in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c, once

EPS = 1e-9


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Cosine of two unit vectors."""
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v) -> Column:
    """Scaled to length one; a vector of (nearly) no length stays as it is."""
    v = as_double(v)
    return once(norm(v), lambda n: F.when(n > EPS, F.transform(v, lambda x: x / n)).otherwise(v))


def mean_vector(v) -> Column:
    """Aggregate: element-wise mean, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))
