"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns (JVM-side higher-order functions).

Stored vectors are FLOAT; every expression casts to DOUBLE before arithmetic so
the sums agree with an independent engine to well below the 6 decimals we report.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    """Free where the entries are doubles already."""
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element-wise products, summed left to right."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v) -> Column:
    """Unit vector; a zero vector gives NULL (no division by zero under ANSI)."""
    n = F.nullif(norm(v), F.lit(0.0))
    return F.when(n.isNull(), F.lit(None)).otherwise(F.transform(as_double(v), lambda x: x / n))


def add(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def l2_distance(a, b) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """Dot / (|a| |b|); NULL when either side is a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


# Fixed values that must equal the reference: similarity bands (strict >) and
# L2 distance bands (strict <) with their labels.
#   similarity: > 0.7 HIGH, > 0.5 MEDIUM, otherwise LOW
#   L2 distance: < 0.8 EXCELLENT, < 1.2 BON, otherwise MAUVAIS
HIGH_ABOVE, MEDIUM_ABOVE = 0.7, 0.5
EXCELLENT_BELOW, GOOD_BELOW = 0.8, 1.2


def quality_band(score, high: float = HIGH_ABOVE, medium: float = MEDIUM_ABOVE) -> Column:
    s = _c(score)
    return F.when(s > high, "HIGH").when(s > medium, "MEDIUM").otherwise("LOW")


def distance_band(dist, excellent: float = EXCELLENT_BELOW, good: float = GOOD_BELOW,
                  labels=("EXCELLENT", "BON", "MAUVAIS")) -> Column:
    d = _c(dist)
    return F.when(d < excellent, labels[0]).when(d < good, labels[1]).otherwise(labels[2])


def pct(score, digits: int = 2) -> Column:
    """Presentation only: 0.5313 -> '53.13%'."""
    return F.format_string(f"%.{digits}f%%", _c(score) * 100.0)
