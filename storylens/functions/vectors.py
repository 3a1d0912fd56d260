"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let


def parse_vector(c) -> Column:
    """JSON array text to a vector; anything else is null."""
    return F.from_json(_col(c), "array<double>", {"mode": "PERMISSIVE"})


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 for empty, zero-length or differently sized vectors."""
    a, b = _col(a), _col(b)
    same_size = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    angle = let(norm(a) * norm(b), lambda scale: F.when(scale > 0, dot(a, b) / scale))
    return F.coalesce(F.when(same_size, angle), F.lit(0.0))


def unit(a) -> Column:
    a = _col(a)
    return let(
        norm(a),
        lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )


def merge_centroid(centroid, count, incoming) -> Column:
    """Mean after adding one vector to ``count`` others; the vector itself if none fit."""
    c, n, x = _col(centroid), _col(count), _col(incoming)
    merged = F.zip_with(c, x, lambda u, v: (u.cast("double") * n + v.cast("double")) / (n + 1))
    keep = c.isNotNull() & (F.size(c) == F.size(x))
    return F.when(keep, merged).otherwise(F.transform(x, lambda v: v.cast("double")))
