"""Vector expressions in double precision, and the seeded order that stands for random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def draw(*parts: Column | str) -> Column:
    """32 bits of an MD5 of the parts joined by '-': equal in every engine, which seeded generators are not."""
    text = F.concat_ws("-", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
