"""Descriptor arithmetic on array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that an unrolled sum has at most.
UNROLLED = 16


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product in double precision. With a dim of UNROLLED at most, an unrolled sum that stays in generated code; of more, the
    code would be too long for the JVM to compile, and a loop is faster."""
    if dim and dim <= UNROLLED:
        return reduce(lambda x, y: x + y, (a[i].cast("double") * b[i].cast("double") for i in range(dim)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0),
            lambda s, x: s + x,
        )
    )


def checked(a: Column, dim: int) -> Column:
    """The vector, or a failed query if its length is not dim."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"descriptor length is not {dim}: "), F.size(a).cast("string"))))


def index_bytes(tiles: Column, rotations: int, dim: int) -> Column:
    """Memory of a flat float32 index."""
    return tiles * (rotations * dim * 4)
