"""Array expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit length, unless the length is next to nothing."""
    n = norm(a)
    return F.when(n > TINY, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is next to nothing."""
    return F.when((norm(a) < TINY) | (norm(b) < TINY), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def time_of_day(micros: Column, single: bool = False) -> Column:
    """(sin, cos) at 1, 2, 4 and 8 turns a day, then a, hour, of whole seconds. `single` rounds seconds to 32-bit floats first."""
    seconds = F.floor(micros / 1_000_000)
    # the sum keeps the optimizer from folding both casts into one, which would skip the rounding
    narrow = (seconds.cast("float") + F.lit(0.0).cast("float")).cast("double")
    of_day = F.pmod(narrow, F.lit(86400.0)) if single else F.pmod(seconds, F.lit(86400)).cast("double")
    turns = [2.0 * math.pi * m / period for period in (86400.0, 3600.0) for m in (1, 2, 4, 8)]
    return F.array(*[f(of_day * w) for w in turns for f in (F.sin, F.cos)])


def quantized(a: Column) -> Column:
    """struct(scale, q): signed 8-bit codes, rounded half away from zero."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top <= 1e-10, F.lit(1.0 / 127)).otherwise(top / 127.0)
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))).cast("tinyint")).alias("q"))


def dequantized(scale: Column, q: Column) -> Column:
    return F.transform(q, lambda x: x * scale)
